"""Generated questions: windows of evidence through a model, validated, deduplicated, merged in topic order; insights."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bare_forms, content_id, plain_words, word_similarity
from ..models import StructuredModel, StubModel
from .planning import balanced_windows


def generate_candidates(chunks: DataFrame, topic: str, order: list[str], per_window: int, schema: dict, build=StubModel) -> DataFrame:
    """(topic, window_no, response): one call for each window of a topic's chunks; a window is a bounded group."""
    rows = balanced_windows(chunks.where("text IS NOT NULL"), topic, order, per_window)
    windows = rows.groupBy(F.col(topic).alias("topic"), "window_no").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))).alias("evidence"))

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: StructuredModel = build()
        for b in batches:
            out = []
            for t, n, evidence in zip(b["topic"], b["window_no"], b["evidence"]):
                prompt = f"Topic: {t}\n\n" + "\n\n".join(f"[{e['chunk_id']}] {e['text']}" for e in evidence)
                out.append((t, n, json.dumps(model.generate(prompt, schema), ensure_ascii=False, sort_keys=True)))
            yield pd.DataFrame(out, columns=["topic", "window_no", "response"])

    return windows.mapInPandas(call, "topic string, window_no long, response string")


def dedup_in_order(candidates: DataFrame, threshold: float = 0.78) -> DataFrame:
    """(topic, pos, question): the candidates of a topic in order, without those like an earlier one of it that stays.

    Questions of a topic that share a word are compared (unlike ones share none, and are never similar); the rule that an
    earlier one decides is resolved in rounds. Questions without a word stay.
    """
    from .pairing import meetings
    from .retrieval import greedy_kept

    rows = candidates.select("topic", "pos", "question", plain_words("question").alias("w"), F.struct("topic", "pos").alias("id"))
    both = F.array_distinct(F.concat("w", F.flatten(F.transform("w", lambda t: bare_forms(t)))))
    posts = rows.select("id", "w", F.explode(both).alias("word")).select(F.xxhash64("id.topic", "word").alias("token"), "id", "w")
    near = meetings(posts).where((F.col("id.topic") == F.col("o_id.topic")) & (word_similarity(F.col("w"), F.col("o_w")) >= threshold)).select(F.col("id").alias("a"), F.col("o_id").alias("b")).distinct()
    return greedy_kept(rows.select("id", "question"), near, "id").select("id.topic", "id.pos", "question")


def merged_in_order(candidates: DataFrame, budget: int) -> DataFrame:
    """Topics one after the other up to a budget, with content ids."""
    w = Window.orderBy("topic", "pos")
    return candidates.withColumn("place", F.row_number().over(w)).where(F.col("place") <= budget).withColumn("id", content_id("Q", F.concat_ws("\0", "topic", "question")))


def insight_rows(records: DataFrame, size: str, budget: int = 80_000) -> DataFrame:
    """The judged records that go into an insight prompt of so many characters: the risky outcomes first, then the other failures,
    then the rest, by topic and id; one that doesn't fit is left out and smaller ones after it are tried. size is a column of
    lengths."""
    from .drafts import fitting_rows

    risk = F.when(F.col("outcome").isin("misleading_hallucination", "should_have_abstained", "missing_clarification"), 0).when(F.col("outcome").isin("correct_answer", "correct_abstention", "correct_clarification"), 2).otherwise(1)
    judged = records.where(~F.col("outcome").isin("chatbot_error", "judge_error")).withColumn("class", risk)
    return fitting_rows(judged, ["class", "topic", "question_id"], size, budget)


def checked_insights(issues: DataFrame, records: DataFrame) -> DataFrame:
    """(issue_id, examples, topics, severity): counts made again from the records; issues without a known example are dropped,
    a high severity with one example is medium. issues is (issue_id, severity, question_ids)."""
    one = issues.select("issue_id", "severity", F.explode("question_ids").alias("question_id")).distinct().join(records.select("question_id", "topic"), "question_id")
    g = one.groupBy("issue_id", "severity").agg(F.countDistinct("question_id").alias("examples"), F.countDistinct("topic").alias("topics"))
    return g.select("issue_id", "examples", "topics", F.when((F.col("severity") == "high") & (F.col("examples") < 2), "medium").otherwise(F.col("severity")).alias("severity"))
