"""Quotes and passages as evidence: containment, grounding of candidates, budgets, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_quote


def _blank(c: str):
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def _flat(c: str):
    return F.lower(F.regexp_replace(c, r"[ \t\n]+", " "))


def quote_status(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(quote_id, status): verbatim, normalized (blanks and case apart), not_found, blank_quote, unknown_source, no_source."""
    q = quotes.select("quote_id", "source_id", "quote").distinct()
    c = chunks.select(F.col("chunk_id").alias("source_id"), "text").distinct().withColumn("known", F.lit(True))
    both = q.join(c, "source_id", "left")
    status = (
        F.when(_blank("source_id"), "no_source").when(F.col("known").isNull(), "unknown_source").when(_blank("quote"), "blank_quote")
        .when(F.contains("text", "quote"), "verbatim").when(F.contains(_flat("text"), F.lower(F.regexp_replace(F.trim("quote"), r"[ \t\n]+", " "))), "normalized").otherwise("not_found")
    )
    return both.select("quote_id", status.alias("status"))


def candidate_grounding(candidates: DataFrame, chunks: DataFrame, key: str = "candidate_id") -> DataFrame:
    """(key, reason): the first of seventeen reasons why a candidate question isn't grounded in its chunks; null where it is.

    candidates: (key, question, expected_answer, answerable, question_type, source_ids array, claims array, quotes array of
    (source_id, quote)); null arrays are empty. Quotes are compared as plain_quote, each distinct chunk text put into that form once.
    """
    some = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    c = candidates
    for name, kind in (("source_ids", "array<string>"), ("claims", "array<string>"), ("quotes", "array<struct<source_id: string, quote: string>>")):
        c = c.withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))
    text = chunks.select(F.col("chunk_id").alias("source_id"), "file", "text").dropDuplicates(["source_id"])
    cited = c.select(key, F.explode(F.array_distinct("source_ids")).alias("source_id")).join(text.select("source_id", "file", F.lit(True).alias("known")), "source_id", "left")
    cited = cited.groupBy(key).agg(F.count_if(F.col("known").isNull()).alias("unknown"), F.countDistinct("file").alias("files"))
    told = c.select(key, "source_ids", F.posexplode("quotes").alias("pos", "q")).select(key, "source_ids", "pos", "q.source_id", "q.quote")
    wanted = text.join(told.select("source_id").distinct(), "source_id", "left_semi").select("source_id", plain_quote("text").alias("text"))
    told = told.withColumn("quote", plain_quote("quote")).join(wanted, "source_id", "left")
    inside = (F.length("quote") >= 3) & F.contains("text", "quote")
    fault = F.when(~F.array_contains("source_ids", F.col("source_id")) | F.col("text").isNull(), "quote_source_mismatch").when(~F.coalesce(inside, F.lit(False)), "quote_not_verbatim")
    told = told.withColumn("fault", fault).groupBy(key).agg(F.min(F.when(F.col("fault").isNotNull(), F.struct("pos", "fault")))["fault"].alias("fault"), F.collect_set("source_id").alias("quoted"))
    rows = c.join(cited, key, "left").join(told, key, "left")
    said = F.filter(F.transform("claims", lambda x: F.trim(x)), lambda x: x != "")
    n = F.size("source_ids")
    kind = F.coalesce("question_type", F.lit(""))
    open_ = (
        F.when(kind != "unanswerable", "invalid_unanswerable_type").when(n == 0, "missing_source_ids").when(F.size(said) > 0, "unanswerable_has_reference_claims").when(F.size("quotes") > 0, "unanswerable_has_supporting_quotes")
    )
    reason = (
        F.when(~some("question"), "blank_question").when(~some("expected_answer"), "blank_expected_answer").when(n != F.size(F.array_distinct("source_ids")), "duplicate_source_ids")
        .when(F.coalesce("unknown", F.lit(0)) > 0, "unknown_source_id").when(~F.col("answerable"), open_)
        .when(kind.isin("personal_basic", "personal_integration", "unanswerable"), "unsupported_question_type").when((n == 0) | (F.size("quotes") == 0), "missing_evidence")
        .when(F.size(said) == 0, "missing_reference_claims").when(F.size(said) != F.size(F.array_distinct(said)), "duplicate_reference_claims").when(F.col("fault").isNotNull(), F.col("fault"))
        .when(F.size(F.array_except("source_ids", F.coalesce("quoted", F.array().cast("array<string>")))) > 0, "source_without_quote")
        .when((kind == "document_wide") & ((n < 2) | (F.col("files") != 1)), "invalid_document_wide_evidence").when((kind == "cross_document") & (F.col("files") < 2), "invalid_cross_document_evidence")
    )
    return rows.select(key, reason.alias("reason"))


def rejection_counts(rejected: DataFrame) -> DataFrame:
    """(reason, n) of the rejected candidates."""
    return rejected.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def canonical_containment(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(quote_id, contained) in the form of plain_quote."""
    both = quotes.select("quote_id", F.col("source_id").alias("chunk_id"), "quote").distinct().join(chunks.select("chunk_id", "text").distinct(), "chunk_id")
    return both.select("quote_id", F.contains(plain_quote("text"), plain_quote("quote")).alias("contained"))


def budget_prefix(rows: DataFrame, group: str, order: list[str], text: str, budget: int, marker: str = " [truncated]", separator: int = 2) -> DataFrame:
    """Rows of each group in order while they fit; the first that does not is cut to the room left and marked, then it ends."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length(text) + separator).over(w), F.lit(0))
    out = rows.withColumn("_before", before).where(F.col("_before") < budget)
    cut = F.concat(F.substring(F.col(text), F.lit(1), (F.lit(budget) - F.col("_before")).cast("int")), F.lit(marker))
    return out.withColumn(text, F.when(F.col("_before") + F.length(text) <= budget, F.col(text)).otherwise(cut)).drop("_before")


def full_texts(excerpts: DataFrame, chunks: DataFrame, key: str = "chunk_id", start: int = 120) -> DataFrame:
    """excerpts (key, excerpt) with the chunk's whole text where both begin alike, else the excerpt."""
    whole = chunks.select(key, F.col("text").alias("_whole")).dropDuplicates([key])
    head = lambda c: F.substring(F.regexp_replace(F.trim(c), r"\s+", " "), 1, start)
    return excerpts.join(whole, key, "left").withColumn("text", F.when(head(F.col("_whole")) == head(F.col("excerpt")), F.col("_whole")).otherwise(F.col("excerpt"))).drop("_whole")


def selected_passages(cited: DataFrame, ranked: DataFrame, limit: int) -> DataFrame:
    """(query, doc, place): cited passages first, then ranked ones, each once, at most limit of a query."""
    rows = cited.select("query", "doc", F.lit(0).alias("class"), F.col("pos").alias("pos")).unionByName(ranked.select("query", "doc", F.lit(1).alias("class"), F.col("rank").alias("pos")))
    one = rows.groupBy("query", "doc").agg(F.min(F.struct("class", "pos")).alias("x"))
    w = Window.partitionBy("query").orderBy("x", "doc")
    return one.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("query", "doc", "place")
