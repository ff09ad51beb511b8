"""Metrics of a run: every metric has its own population, hits and denominator, all counted in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import rate, wilson
from .outcomes import classified

USEFUL = ("correct_answer", "partial_too_little", "partial_too_much", "correct_clarification")
PIPELINE = ("correct_answer", "correct_abstention", "correct_clarification")
RISKY = ("misleading_hallucination", "should_have_abstained", "missing_clarification")
BEHAVIOR = ("missing_clarification", "incorrect_abstention", "should_have_abstained")
ERRORS = ("chatbot_error", "judge_error")
EMPTY_CONTEXTS = ("", "[]", "{}", "null", "none", "[ ]", "{ }")
SMALL_SAMPLE = 10
NO_TOPIC = "לא סווג"  # fixed value: the topic of questions without one


def evaluable() -> Column:
    return ~F.col("outcome").isin(*ERRORS)


def with_context() -> Column:
    norm = F.lower(F.trim(F.regexp_replace("retrieved_context", r"\s+", " ")))
    return ~F.coalesce(norm, F.lit("")).isin(*EMPTY_CONTEXTS)


def retrieval_available() -> Column:
    return evaluable() & (F.col("expected_behavior") == "answer") & with_context()


def retrieval_good() -> Column:
    return (F.col("required") > 0) & (F.col("retrieval_found") == F.col("required")) & (F.col("chunks_contradictory") == 0)


def metric_predicates() -> dict[str, tuple[Column, Column]]:
    """rate -> (population, hit), over classified records."""
    o, e = F.col("outcome"), evaluable()
    task = lambda x: e & (F.col("expected_behavior") == x)
    return {
        "infrastructure_error_rate": (F.lit(True), ~e),
        "correct_answer_rate_on_answerable": (task("answer"), o == "correct_answer"),
        "factual_answer_success_rate": (task("answer"), o == "correct_answer"),
        "useful_answer_rate_on_answerable": (e & F.col("answerable"), o.isin(*USEFUL)),
        "clarification_success_rate": (task("clarify"), o == "correct_clarification"),
        "abstention_success_rate": (task("abstain"), o == "correct_abstention"),
        "misinformation_rate": (e, o == "misleading_hallucination"),
        "risky_misinformation_rate": (e, o.isin(*RISKY)),
        "good_retrieval_rate": (retrieval_available(), retrieval_good()),
        "factual_risk_rate": (e, (F.col("false_claims") > 0) | (F.col("unsupported") > 0)),
        "requires_verification_rate": (e, F.col("requires_verification") > 0),
        "behavior_failure_rate": (e, o.isin(*BEHAVIOR)),
    }


#: The rates that two runs are compared by, and whether less of it is better.
COMPARED = {
    "factual_answer_success_rate": False, "useful_answer_rate_on_answerable": False, "clarification_success_rate": False, "abstention_success_rate": False, "good_retrieval_rate": False,
    "misinformation_rate": True, "risky_misinformation_rate": True, "infrastructure_error_rate": True, "factual_risk_rate": True, "behavior_failure_rate": True,
}


def in_headline(canonical_scoring: str = "gap") -> Column:
    """Anchors are asked for comparison only, unless canonical questions are scored ("include")."""
    return F.lit(True) if canonical_scoring == "include" else ~F.coalesce(F.col("anchor"), F.lit(False))


def headline(records: DataFrame, canonical_scoring: str = "gap") -> DataFrame:
    return records.where(in_headline(canonical_scoring))


def topic_of(c: str = "topic") -> Column:
    return F.when(F.coalesce(F.col(c), F.lit("")) == "", NO_TOPIC).otherwise(F.col(c))


def _long(counts: DataFrame, keys: list[str], names: list[str], label: str = "metric") -> DataFrame:
    """One row for each metric from a row of counts."""
    pairs = F.array(*[F.struct(F.lit(n).alias(label), F.col(f"{n}_n").alias("numerator"), F.col(f"{n}_d").alias("denominator")) for n in names])
    rows = counts.select(*keys, F.explode(pairs).alias("m")).select(*keys, "m.*")
    low, high = wilson(F.col("numerator"), F.col("denominator"))
    return rows.select(*keys, label, "numerator", "denominator", rate(F.col("numerator"), F.col("denominator")).alias("rate"), low.alias("low"), high.alias("high"))


def rate_summary(records: DataFrame, by: list[str] | None = None, canonical_scoring: str = "gap") -> DataFrame:
    """(metric, numerator, denominator, rate, low, high) of all rates, overall or for each value of `by`."""
    predicates = metric_predicates()
    aggs = []
    for name, (population, hit) in predicates.items():
        aggs += [F.count_if(population & hit).alias(f"{name}_n"), F.count_if(population).alias(f"{name}_d")]
    counts = classified(headline(records, canonical_scoring)).groupBy(*(by or [])).agg(*aggs)
    return _long(counts, by or [], list(predicates))


def summary_entries(scope: Column) -> dict[str, tuple[Column, Column | None]]:
    """entry -> (aggregate, aggregate of its denominator or null) over classified records, those of the scope."""
    c, o = F.col, F.col("outcome")
    e = scope & evaluable()
    task = lambda x: e & (c("expected_behavior") == x)
    has, good = scope & retrieval_available(), scope & retrieval_available() & retrieval_good()
    n = F.count_if
    total = lambda x, cond: F.coalesce(F.sum(F.when(cond, x if isinstance(x, Column) else c(x))), F.lit(0)).cast("bigint")
    answer = task("answer")
    risk = e & ((c("false_claims") > 0) | (c("unsupported") > 0))
    overturned = c("overturned_supports") + c("overturned_unrelated") + c("overturned_not_found")
    voted = e & (c("votes") > 0)
    out: dict[str, tuple[Column, Column | None]] = {name: (n(scope & population & hit), n(scope & population)) for name, (population, hit) in metric_predicates().items()}
    counts = {
        "total": n(scope), "evaluable": n(e), "answerable_questions": n(e & c("answerable")), "unanswerable_questions": n(e & ~c("answerable")), "answer_tasks": n(answer),
        "clarification_tasks": n(task("clarify")), "abstention_tasks": n(task("abstain")), "infrastructure_errors": n(scope & ~evaluable()), "anchor_records": n(F.coalesce(c("anchor"), F.lit(False))),
        "correct_answer_count": n(answer & (o == "correct_answer")), "factual_answer_success_count": n(answer & (o == "correct_answer")), "factual_answer_success_denominator": n(answer),
        "useful_answer_count": n(e & c("answerable") & o.isin(*USEFUL)), "useful_answer_denominator": n(e & c("answerable")),
        "clarification_success_count": n(task("clarify") & (o == "correct_clarification")), "abstention_success_count": n(task("abstain") & (o == "correct_abstention")),
        "misinformation_count": n(e & (o == "misleading_hallucination")), "misinformation_denominator": n(e),
        "retrieval_evaluated": n(has), "good_retrieval_count": n(good), "pipeline_evaluable": n(answer),
        "generation_failures_despite_good_retrieval": n(good & ~o.isin(*USEFUL, *PIPELINE)), "generation_partials_despite_good_retrieval": n(good & o.isin(*USEFUL) & ~o.isin(*PIPELINE)),
        "pipeline.retrieval_unavailable": n(answer & ~has), "pipeline.retrieval_good_answer_good": n(good & o.isin(*PIPELINE)), "pipeline.retrieval_good_answer_poor": n(good & ~o.isin(*PIPELINE)),
        "pipeline.retrieval_poor_answer_good": n(has & ~good & o.isin(*PIPELINE)), "pipeline.retrieval_poor_answer_poor": n(has & ~good & ~o.isin(*PIPELINE)),
        "factual_risk_count": n(risk), "factual_risk_denominator": n(e), "behavior_failure_count": n(e & o.isin(*BEHAVIOR)), "behavior_failure_denominator": n(e),
        "requires_verification_count": n(e & (c("requires_verification") > 0)), "requires_verification_denominator": n(e), "requires_verification_values_total": total("requires_verification", e),
        "false_claim_verification_calls": total("verification_calls", e), "second_vote_rows": n(voted), "second_vote_calls": total("second_vote_calls", e),
        "second_vote_errors": n(e & (c("second_vote_error") != "")), "votes_disagree_count": n(voted & c("votes_disagree")),
        "false_claims_checked": total("claims_checked", e), "false_claims_confirmed": total(c("claims_checked") - overturned, e), "false_claims_overturned": total(overturned, e),
        "false_claims_overturned.supports": total("overturned_supports", e), "false_claims_overturned.unrelated": total("overturned_unrelated", e), "false_claims_overturned.quote_not_found": total("overturned_not_found", e),
        "all_response_claim_violations.scored_responses": n(e), "all_response_claim_violations.responses_with_violations": n(risk),
        "all_response_claim_violations.false_claims_total": total("false_claims", e), "all_response_claim_violations.unsupported_claims_total": total("unsupported", e),
        "answer_claim_metrics.required_points_total": total("required", answer), "answer_claim_metrics.addressed_points_total": total("addressed", answer), "answer_claim_metrics.correct_points_total": total("correct", answer),
        "answer_claim_metrics.false_claims_total": total("false_claims", answer), "answer_claim_metrics.unsupported_claims_total": total("unsupported", answer), "answer_claim_metrics.extraneous_claims_total": total("extraneous", answer),
        "retrieval_claim_metrics.required_points_total": total("required", has), "retrieval_claim_metrics.points_found_total": total("retrieval_found", has), "retrieval_claim_metrics.chunks_total": total("chunks_total", has),
        "retrieval_claim_metrics.relevant_chunks_total": total("chunks_relevant", has), "retrieval_claim_metrics.irrelevant_chunks_total": total(c("chunks_total") - c("chunks_relevant"), has), "retrieval_claim_metrics.contradictory_chunks_total": total("chunks_contradictory", has),
    }
    ratios = {
        "answer_claim_metrics.required_point_coverage": (total("correct", answer), total("required", answer)), "answer_claim_metrics.addressed_point_accuracy": (total("correct", answer), total("addressed", answer)),
        "answer_claim_metrics.false_claims_per_answer": (total("false_claims", answer), n(answer)), "answer_claim_metrics.unsupported_claims_per_answer": (total("unsupported", answer), n(answer)),
        "answer_claim_metrics.extraneous_claims_per_answer": (total("extraneous", answer), n(answer)), "retrieval_claim_metrics.required_point_coverage": (total("retrieval_found", has), total("required", has)),
        "retrieval_claim_metrics.relevant_chunk_rate": (total("chunks_relevant", has), total("chunks_total", has)), "retrieval_claim_metrics.contradictory_chunk_rate": (total("chunks_contradictory", has), total("chunks_total", has)),
    }
    return out | {k: (v, None) for k, v in counts.items()} | ratios


def run_summary(records: DataFrame, canonical_scoring: str = "gap") -> DataFrame:
    """(entry, value, numerator, denominator, low, high): every number of a run's summary, in one aggregation.

    A count has its value only; a rate its numerator and denominator and, where it is one of rows, its 95 % interval. Anchors
    count only in anchor_records, unless canonical questions are scored.
    """
    entries = summary_entries(in_headline(canonical_scoring))
    shares = set(metric_predicates())
    aggs = []
    for i, (num, den) in enumerate(entries.values()):
        aggs += [num.cast("bigint").alias(f"n{i}"), (den if den is not None else F.lit(None)).cast("bigint").alias(f"d{i}")]
    one = classified(records).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(k).alias("entry"), F.lit(v[1] is None).alias("is_count"), F.lit(k in shares).alias("is_share"), F.col(f"n{i}").alias("n"), F.col(f"d{i}").alias("d")) for i, (k, v) in enumerate(entries.items())])
    long = one.select(F.explode(rows).alias("m")).select("m.*")
    low, high = wilson(F.col("n"), F.col("d"))
    own = lambda c: F.when(~F.col("is_count"), c)
    value = F.when(F.col("is_count"), F.col("n").cast("double")).otherwise(rate(F.col("n"), F.col("d")))
    return long.select("entry", value.alias("value"), own(F.col("n")).alias("numerator"), own(F.col("d")).alias("denominator"), F.when(F.col("is_share"), low).alias("low"), F.when(F.col("is_share"), high).alias("high"))


def flagged_questions(records: DataFrame, canonical_scoring: str = "gap") -> DataFrame:
    """(list, question_id): the questions behind the summary's counts that name them."""
    o, e = F.col("outcome"), evaluable()
    good = retrieval_available() & retrieval_good()
    lists = {
        "generation_failures": good & ~o.isin(*USEFUL, *PIPELINE), "generation_partials": good & o.isin(*USEFUL) & ~o.isin(*PIPELINE), "requires_verification": e & (F.col("requires_verification") > 0),
        "votes_disagree": e & (F.col("votes") > 0) & F.col("votes_disagree"), "false_claims_overturned": e & (F.col("overturned_supports") + F.col("overturned_unrelated") + F.col("overturned_not_found") > 0),
    }
    named = F.filter(F.array(*[F.when(cond, F.lit(k)) for k, cond in lists.items()]), lambda x: x.isNotNull())
    return classified(headline(records, canonical_scoring)).select(F.explode(named).alias("list"), "question_id")


def claim_metrics(records: DataFrame, canonical_scoring: str = "gap") -> DataFrame:
    """(metric, numerator, denominator, rate): sums over claims and passages, with guarded ratios."""
    rows = classified(headline(records, canonical_scoring)).where(evaluable())
    answer = F.col("expected_behavior") == "answer"
    has = retrieval_available()
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("bigint")
    sums = {"claim_coverage": ("addressed", "required", answer), "claim_accuracy": ("correct", "addressed", answer), "claim_success": ("correct", "required", answer), "retrieval_coverage": ("retrieval_found", "required", has), "passage_relevance": ("chunks_relevant", "chunks_total", has), "passage_contradiction": ("chunks_contradictory", "chunks_total", has)}
    one = rows.agg(*[x for k, (a, b, cond) in sums.items() for x in (total(a, cond).alias(f"{k}_n"), total(b, cond).alias(f"{k}_d"))])
    return _long(one, [], list(sums)).select("metric", "numerator", "denominator", "rate")


def topic_breakdown(records: DataFrame, canonical_scoring: str = "gap") -> DataFrame:
    """Per topic: totals, counts, rates with their intervals, and whether fewer than SMALL_SAMPLE records could be evaluated."""
    o, e = F.col("outcome"), evaluable()
    answer = e & (F.col("expected_behavior") == "answer")
    n = F.count_if
    out = classified(headline(records, canonical_scoring)).withColumn("topic", topic_of()).groupBy("topic").agg(
        F.count("*").alias("total"), n(e).alias("evaluable"), n(retrieval_available()).alias("retrieval_evaluated"), n(answer).alias("answer_tasks"), n(e & F.col("answerable")).alias("answerable_questions"),
        n(o == "correct_answer").alias("correct"), n(o.isin(*USEFUL)).alias("useful"), n(o == "misleading_hallucination").alias("misinformation"), n(o.isin(*RISKY)).alias("risky"),
        n(retrieval_available() & retrieval_good()).alias("good_retrieval"),
    )
    for name, of in (("correct", "answer_tasks"), ("useful", "answerable_questions"), ("misinformation", "evaluable"), ("risky", "evaluable"), ("good_retrieval", "retrieval_evaluated")):
        low, high = wilson(F.col(name), F.col(of))
        out = out.withColumn(f"{name}_rate", rate(F.col(name), F.col(of))).withColumn(f"{name}_low", low).withColumn(f"{name}_high", high)
    return out.withColumn("small_sample", F.col("evaluable") < SMALL_SAMPLE)


def outcome_histogram(records: DataFrame, canonical_scoring: str = "gap") -> DataFrame:
    """(scope, outcome, n) overall (scope 'all') and for each topic, in one pass."""
    rows = classified(headline(records, canonical_scoring)).select(F.explode(F.array(F.lit("all"), topic_of())).alias("scope"), "outcome")
    return rows.groupBy("scope", "outcome").agg(F.count("*").alias("n"))


def pipeline_crosstab(records: DataFrame, canonical_scoring: str = "gap") -> DataFrame:
    """(retrieval, answer, n) over evaluable answer tasks."""
    rows = classified(headline(records, canonical_scoring)).where(evaluable() & (F.col("expected_behavior") == "answer"))
    retrieval = F.when(~with_context(), "unavailable").when(retrieval_good(), "good").otherwise("poor")
    answer = F.when(F.col("outcome").isin(*PIPELINE), "good").otherwise("poor")
    return rows.groupBy(retrieval.alias("retrieval"), answer.alias("answer")).agg(F.count("*").alias("n"))


def by_form(records: DataFrame, canonical_scoring: str = "gap") -> DataFrame:
    rows = classified(headline(records, canonical_scoring)).where(evaluable())
    out = rows.groupBy("question_form").agg(F.count("*").alias("evaluable"), F.count_if(F.col("outcome").isin(*PIPELINE)).alias("successes"))
    return out.withColumn("rate", rate(F.col("successes"), F.col("evaluable")))


def paired_variants(records: DataFrame) -> DataFrame:
    """Variants beside their parents, anchors among them, by form and overall: who succeeds, robustness, degradation."""
    rows = classified(records).where(evaluable())
    ok = F.col("outcome").isin(*PIPELINE)
    child = rows.where("parent_question_id IS NOT NULL").select("parent_question_id", "question_form", ok.alias("child_ok"))
    parent = rows.select(F.col("question_id").alias("parent_question_id"), ok.alias("parent_ok"))
    pairs = child.join(parent, "parent_question_id").select(F.explode(F.array(F.lit("all"), F.col("question_form"))).alias("form"), "child_ok", "parent_ok")
    p, c = F.col("parent_ok"), F.col("child_ok")
    out = pairs.groupBy("form").agg(
        F.count("*").alias("pairs"), F.count_if(p & c).alias("both_success"), F.count_if(p & ~c).alias("parent_only"), F.count_if(~p & c).alias("variant_only"), F.count_if(~p & ~c).alias("both_failure")
    )
    return out.withColumn("robustness", rate(F.col("both_success"), F.col("both_success") + F.col("parent_only"))).withColumn("degradation", rate(F.col("parent_only") - F.col("variant_only"), F.col("pairs")))


def phrasing_gap(records: DataFrame) -> DataFrame:
    """Anchors beside the natural wording of the same question."""
    rows = classified(records).where(evaluable())
    ok = F.col("outcome").isin(*PIPELINE)
    anchor = rows.where("anchor").select(F.col("question_id").alias("parent_question_id"), ok.alias("a"))
    natural = rows.where("question_form = 'natural_user' AND parent_question_id IS NOT NULL").select("parent_question_id", ok.alias("n"))
    out = anchor.join(natural, "parent_question_id").agg(F.count("*").alias("pairs"), F.count_if("a").alias("anchor_successes"), F.count_if("n").alias("natural_successes"))
    return out.withColumn("anchor_rate", rate(F.col("anchor_successes"), F.col("pairs"))).withColumn("natural_rate", rate(F.col("natural_successes"), F.col("pairs"))).withColumn("gap", rate(F.col("anchor_successes") - F.col("natural_successes"), F.col("pairs")))
