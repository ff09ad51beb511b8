"""The outcome of a judged answer, and what is re-derived from the judge's claims before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTCOMES = (
    "correct_answer", "partial_too_little", "partial_too_much", "unrelated_answer", "misleading_hallucination", "correct_abstention", "incorrect_abstention",
    "should_have_abstained", "correct_clarification", "missing_clarification", "chatbot_error", "judge_error",
)
# From the mildest to the most severe; outcomes of one rank are alike.
SEVERITY = {
    "correct_answer": 0, "correct_abstention": 0, "correct_clarification": 0, "partial_too_much": 1, "partial_too_little": 2, "unrelated_answer": 3,
    "incorrect_abstention": 4, "missing_clarification": 5, "should_have_abstained": 6, "misleading_hallucination": 7,
}


def outcome() -> Column:
    """One CASE chain over the columns of an evaluation record; the first condition that holds decides.

    Rows with an error are out before it; both flags at once are a contradiction of the judge and make a judge error.
    """
    c = F.col
    needed = F.when((c("question_form") == "broad") & (c("min_key_points") > 0), F.least("min_key_points", "required")).otherwise(c("required"))
    full = (c("required") > 0) & (c("correct") >= needed)
    broad, much = c("question_form") == "broad", c("answer_scope") == "too_much"
    return (
        F.when(c("error_kind") == "chatbot", "chatbot_error")
        .when((c("error_kind") == "judge") | (c("is_abstention") & c("is_clarification")), "judge_error")
        .when(c("false_claims") > 0, "misleading_hallucination")
        .when(c("expected_behavior") == "clarify", F.when(c("is_clarification"), "correct_clarification").otherwise("missing_clarification"))
        .when(c("clarification_acceptable") & c("is_clarification"), "correct_clarification")
        .when((c("expected_behavior") == "answer") & c("is_abstention"), "incorrect_abstention")
        .when(c("expected_behavior") == "abstain", F.when(c("is_abstention"), "correct_abstention").otherwise("should_have_abstained"))
        .when(c("is_clarification"), F.when(c("correct") > 0, "partial_too_little").otherwise("incorrect_abstention"))
        .when((c("incorrect_type") == "unrelated") & (c("correct") == 0), "unrelated_answer")
        .when(full & (broad | ~much), "correct_answer")
        .when((c("correct") > 0) | full, F.when(much, "partial_too_much").otherwise("partial_too_little"))
        .otherwise("unrelated_answer")
    )


def classified(records: DataFrame) -> DataFrame:
    return records.withColumn("outcome", outcome())


def reconcile_false_claims(df: DataFrame, claims: str = "claims") -> DataFrame:
    """Only false claims that cite evidence stay; the others count as unsupported.

    claims is an array of structs with the field evidence; adds cited, demoted and the new counts. The judge's label
    "hallucination" stays only beside a cited claim; else it becomes "unrelated", or "not_applicable" where a point is correct.
    """
    listed = F.coalesce(F.col(claims), F.array())
    cited = F.size(F.filter(listed, lambda x: F.trim(F.coalesce(x["evidence"], F.lit(""))) != ""))
    out = df.withColumn("cited", cited).withColumn("demoted", F.greatest(F.col("false_claims"), F.size(listed)) - F.col("cited"))
    label = F.when((F.col("incorrect_type") == "hallucination") & (F.col("cited") == 0), F.when(F.col("correct") == 0, "unrelated").otherwise("not_applicable")).otherwise(F.col("incorrect_type"))
    return out.withColumn("unsupported", F.col("unsupported") + F.col("demoted")).withColumn("false_claims", F.col("cited")).withColumn("incorrect_type", label)


def recount_claims(df: DataFrame, assessments: str = "assessments", expected: str = "required") -> DataFrame:
    """Totals from per-claim flags (id, addressed, correct), and fault, why the judgement can't be used; null where it can.

    The ids must be C001 to Cnnn, each once, in any order (claim_ids); tasks other than answers have no claims
    (claims_of_non_answer), and all their totals are 0. The points found by retrieval are the judge's, of the claims at most
    (found_above_claims). A faulty row has no totals.
    """
    a = F.coalesce(F.col(assessments), F.array().cast(df.schema[assessments].dataType))
    n = F.col(expected).cast("int")
    want = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.format_string("C%03d", i))).otherwise(F.array().cast("array<string>"))
    ids = F.array_sort(F.transform(a, lambda x: x["id"]))
    answer = F.col("expected_behavior") == "answer"
    fault = (
        F.when(~answer, F.when(F.size(a) > 0, "claims_of_non_answer"))
        .when(~F.coalesce(ids == F.array_sort(want), F.lit(False)), "claim_ids")
        .when(F.col("retrieval_found") > F.size(want), "found_above_claims")
    )
    total = lambda c: F.when(F.col("fault").isNull(), F.when(answer, c).otherwise(F.lit(0))).cast("bigint")
    count = lambda field: F.size(F.filter(a, lambda x: x[field]))
    out = df.withColumn("fault", fault).withColumn("retrieval_found", total(F.col("retrieval_found")))
    return out.withColumn("addressed", total(count("addressed"))).withColumn("correct", total(count("correct"))).withColumn(expected, total(F.size(want)))


def second_vote(first: Column, second: Column, harsher: bool = True) -> Column:
    """Of two outcomes the more severe (or the less severe); the first on a tie, and where the second vote failed."""
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    a, b = F.try_element_at(rank, first), F.try_element_at(rank, second)
    better = (b > a) if harsher else (b < a)
    return F.when(second.isNotNull() & F.coalesce(better, F.lit(False)), second).otherwise(first)


def needs_second_vote() -> Column:
    """Judged rows that rest on a doubtful call: a contradicted claim, one that was demoted or overturned, a value left to
    verify, or an outcome of that kind."""
    c = F.col
    doubtful = sum((c(x) for x in ("false_claims", "demoted", "requires_verification", "overturned_supports", "overturned_unrelated", "overturned_not_found")), F.lit(0)) > 0
    return ~c("outcome").isin("chatbot_error", "judge_error") & (doubtful | c("outcome").isin("misleading_hallucination", "unrelated_answer"))


def second_pass(claims: DataFrame, verdict: str = "verdict") -> DataFrame:
    """(question_id, kept, removed, demoted): contradicted claims after a second look.

    A claim whose quote can't be located (located false) is demoted without one; 'supports' removes it, 'unrelated' demotes it,
    'contradicts' keeps it.
    """
    fate = F.when(~F.col("located"), "demoted").when(F.col(verdict) == "supports", "removed").when(F.col(verdict) == "unrelated", "demoted").otherwise("kept")
    return claims.withColumn("_fate", fate).groupBy("question_id").agg(*[F.count_if(F.col("_fate") == x).alias(x) for x in ("kept", "removed", "demoted")])
