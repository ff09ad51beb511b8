"""The evaluation records that the report queries read: integer arithmetic on orders and customer, the same in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table

# column -> expression over k (question number), s (k moved for the run) and topic; // is integer division
COLUMNS = {
    "question_id": "k",
    # run B writes a topic otherwise now and then (no change) and moves some questions to another one (a change)
    "topic": "case when s <> k and k % 211 = 0 then 'MOVED' when s <> k and k % 5 = 0 then concat('  ', lower(topic)) when k % 223 = 0 then '' else topic end",
    "expected_behavior": "case k % 10 when 0 then 'abstain' when 1 then 'clarify' else 'answer' end",
    "answerable": "k % 10 <> 0",
    "question_form": "case when k % 10 = 1 then 'ambiguous' when k % 4 = 1 then 'natural_user' when k % 4 = 2 then 'broad' else 'canonical' end",
    "parent_question_id": "case when k % 4 = 1 and k % 10 <> 1 then k - 1 end",
    "anchor": "k % 4 = 0 and k % 10 <> 1 and (k + 1) % 10 <> 1",
    "clarification_acceptable": "k % 10 > 1 and k % 43 = 0",
    "min_key_points": "case when k % 4 = 2 and k % 10 > 1 then 1 + k % 2 else 0 end",
    "required": "case when k % 10 > 1 then 1 + k % 4 else 0 end",
    "addressed": "case when k % 10 > 1 then least(1 + k % 4, (s // 3) % 6) else 0 end",
    "correct": "case when k % 10 > 1 then least(1 + k % 4, (s // 3) % 6, 1 + (s // 7) % 6) else 0 end",
    "false_claims": "case when s % 23 = 0 then 1 + s % 2 else 0 end",
    "unsupported": "case when s % 29 = 0 then 1 else 0 end",
    "extraneous": "case when s % 31 = 0 then 1 + s % 3 else 0 end",
    "retrieval_found": "case when k % 10 > 1 then least(1 + k % 4, (s // 5) % 6) else 0 end",
    "chunks_total": "s % 6",
    "chunks_relevant": "least(s % 6, s % 4)",
    "chunks_contradictory": "case when s % 19 = 0 then least(s % 6, 1) else 0 end",
    "answer_scope": "case s % 9 when 0 then 'too_much' when 1 then 'too_little' else 'complete' end",
    "incorrect_type": "case s % 17 when 0 then 'unrelated' when 1 then 'hallucination' else 'not_applicable' end",
    "demoted": "case when s % 61 = 0 then 1 else 0 end",
    "requires_verification": "case when s % 27 = 0 then 1 + s % 2 else 0 end",
    "claims_checked": "case when s % 25 = 0 then 1 + s % 3 else 0 end",
    "overturned_supports": "case when s % 50 = 0 then 1 else 0 end",
    "overturned_unrelated": "case when s % 75 = 0 then least(1, s % 3) else 0 end",
    "overturned_not_found": "case when s % 125 = 0 then least(1, s % 3) else 0 end",
    "verification_calls": "case when s % 25 = 0 then 1 else 0 end",
    "votes": "case when s % 33 = 0 then 2 else 0 end",
    "votes_disagree": "s % 66 = 0",
    "second_vote_calls": "case when s % 33 = 0 then 1 else 0 end",
    "second_vote_error": "case when s % 99 = 0 then 'no answer' else '' end",
    "is_abstention": "(k % 10 = 0 and s % 3 <> 0) or (k % 10 > 1 and s % 47 = 0)",
    "is_clarification": "(k % 10 = 1 and s % 2 = 0) or (k % 10 > 1 and s % 53 = 0 and s % 47 <> 0)",
    "retrieved_context": "case s % 11 when 0 then '' when 1 then '[]' when 2 then ' NULL ' else 'passage' end",
    "error_kind": "case when s % 37 = 0 then 'chatbot' when s % 41 = 0 then 'judge' end",
}
RUNS = {"A": ("k", "k % 89 <> 0"), "B": ("k + 7", "k % 97 <> 0")}


def eval_records(spark: SparkSession, d: str, run: str = "A") -> DataFrame:
    moved, kept = RUNS[run]
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    base = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).selectExpr("o_orderkey AS k", "c_mktsegment AS topic").where(kept).selectExpr("*", f"{moved} AS s")
    return base.selectExpr(*[f"{e.replace('//', 'div')} AS {c}" for c, e in COLUMNS.items()])


def eval_sql(run: str = "A", name: str = "ev") -> str:
    """A WITH member of the same rows."""
    moved, kept = RUNS[run]
    cols = ", ".join(f"{e} AS {c}" for c, e in COLUMNS.items())
    return f"{name} AS (SELECT {cols} FROM (SELECT k, topic, {moved} AS s FROM (SELECT o_orderkey AS k, c_mktsegment AS topic FROM orders JOIN customer ON o_custkey = c_custkey) WHERE {kept}))"
