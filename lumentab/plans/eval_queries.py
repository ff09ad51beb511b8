"""Report queries over the evaluation records, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, metrics, outcomes, validation
from .catalog import core
from .fixtures import eval_records, eval_sql

CASE = """
  CASE WHEN error_kind = 'chatbot' THEN 'chatbot_error'
       WHEN error_kind = 'judge' OR (is_abstention AND is_clarification) THEN 'judge_error'
       WHEN false_claims > 0 THEN 'misleading_hallucination'
       WHEN expected_behavior = 'clarify' AND is_clarification THEN 'correct_clarification'
       WHEN expected_behavior = 'clarify' THEN 'missing_clarification'
       WHEN clarification_acceptable AND is_clarification THEN 'correct_clarification'
       WHEN expected_behavior = 'answer' AND is_abstention THEN 'incorrect_abstention'
       WHEN expected_behavior = 'abstain' AND is_abstention THEN 'correct_abstention'
       WHEN expected_behavior = 'abstain' THEN 'should_have_abstained'
       WHEN is_clarification AND correct > 0 THEN 'partial_too_little'
       WHEN is_clarification THEN 'incorrect_abstention'
       WHEN incorrect_type = 'unrelated' AND correct = 0 THEN 'unrelated_answer'
       WHEN required > 0 AND correct >= CASE WHEN question_form = 'broad' AND min_key_points > 0 THEN least(min_key_points, required) ELSE required END
            AND (question_form = 'broad' OR answer_scope <> 'too_much') THEN 'correct_answer'
       WHEN correct > 0 OR (required > 0 AND correct >= CASE WHEN question_form = 'broad' AND min_key_points > 0 THEN least(min_key_points, required) ELSE required END)
            THEN CASE WHEN answer_scope = 'too_much' THEN 'partial_too_much' ELSE 'partial_too_little' END
       ELSE 'unrelated_answer' END"""
CONTEXT = "lower(trim(retrieved_context)) NOT IN ('', '[]', '{}', 'null', 'none', '[ ]', '{ }')"
GOOD = "(required > 0 AND retrieval_found = required AND chunks_contradictory = 0)"
E_ = "outcome NOT IN ('chatbot_error', 'judge_error')"
AVAILABLE = f"({E_} AND expected_behavior = 'answer' AND {CONTEXT})"
USEFUL = "outcome IN ('correct_answer', 'partial_too_little', 'partial_too_much', 'correct_clarification')"
PIPE = "outcome IN ('correct_answer', 'correct_abstention', 'correct_clarification')"
RISKY = "outcome IN ('misleading_hallucination', 'should_have_abstained', 'missing_clarification')"
BEHAVIOR = "outcome IN ('missing_clarification', 'incorrect_abstention', 'should_have_abstained')"
TASK = {x: f"({E_} AND expected_behavior = '{x}')" for x in ("answer", "clarify", "abstain")}
HEAD = "NOT anchor"  # questions that are asked for comparison only stand apart
RISK = "(false_claims > 0 OR unsupported > 0)"
METRICS = {
    "infrastructure_error_rate": ("true", f"NOT ({E_})"),
    "correct_answer_rate_on_answerable": (TASK["answer"], "outcome = 'correct_answer'"),
    "factual_answer_success_rate": (TASK["answer"], "outcome = 'correct_answer'"),
    "useful_answer_rate_on_answerable": (f"({E_} AND answerable)", USEFUL),
    "clarification_success_rate": (TASK["clarify"], "outcome = 'correct_clarification'"),
    "abstention_success_rate": (TASK["abstain"], "outcome = 'correct_abstention'"),
    "misinformation_rate": (E_, "outcome = 'misleading_hallucination'"),
    "risky_misinformation_rate": (E_, RISKY),
    "good_retrieval_rate": (AVAILABLE, GOOD),
    "factual_risk_rate": (E_, RISK),
    "requires_verification_rate": (E_, "requires_verification > 0"),
    "behavior_failure_rate": (E_, BEHAVIOR),
}
LOWER = {"misinformation_rate", "risky_misinformation_rate", "infrastructure_error_rate", "factual_risk_rate", "behavior_failure_rate"}
COMPARED = [m for m in METRICS if m not in ("correct_answer_rate_on_answerable", "requires_verification_rate")]
_N = lambda cond: f"count(*) FILTER ({HEAD} AND {cond})"
_S = lambda x, cond: f"coalesce(sum({x}) FILTER ({HEAD} AND {cond}), 0)"
_GOOD, _ANS = f"({AVAILABLE} AND {GOOD})", TASK["answer"]
_OVER = "(overturned_supports + overturned_unrelated + overturned_not_found)"
COUNTS = {
    "total": f"count(*) FILTER ({HEAD})", "evaluable": _N(E_), "answerable_questions": _N(f"{E_} AND answerable"), "unanswerable_questions": _N(f"{E_} AND NOT answerable"), "answer_tasks": _N(_ANS),
    "clarification_tasks": _N(TASK["clarify"]), "abstention_tasks": _N(TASK["abstain"]), "infrastructure_errors": _N(f"NOT ({E_})"), "anchor_records": "count(*) FILTER (anchor)",
    "correct_answer_count": _N(f"{_ANS} AND outcome = 'correct_answer'"), "factual_answer_success_count": _N(f"{_ANS} AND outcome = 'correct_answer'"), "factual_answer_success_denominator": _N(_ANS),
    "useful_answer_count": _N(f"{E_} AND answerable AND {USEFUL}"), "useful_answer_denominator": _N(f"{E_} AND answerable"), "clarification_success_count": _N(f"{TASK['clarify']} AND outcome = 'correct_clarification'"),
    "abstention_success_count": _N(f"{TASK['abstain']} AND outcome = 'correct_abstention'"), "misinformation_count": _N("outcome = 'misleading_hallucination'"), "misinformation_denominator": _N(E_),
    "retrieval_evaluated": _N(AVAILABLE), "good_retrieval_count": _N(_GOOD), "pipeline_evaluable": _N(_ANS),
    "generation_failures_despite_good_retrieval": _N(f"{_GOOD} AND NOT ({USEFUL}) AND NOT ({PIPE})"), "generation_partials_despite_good_retrieval": _N(f"{_GOOD} AND {USEFUL} AND NOT ({PIPE})"),
    "pipeline.retrieval_unavailable": _N(f"{_ANS} AND NOT ({CONTEXT})"), "pipeline.retrieval_good_answer_good": _N(f"{_GOOD} AND {PIPE}"), "pipeline.retrieval_good_answer_poor": _N(f"{_GOOD} AND NOT ({PIPE})"),
    "pipeline.retrieval_poor_answer_good": _N(f"{AVAILABLE} AND NOT {GOOD} AND {PIPE}"), "pipeline.retrieval_poor_answer_poor": _N(f"{AVAILABLE} AND NOT {GOOD} AND NOT ({PIPE})"),
    "factual_risk_count": _N(f"{E_} AND {RISK}"), "factual_risk_denominator": _N(E_), "behavior_failure_count": _N(BEHAVIOR), "behavior_failure_denominator": _N(E_),
    "requires_verification_count": _N(f"{E_} AND requires_verification > 0"), "requires_verification_denominator": _N(E_), "requires_verification_values_total": _S("requires_verification", E_),
    "false_claim_verification_calls": _S("verification_calls", E_), "second_vote_rows": _N(f"{E_} AND votes > 0"), "second_vote_calls": _S("second_vote_calls", E_), "second_vote_errors": _N(f"{E_} AND second_vote_error <> ''"),
    "votes_disagree_count": _N(f"{E_} AND votes > 0 AND votes_disagree"), "false_claims_checked": _S("claims_checked", E_), "false_claims_confirmed": _S(f"claims_checked - {_OVER}", E_), "false_claims_overturned": _S(_OVER, E_),
    "false_claims_overturned.supports": _S("overturned_supports", E_), "false_claims_overturned.unrelated": _S("overturned_unrelated", E_), "false_claims_overturned.quote_not_found": _S("overturned_not_found", E_),
    "all_response_claim_violations.scored_responses": _N(E_), "all_response_claim_violations.responses_with_violations": _N(f"{E_} AND {RISK}"),
    "all_response_claim_violations.false_claims_total": _S("false_claims", E_), "all_response_claim_violations.unsupported_claims_total": _S("unsupported", E_),
    **{f"answer_claim_metrics.{k}_total": _S(c, _ANS) for k, c in (("required_points", "required"), ("addressed_points", "addressed"), ("correct_points", "correct"), ("false_claims", "false_claims"), ("unsupported_claims", "unsupported"), ("extraneous_claims", "extraneous"))},
    **{f"retrieval_claim_metrics.{k}_total": _S(c, AVAILABLE) for k, c in (("required_points", "required"), ("points_found", "retrieval_found"), ("chunks", "chunks_total"), ("relevant_chunks", "chunks_relevant"), ("irrelevant_chunks", "chunks_total - chunks_relevant"), ("contradictory_chunks", "chunks_contradictory"))},
}
RATIOS = {
    "answer_claim_metrics.required_point_coverage": (_S("correct", _ANS), _S("required", _ANS)), "answer_claim_metrics.addressed_point_accuracy": (_S("correct", _ANS), _S("addressed", _ANS)),
    **{f"answer_claim_metrics.{k}_claims_per_answer": (_S(c, _ANS), _N(_ANS)) for k, c in (("false", "false_claims"), ("unsupported", "unsupported"), ("extraneous", "extraneous"))},
    "retrieval_claim_metrics.required_point_coverage": (_S("retrieval_found", AVAILABLE), _S("required", AVAILABLE)), "retrieval_claim_metrics.relevant_chunk_rate": (_S("chunks_relevant", AVAILABLE), _S("chunks_total", AVAILABLE)),
    "retrieval_claim_metrics.contradictory_chunk_rate": (_S("chunks_contradictory", AVAILABLE), _S("chunks_total", AVAILABLE)),
}


def out_sql(run: str = "A", name: str = "o") -> str:
    return f"{eval_sql(run, 'ev_' + name)}, {name} AS (SELECT *, {CASE} AS outcome FROM ev_{name})"


def wilson_sql(k: str, n: str) -> str:
    z = 1.96
    mid = f"({k}::double / {n} + {z * z} / (2 * {n}))"
    half = f"{z} * sqrt((({k}::double / {n}) * (1 - {k}::double / {n}) + {z * z} / (4 * {n})) / {n})"
    return f"CASE WHEN {n} > 0 THEN round(greatest(0.0, ({mid} - {half}) / (1 + {z * z} / {n})), 6) END AS low, CASE WHEN {n} > 0 THEN round(least(1.0, ({mid} + {half}) / (1 + {z * z} / {n})), 6) END AS high"


def rate_sql(k: str, n: str, name: str = "rate") -> str:
    return f"CASE WHEN {n} <> 0 THEN round(({k})::double / {n}, 6) END AS {name}"


def rates_sql(keys: str) -> str:
    parts = " UNION ALL ".join(f"SELECT {keys}, '{m}' AS metric, count(*) FILTER ({p} AND {h}) AS numerator, count(*) FILTER ({p}) AS denominator FROM o WHERE {HEAD} GROUP BY {keys}" for m, (p, h) in METRICS.items())
    return f"WITH {out_sql()}, m AS ({parts}) SELECT {keys}, metric, numerator, denominator, {rate_sql('numerator', 'denominator')}, {wilson_sql('numerator', 'denominator')} FROM m"


def summary_sql() -> str:
    rows = [f"SELECT '{m}' AS entry, 1 AS kind, count(*) FILTER ({HEAD} AND {p} AND {h}) AS n, count(*) FILTER ({HEAD} AND {p}) AS d FROM o" for m, (p, h) in METRICS.items()]
    rows += [f"SELECT '{k}', 0, {v}, NULL FROM o" for k, v in COUNTS.items()] + [f"SELECT '{k}', 2, {a}, {b} FROM o" for k, (a, b) in RATIOS.items()]
    return f"""WITH {out_sql()}, m AS ({' UNION ALL '.join(rows)}), w AS (SELECT *, {wilson_sql('n', 'd')} FROM m)
    SELECT entry, CASE WHEN kind = 0 THEN n::double WHEN d <> 0 THEN round(n::double / d, 6) END AS value, CASE WHEN kind > 0 THEN n::bigint END AS numerator, d::bigint AS denominator,
    CASE WHEN kind = 1 THEN low END AS low, CASE WHEN kind = 1 THEN high END AS high FROM w"""


TOPIC = "CASE WHEN topic = '' THEN 'לא סווג' ELSE topic END"


@core.query(f"WITH {out_sql()} SELECT question_id, topic, outcome FROM o")
def outcome_classify(spark, d):
    return outcomes.classified(eval_records(spark, d)).select("question_id", "topic", "outcome")


@core.query(f"WITH {out_sql()}, h AS (SELECT * FROM o WHERE {HEAD}) SELECT 'all' AS scope, outcome, count(*) AS n FROM h GROUP BY outcome UNION ALL SELECT {TOPIC}, outcome, count(*) FROM h GROUP BY 1, 2")
def outcome_histogram(spark, d):
    return metrics.outcome_histogram(eval_records(spark, d))


@core.query(summary_sql())
def run_summary_long(spark, d):
    """Every number of a run's summary: counts, rates with intervals, sums and ratios."""
    return metrics.run_summary(eval_records(spark, d))


@core.query(rates_sql("topic"))
def topic_summary_long(spark, d):
    return metrics.rate_summary(eval_records(spark, d), ["topic"])


@core.query(
    f"""WITH {out_sql()}, h AS (SELECT * FROM o WHERE {HEAD}) SELECT 'generation_failures' AS list, question_id FROM h WHERE {_GOOD} AND NOT ({USEFUL}) AND NOT ({PIPE}) UNION ALL SELECT 'generation_partials', question_id FROM h WHERE {_GOOD} AND {USEFUL} AND NOT ({PIPE})
    UNION ALL SELECT 'requires_verification', question_id FROM h WHERE {E_} AND requires_verification > 0 UNION ALL SELECT 'votes_disagree', question_id FROM h WHERE {E_} AND votes > 0 AND votes_disagree
    UNION ALL SELECT 'false_claims_overturned', question_id FROM h WHERE {E_} AND {_OVER} > 0"""
)
def flagged_questions(spark, d):
    """The questions behind the counts of the summary that name them."""
    return metrics.flagged_questions(eval_records(spark, d))


_TOPIC_RATES = (("correct", "answer_tasks"), ("useful", "answerable_questions"), ("misinformation", "evaluable"), ("risky", "evaluable"), ("good_retrieval", "retrieval_evaluated"))


@core.query(
    f"""WITH {out_sql()}, t AS (SELECT {TOPIC} AS topic, count(*) AS total, count(*) FILTER ({E_}) AS evaluable, count(*) FILTER ({AVAILABLE}) AS retrieval_evaluated, count(*) FILTER ({_ANS}) AS answer_tasks, count(*) FILTER ({E_} AND answerable) AS answerable_questions,
    count(*) FILTER (outcome = 'correct_answer') AS correct, count(*) FILTER ({USEFUL}) AS useful, count(*) FILTER (outcome = 'misleading_hallucination') AS misinformation, count(*) FILTER ({RISKY}) AS risky, count(*) FILTER ({_GOOD}) AS good_retrieval FROM o WHERE {HEAD} GROUP BY 1)
    SELECT *, """
    + ", ".join(f"{rate_sql(a, b, a + '_rate')}, {wilson_sql(a, b).replace('AS low', f'AS {a}_low').replace('AS high', f'AS {a}_high')}" for a, b in _TOPIC_RATES)
    + ", evaluable < 10 AS small_sample FROM t"
)
def topic_breakdown(spark, d):
    return metrics.topic_breakdown(eval_records(spark, d))


@core.query(
    f"""WITH {out_sql()}, e AS (SELECT *, {AVAILABLE} AS av FROM o WHERE {E_} AND {HEAD}), s AS (SELECT
    sum(addressed) FILTER (expected_behavior = 'answer') AS ad, sum(required) FILTER (expected_behavior = 'answer') AS rq, sum(correct) FILTER (expected_behavior = 'answer') AS co,
    sum(retrieval_found) FILTER (av) AS rf, sum(required) FILTER (av) AS rr, sum(chunks_relevant) FILTER (av) AS cr, sum(chunks_total) FILTER (av) AS ct, sum(chunks_contradictory) FILTER (av) AS cc FROM e),
    m AS (SELECT 'claim_coverage' AS metric, ad AS numerator, rq AS denominator FROM s UNION ALL SELECT 'claim_accuracy', co, ad FROM s UNION ALL SELECT 'claim_success', co, rq FROM s
    UNION ALL SELECT 'retrieval_coverage', rf, rr FROM s UNION ALL SELECT 'passage_relevance', cr, ct FROM s UNION ALL SELECT 'passage_contradiction', cc, ct FROM s)
    SELECT metric, numerator::bigint AS numerator, denominator::bigint AS denominator, {rate_sql('numerator', 'denominator')} FROM m"""
)
def claim_metrics(spark, d):
    return metrics.claim_metrics(eval_records(spark, d))


@core.query(
    f"""WITH {out_sql()} SELECT CASE WHEN NOT ({CONTEXT}) THEN 'unavailable' WHEN {GOOD} THEN 'good' ELSE 'poor' END AS retrieval,
    CASE WHEN {PIPE} THEN 'good' ELSE 'poor' END AS answer, count(*) AS n FROM o WHERE {E_} AND {HEAD} AND expected_behavior = 'answer' GROUP BY 1, 2"""
)
def pipeline_crosstab(spark, d):
    return metrics.pipeline_crosstab(eval_records(spark, d))


@core.query(f"WITH {out_sql()}, f AS (SELECT question_form, count(*) AS evaluable, count(*) FILTER ({PIPE}) AS successes FROM o WHERE {E_} AND {HEAD} GROUP BY 1) SELECT *, {rate_sql('successes', 'evaluable')} FROM f")
def by_form(spark, d):
    return metrics.by_form(eval_records(spark, d))


@core.query(
    f"""WITH {out_sql()}, e AS (SELECT question_id, parent_question_id, question_form, {PIPE} AS ok FROM o WHERE {E_}),
    p AS (SELECT c.question_form, c.ok AS c, x.ok AS p FROM e c JOIN e x ON c.parent_question_id = x.question_id),
    g AS (SELECT f AS form, count(*) AS pairs, count(*) FILTER (p AND c) AS both_success, count(*) FILTER (p AND NOT c) AS parent_only, count(*) FILTER (NOT p AND c) AS variant_only, count(*) FILTER (NOT p AND NOT c) AS both_failure
    FROM (SELECT 'all' AS f, p, c FROM p UNION ALL SELECT question_form, p, c FROM p) GROUP BY f)
    SELECT *, {rate_sql('both_success', '(both_success + parent_only)', 'robustness')}, {rate_sql('parent_only - variant_only', 'pairs', 'degradation')} FROM g"""
)
def paired_variants(spark, d):
    return metrics.paired_variants(eval_records(spark, d))


@core.query(
    f"""WITH {out_sql()}, e AS (SELECT *, {PIPE} AS ok FROM o WHERE {E_}), g AS (SELECT count(*) AS pairs, count(*) FILTER (a.ok) AS anchor_successes, count(*) FILTER (n.ok) AS natural_successes
    FROM e a JOIN e n ON n.parent_question_id = a.question_id WHERE a.anchor AND n.question_form = 'natural_user')
    SELECT *, {rate_sql('anchor_successes', 'pairs', 'anchor_rate')}, {rate_sql('natural_successes', 'pairs', 'natural_rate')}, {rate_sql('anchor_successes - natural_successes', 'pairs', 'gap')} FROM g"""
)
def phrasing_gap(spark, d):
    return metrics.phrasing_gap(eval_records(spark, d))


# texts are the same question whatever their case and blanks
_same = lambda m: f"lower(trim(regexp_replace(p.{m}::varchar, '\\s+', ' ', 'g'))) IS NOT DISTINCT FROM lower(trim(regexp_replace(c.{m}::varchar, '\\s+', ' ', 'g')))"
_MAT = "(" + " AND ".join(map(_same, ("topic", "expected_behavior", "answerable", "question_form", "parent_question_id", "anchor", "clarification_acceptable", "required", "min_key_points"))) + ")"
_FLAG = ", ".join(f"CASE WHEN {HEAD} AND {METRICS[m][0]} THEN ({METRICS[m][1]})::int END AS {m}" for m in COMPARED)
TWO = f"{out_sql('A', 'oa')}, {out_sql('B', 'ob')}, fp AS (SELECT *, {_FLAG} FROM oa), fc AS (SELECT *, {_FLAG} FROM ob)"
# from the mildest to the most severe
SEV = "CASE {0} WHEN 'correct_answer' THEN 0 WHEN 'correct_abstention' THEN 0 WHEN 'correct_clarification' THEN 0 WHEN 'partial_too_much' THEN 1 WHEN 'partial_too_little' THEN 2 WHEN 'unrelated_answer' THEN 3 WHEN 'incorrect_abstention' THEN 4 WHEN 'missing_clarification' THEN 5 WHEN 'should_have_abstained' THEN 6 WHEN 'misleading_hallucination' THEN 7 END"
_A, _B = PIPE.replace("outcome", "a"), PIPE.replace("outcome", "b")
TRANS = f"""WITH {TWO}, x AS (SELECT c.topic, p.outcome AS a, c.outcome AS b FROM fp p JOIN fc c ON p.question_id = c.question_id AND {_MAT}),
    y AS (SELECT *, CASE WHEN a IN ('chatbot_error', 'judge_error') OR b IN ('chatbot_error', 'judge_error') THEN 'not_comparable' WHEN {_B} AND NOT {_A} THEN 'improved' WHEN {_A} AND NOT {_B} THEN 'regressed' WHEN {_B} THEN 'unchanged_success' ELSE 'unchanged_failure' END AS state FROM x)"""


def comparison_sql(two: str = TWO) -> str:
    rows = " UNION ALL ".join(f"SELECT '{m}' AS metric, {str(m in LOWER).lower()} AS lower, p.question_id IS NOT NULL AND c.question_id IS NOT NULL AND {_MAT} AS same, p.{m} AS a, c.{m} AS b FROM fp p FULL JOIN fc c ON p.question_id = c.question_id" for m in COMPARED)
    whole = lambda t, x: " UNION ALL ".join(f"SELECT '{m}' AS metric, coalesce(sum({m}), 0)::bigint AS {x}_numerator, count({m}) AS {x}_denominator, count(*) - count({m}) AS {x}_excluded FROM {t}" for m in COMPARED)
    good = lambda d: f"CASE WHEN {d} <> 0 THEN CASE WHEN lower THEN {d} < 0 ELSE {d} > 0 END END"
    return f"""WITH {two}, r AS ({rows}), g AS (SELECT metric, any_value(lower) AS lower, count(*) FILTER (same AND a IS NOT NULL AND b IS NOT NULL) AS soft_denominator, coalesce(sum(a) FILTER (same AND a IS NOT NULL AND b IS NOT NULL), 0)::bigint AS soft_previous_numerator,
    coalesce(sum(b) FILTER (same AND a IS NOT NULL AND b IS NOT NULL), 0)::bigint AS soft_current_numerator, count(*) FILTER ((a IS NULL) <> (b IS NULL)) AS odd, count(*) FILTER (NOT same) AS unmatched FROM r GROUP BY 1),
    wp AS ({whole('fp', 'previous')}), wc AS ({whole('fc', 'current')}), j AS (SELECT *, CASE WHEN unmatched > 0 THEN 'benchmark_identity_changed' WHEN odd > 0 THEN 'eligible_population_changed' END AS reason FROM g JOIN wp USING (metric) JOIN wc USING (metric)),
    z AS (SELECT *, {rate_sql('previous_numerator', 'previous_denominator', 'previous')}, {rate_sql('current_numerator', 'current_denominator', 'current')}, {rate_sql('soft_previous_numerator', 'soft_denominator', 'soft_previous')}, {rate_sql('soft_current_numerator', 'soft_denominator', 'soft_current')},
    {rate_sql('soft_current_numerator - soft_previous_numerator', 'soft_denominator', 'soft_delta')}, CASE WHEN reason IS NULL AND previous_denominator > 0 AND current_denominator > 0 THEN round(current_numerator::double / current_denominator - previous_numerator::double / previous_denominator, 6) END AS delta FROM j)
    SELECT metric, reason, previous_numerator, previous_denominator, previous_excluded, current_numerator, current_denominator, current_excluded, previous, current, delta, {good('delta')} AS favorable, soft_denominator, soft_previous_numerator, soft_current_numerator,
    soft_previous, soft_current, soft_delta, {good('soft_delta')} AS soft_favorable FROM z"""


@core.query(comparison_sql())
def run_comparison_metrics(spark, d):
    """Two runs that differ in their questions: only the matched ones are compared."""
    return compare.comparison_metrics(eval_records(spark, d, "A"), eval_records(spark, d, "B"))


_SHARED = "question_id % 89 <> 0 AND question_id % 97 <> 0 AND question_id % 211 <> 0"


@core.query(comparison_sql(TWO.replace("fp AS (SELECT *, ", f"fp0 AS (SELECT * FROM oa WHERE {_SHARED}), fc0 AS (SELECT * FROM ob WHERE {_SHARED}), fp AS (SELECT *, ").replace("FROM oa), fc", "FROM fp0), fc").replace("FROM ob)", "FROM fc0)")))
def run_comparison_same(spark, d):
    """The same of the questions that both runs have unchanged: the rates with one population have a difference."""
    return compare.comparison_metrics(*[eval_records(spark, d, r).where(_SHARED) for r in "AB"])


@core.query(f"{TRANS} SELECT a || '->' || b AS transition, state, count(*) AS n FROM y GROUP BY 1, 2")
def state_transitions(spark, d):
    return compare.state_transitions(eval_records(spark, d, "A"), eval_records(spark, d, "B"))


@core.query(
    f"""{TRANS} SELECT {TOPIC} AS topic, {', '.join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ('improved', 'regressed', 'unchanged_success', 'unchanged_failure', 'not_comparable'))}, count(*) AS total,
    count(*) FILTER (state = 'improved') - count(*) FILTER (state = 'regressed') AS net_improvement FROM y GROUP BY 1"""
)
def topic_transitions(spark, d):
    return compare.state_transitions(eval_records(spark, d, "A"), eval_records(spark, d, "B"), by_topic=True)


@core.query(
    f"""WITH {eval_sql('A', 'p')}, {eval_sql('B', 'c')} SELECT CASE WHEN p.question_id IS NULL THEN 'current_only' WHEN c.question_id IS NULL THEN 'previous_only' WHEN {_MAT} THEN 'matched' ELSE 'changed' END AS status, count(*) AS n
    FROM p FULL JOIN c ON p.question_id = c.question_id GROUP BY 1"""
)
def run_match_report(spark, d):
    return compare.match_report(eval_records(spark, d, "A"), eval_records(spark, d, "B"))


_LISTED = "(required + CASE WHEN question_id % 13 = 0 THEN 1 ELSE 0 END)"  # every thirteenth row has a claim too many
_FOUND = "(retrieval_found + CASE WHEN question_id % 19 = 0 THEN 5 ELSE 0 END)"  # and in every nineteenth more is found than there is


@core.query(
    f"""WITH {eval_sql()}, x AS (SELECT *, CASE WHEN expected_behavior <> 'answer' THEN CASE WHEN {_LISTED} > 0 THEN 'claims_of_non_answer' END WHEN {_LISTED} <> required THEN 'claim_ids' WHEN {_FOUND} > required THEN 'found_above_claims' END AS fault FROM ev),
    n AS (SELECT question_id AS q, count(*) FILTER ((question_id + i) % 3 <> 0) AS addressed, count(*) FILTER ((question_id + i) % 3 = 1) AS correct FROM x, generate_series(1, 5) g(i) WHERE i <= required GROUP BY 1)
    SELECT question_id, fault, CASE WHEN fault IS NULL THEN required::bigint END AS required, CASE WHEN fault IS NULL THEN coalesce(n.addressed, 0) END AS addressed, CASE WHEN fault IS NULL THEN coalesce(n.correct, 0) END AS correct,
    CASE WHEN fault IS NULL THEN CASE WHEN expected_behavior = 'answer' THEN {_FOUND}::bigint ELSE 0 END END AS retrieval_found FROM x LEFT JOIN n ON question_id = q"""
)
def claim_recount(spark, d):
    ev = eval_records(spark, d)
    k = F.col("question_id")
    n = F.expr(_LISTED)
    claim = lambda i: F.struct(F.format_string("C%03d", i).alias("id"), ((k + i) % 3 != 0).alias("addressed"), ((k + i) % 3 == 1).alias("correct"))
    made = F.when(n > 0, F.reverse(F.transform(F.sequence(F.lit(1), n.cast("int")), claim))).otherwise(F.transform(F.array().cast("array<int>"), claim))
    return outcomes.recount_claims(ev.withColumn("assessments", made).withColumn("retrieval_found", F.expr(_FOUND))).select("question_id", "fault", "required", "addressed", "correct", "retrieval_found")


@core.query(
    f"""WITH {eval_sql()}, c AS (SELECT *, question_id % 4 AS listed, (SELECT count(*) FROM generate_series(1, question_id % 4) g(i) WHERE (question_id + i) % 3 <> 0) AS cited FROM ev)
    SELECT question_id, cited AS false_claims, (greatest(false_claims, listed) - cited)::bigint AS demoted, (unsupported + greatest(false_claims, listed) - cited)::bigint AS unsupported,
    CASE WHEN incorrect_type = 'hallucination' AND cited = 0 THEN CASE WHEN correct = 0 THEN 'unrelated' ELSE 'not_applicable' END ELSE incorrect_type END AS incorrect_type FROM c"""
)
def false_claim_reconcile(spark, d):
    ev = eval_records(spark, d)
    k = F.col("question_id")
    claim = lambda i: F.struct(F.when((k + i) % 3 != 0, F.lit("quoted")).otherwise(F.lit("  ")).alias("evidence"))
    made = F.when(k % 4 > 0, F.transform(F.sequence(F.lit(1), (k % 4).cast("int")), claim)).otherwise(F.transform(F.array().cast("array<int>"), claim))
    out = outcomes.reconcile_false_claims(ev.withColumn("claims", made))
    return out.select("question_id", F.col("false_claims").cast("bigint"), F.col("demoted").cast("bigint"), F.col("unsupported").cast("bigint"), "incorrect_type")


@core.query(
    f"""WITH {out_sql('A', 'oa')}, {out_sql('B', 'ob')} SELECT p.question_id, p.outcome AS first, c.outcome AS second,
    CASE WHEN {SEV.format('c.outcome')} > {SEV.format('p.outcome')} THEN c.outcome ELSE p.outcome END AS harsher, CASE WHEN {SEV.format('c.outcome')} < {SEV.format('p.outcome')} THEN c.outcome ELSE p.outcome END AS lenient
    FROM oa p LEFT JOIN ob c ON p.question_id = c.question_id"""
)
def second_vote(spark, d):
    a, b = (outcomes.classified(eval_records(spark, d, r)).select("question_id", F.col("outcome").alias(n)) for r, n in (("A", "first"), ("B", "second")))
    return a.join(b, "question_id", "left").select("question_id", "first", "second", outcomes.second_vote(F.col("first"), F.col("second")).alias("harsher"), outcomes.second_vote(F.col("first"), F.col("second"), False).alias("lenient"))


@core.query(f"WITH {out_sql()} SELECT question_id FROM o WHERE {E_} AND (false_claims > 0 OR demoted > 0 OR requires_verification > 0 OR overturned_supports > 0 OR overturned_unrelated > 0 OR overturned_not_found > 0 OR outcome IN ('misleading_hallucination', 'unrelated_answer'))")
def second_vote_rows(spark, d):
    return outcomes.classified(eval_records(spark, d)).where(outcomes.needs_second_vote()).select("question_id")


@core.query(
    """SELECT l_orderkey AS question_id, count(*) FILTER (l_quantity >= 5 AND l_returnflag = 'N') AS kept, count(*) FILTER (l_quantity >= 5 AND l_returnflag = 'A') AS removed,
    count(*) FILTER (l_quantity < 5 OR l_returnflag = 'R') AS demoted FROM lineitem GROUP BY 1"""
)
def second_pass(spark, d):
    from ..session import table

    claims = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question_id"), (F.col("l_quantity") >= 5).alias("located"), F.when(F.col("l_returnflag") == "A", "supports").when(F.col("l_returnflag") == "R", "unrelated").otherwise("contradicts").alias("verdict"))
    return outcomes.second_pass(claims)


@core.query(
    f"""WITH {eval_sql()}, v AS (SELECT *, correct > addressed AS r1, addressed > required AS r2, retrieval_found > required AS r3, chunks_relevant > chunks_total OR chunks_contradictory > chunks_total AS r4,
    anchor AND question_form <> 'canonical' AS r5, question_form = 'broad' AND expected_behavior <> 'answer' AS r6, expected_behavior = 'clarify' AND question_form <> 'ambiguous' AS r7, is_abstention AND is_clarification AS r8 FROM ev)
    SELECT rule, count(*) AS n FROM (SELECT 'correct_above_addressed' AS rule FROM v WHERE r1 UNION ALL SELECT 'addressed_above_required' FROM v WHERE r2 UNION ALL SELECT 'found_above_required' FROM v WHERE r3 UNION ALL SELECT 'passages_above_total' FROM v WHERE r4
    UNION ALL SELECT 'anchor_not_canonical' FROM v WHERE r5 UNION ALL SELECT 'broad_not_answer' FROM v WHERE r6 UNION ALL SELECT 'clarify_not_ambiguous' FROM v WHERE r7 UNION ALL SELECT 'both_flags' FROM v WHERE r8) GROUP BY 1"""
)
def invariant_violations(spark, d):
    return validation.invariant_violations(eval_records(spark, d)).groupBy("rule").agg(F.count("*").alias("n"))
