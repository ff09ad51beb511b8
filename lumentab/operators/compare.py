"""Two runs like for like: matched questions, metrics on shared populations, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import rate
from .metrics import COMPARED, ERRORS, PIPELINE, in_headline, metric_predicates, topic_of
from .outcomes import classified

#: What isn't part of a question as such; all its other fields must be equal in both runs for it to be the same one.
NOT_MATERIAL = ("review_status", "reviewer_notes")
#: The fields of a question among those of an evaluation record.
MATERIAL = ("topic", "expected_behavior", "answerable", "question_form", "parent_question_id", "anchor", "clarification_acceptable", "required", "min_key_points")


def normalized(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c.cast("string"), r"\s+", " ")))


def unique_ids(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not repeated; one shuffle on the key, which the join after it uses too."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where("_n = 1").drop("_n")


def matched_runs(previous: DataFrame, current: DataFrame, key: str = "question_id", material: tuple[str, ...] = MATERIAL) -> DataFrame:
    """(key, side, same, p, c): full outer match of the keys that are unique on both sides; same where all material fields agree."""
    own = lambda df, name: unique_ids(df, key).select(key, F.struct(*[x for x in df.columns if x != key]).alias(name))
    both = own(previous, "p").join(own(current, "c"), key, "full_outer")
    same = F.lit(True)
    for m in material:
        same = same & normalized(F.col(f"p.{m}")).eqNullSafe(normalized(F.col(f"c.{m}")))
    side = F.when(F.col("p").isNull(), "current_only").when(F.col("c").isNull(), "previous_only").otherwise("both")
    return both.select(key, side.alias("side"), ((side == "both") & same).alias("same"), "p", "c")


def match_report(previous: DataFrame, current: DataFrame, key: str = "question_id") -> DataFrame:
    """(status, n): matched, changed, previous_only, current_only, and ids that are repeated in a run."""
    m = matched_runs(previous, current, key)
    one = m.groupBy(F.when(F.col("side") == "both", F.when(F.col("same"), "matched").otherwise("changed")).otherwise(F.col("side")).alias("status")).agg(F.count("*").alias("n"))
    again = [df.groupBy(key).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit(name).alias("status"), "n").where("n > 0") for df, name in ((previous, "previous_duplicates"), (current, "current_duplicates"))]
    return one.unionByName(again[0]).unionByName(again[1])


def _flags(records: DataFrame, canonical_scoring: str = "gap") -> DataFrame:
    """Of each record its question, outcome, and one flag for each compared rate: whether it hits, null outside the population
    or the headline scope. Nothing else of it goes through the match."""
    scope, predicates = in_headline(canonical_scoring), metric_predicates()
    flags = [F.when(scope & predicates[name][0], predicates[name][1].cast("int")).alias(name) for name in COMPARED]
    return classified(records).select("question_id", *MATERIAL, "outcome", *flags)


def comparison_metrics(previous: DataFrame, current: DataFrame, canonical_scoring: str = "gap") -> DataFrame:
    """One row for each compared rate: its value in both runs, and like for like on the matched questions (soft_).

    The difference of the whole runs (delta) exists only where the runs have the same questions, each once and unchanged, and
    the rate the same population in both; reason says which of the two fails. favorable: whether the difference is for the better.
    """
    p, c = _flags(previous, canonical_scoring), _flags(current, canonical_scoring)
    m = matched_runs(p, c)
    names = list(COMPARED)
    flags = lambda side: F.array(*[F.col(f"{side}.{n}") for n in names])
    rows = m.select("side", "same", F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("metric"), flags("p").alias("a"), flags("c").alias("b"))).alias("x")).select("side", "same", "x.*")
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    both = F.col("same") & a & b
    one = rows.groupBy("metric").agg(
        F.count_if(both).alias("soft_denominator"), F.coalesce(F.sum(F.when(both, F.col("a"))), F.lit(0)).alias("soft_previous_numerator"), F.coalesce(F.sum(F.when(both, F.col("b"))), F.lit(0)).alias("soft_current_numerator"),
        F.count_if(a != b).alias("odd"), F.count_if(~F.col("same")).alias("unmatched"),
    )

    def whole(df: DataFrame, side: str) -> DataFrame:
        longer = df.select(F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("metric"), F.array(*[F.col(n) for n in names]).alias("x"))).alias("x")).select("x.*")
        return longer.groupBy("metric").agg(F.coalesce(F.sum("x"), F.lit(0)).alias(f"{side}_numerator"), F.count("x").alias(f"{side}_denominator"), F.count_if(F.col("x").isNull()).alias(f"{side}_excluded"))

    again = p.groupBy("question_id").count().unionByName(c.groupBy("question_id").count()).agg(F.count_if(F.col("count") > 1).alias("repeated"))
    out = one.join(whole(p, "previous"), "metric").join(whole(c, "current"), "metric").crossJoin(F.broadcast(again))
    for side in ("previous", "current", "soft_previous", "soft_current"):
        out = out.withColumn(side, rate(F.col(f"{side}_numerator"), F.col("soft_denominator" if side.startswith("soft") else f"{side}_denominator")))
    known = (F.col("unmatched") == 0) & (F.col("repeated") == 0)
    out = out.withColumn("reason", F.when(~known, "benchmark_identity_changed").when(F.col("odd") > 0, "eligible_population_changed"))
    # differences of the rates themselves, not of the rounded ones
    exact = lambda side, of: F.try_divide(F.col(f"{side}_numerator").cast("double"), F.col(of))
    out = out.withColumn("delta", F.when(F.col("reason").isNull(), F.round(exact("current", "current_denominator") - exact("previous", "previous_denominator"), 6)))
    out = out.withColumn("soft_delta", rate(F.col("soft_current_numerator") - F.col("soft_previous_numerator"), F.col("soft_denominator")))
    lower = F.try_element_at(F.create_map(*[F.lit(x) for kv in COMPARED.items() for x in kv]), F.col("metric"))
    better = lambda d: F.when(F.col(d) != 0, F.when(lower, F.col(d) < 0).otherwise(F.col(d) > 0))
    return out.select(
        "metric", "reason", *[f"{s}_{x}" for s in ("previous", "current") for x in ("numerator", "denominator", "excluded")], "previous", "current", "delta", better("delta").alias("favorable"),
        "soft_denominator", "soft_previous_numerator", "soft_current_numerator", "soft_previous", "soft_current", "soft_delta", better("soft_delta").alias("soft_favorable"),
    )


STATES = ("improved", "regressed", "unchanged_success", "unchanged_failure", "not_comparable")


def state_of(before: Column, after: Column) -> Column:
    """Of a question's two outcomes, by whether they are a success of the pipeline; errors can't be compared."""
    was, now = before.isin(*PIPELINE), after.isin(*PIPELINE)
    changed = F.when(now & ~was, "improved").when(was & ~now, "regressed").when(now, "unchanged_success").otherwise("unchanged_failure")
    return F.when(before.isin(*ERRORS) | after.isin(*ERRORS), "not_comparable").otherwise(changed)


def state_transitions(previous: DataFrame, current: DataFrame, by_topic: bool = False) -> DataFrame:
    """(transition, state, n), or (topic, one count for each state, net_improvement, total), over all matched questions."""
    own = lambda df: classified(df).select("question_id", *MATERIAL, "outcome")
    m = matched_runs(own(previous), own(current)).where("same")
    rows = m.select(F.col("c.topic").alias("topic"), F.col("p.outcome").alias("a"), F.col("c.outcome").alias("b")).withColumn("state", state_of(F.col("a"), F.col("b")))
    if not by_topic:
        return rows.groupBy(F.concat_ws("->", "a", "b").alias("transition"), "state").agg(F.count("*").alias("n"))
    counts = rows.groupBy(topic_of().alias("topic")).agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES], F.count("*").alias("total"))
    return counts.withColumn("net_improvement", F.col("improved") - F.col("regressed"))


def contract_diff(previous: dict, current: dict) -> list[str]:
    """Paths of the fields in which two nested contracts differ; values are not shown."""

    def flat(x: object, path: str = "") -> dict[str, object]:
        if isinstance(x, dict):
            return {k: v for key in x for k, v in flat(x[key], f"{path}.{key}" if path else str(key)).items()} or {path: {}}
        return {path: x}

    a, b = flat(previous), flat(current)
    return sorted(k for k in a.keys() | b.keys() if k not in a or k not in b or a[k] != b[k])
