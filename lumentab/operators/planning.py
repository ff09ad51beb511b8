"""Sizes and quotas of question sets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def precision_floor(margin: float) -> int:
    """Questions for a 95 % interval of so many points on either side; 0 disables it."""
    return math.ceil(1.96 * 1.96 * 0.25 / (margin * margin)) if margin else 0


def largest_remainder(weights: DataFrame, total: int, name: str = "name", weight: str = "weight", minimum: int = 0) -> DataFrame:
    """(name, quota): shares of total in proportion to the weights, at least minimum each, the seats left over by the largest
    remainders, ties by name; where all weights are 0, one each by name. weights has one row for each name, and few."""
    rows = weights.select(F.col(name).alias("name"), F.col(weight).cast("double").alias("w"))
    sums = rows.agg(F.sum("w").alias("all"), F.count("*").alias("n"))
    free = F.greatest(F.lit(total) - minimum * F.col("n"), F.lit(0))
    raw = rows.crossJoin(F.broadcast(sums)).withColumn("raw", F.coalesce(F.try_divide(F.col("w") * free, F.col("all")), F.lit(0.0)))
    based = raw.withColumn("base", F.floor(F.col("raw") + 1e-9)).withColumn("part", F.round(F.col("raw") - F.floor(F.col("raw") + 1e-9), 9))
    left = based.agg((F.first(free) - F.sum("base")).alias("left"))
    place = F.row_number().over(Window.orderBy(F.desc("part"), "name"))
    return based.withColumn("place", place).crossJoin(F.broadcast(left)).select("name", (F.lit(minimum) + F.col("base") + (F.col("place") <= F.col("left")).cast("int")).cast("bigint").alias("quota"))


def divisor_quota(weights: DataFrame, total: int, cap: int, name: str = "name", weight: str = "weight", minimum: int = 1) -> DataFrame:
    """(name, quota): the minimum, of the cap at most, first to the heaviest, then seat by seat to the largest weight /
    (quota + 1) below cap.

    As a set: the best quotients of all names are the seats, so that no loop runs.
    """
    rows = weights.select(F.col(name).alias("name"), F.col(weight).cast("double").alias("w")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("w"), "name")))
    least = max(0, min(minimum, cap))
    first = F.least(F.lit(least), F.greatest(F.lit(0), F.lit(total) - (F.col("place") - 1) * least))
    based = rows.withColumn("base", first)
    used = based.agg(F.sum("base").alias("used"))
    seats = based.where(F.col("base") < cap).select("name", "place", F.explode(F.sequence(F.col("base"), F.lit(cap - 1))).alias("k"), "w").withColumn("q", F.col("w") / (F.col("k") + 1))
    ranked = seats.withColumn("r", F.row_number().over(Window.orderBy(F.desc("q"), "place", "k"))).crossJoin(F.broadcast(used)).where(F.col("r") <= F.lit(total) - F.col("used"))
    more = ranked.groupBy("name").agg(F.count("*").alias("more"))
    return based.join(more, "name", "left").select("name", (F.col("base") + F.coalesce("more", F.lit(0))).cast("bigint").alias("quota"))


def balanced_windows(rows: DataFrame, group: str, order: list[str], most: int, wanted: int | str = 0, per_call: int = 8) -> DataFrame:
    """rows with window_no: contiguous windows of at most `most` rows whose sizes differ by one at most, the larger ones first.

    There are also as many windows as keep the `wanted` questions of a group (a number, or a column) at per_call for each, though
    never more than rows.
    """
    w = Window.partitionBy(group).orderBy(*order)
    n = F.count("*").over(Window.partitionBy(group))
    goal = F.col(wanted) if isinstance(wanted, str) else F.lit(wanted)
    k = F.least(n, F.greatest(F.lit(1), F.ceil(n / max(1, most)), F.ceil(F.greatest(goal, F.lit(0)) / max(1, per_call))))
    small, extra = F.floor(n / k), n % k
    i = F.row_number().over(w) - 1
    big = extra * (small + 1)
    return rows.withColumn("window_no", F.when(i < big, F.floor(i / (small + 1))).otherwise(extra + F.floor((i - big) / F.greatest(small, F.lit(1)))).cast("bigint") + 1)


def window_goals(windows: DataFrame, group: str, weight: str, wanted: str) -> DataFrame:
    """(group, window_no, goal): the wanted questions of a group over its windows in proportion to their weights, what is left
    over by the largest remainders, ties by window; windows is (group, window_no, weight, wanted)."""
    own = Window.partitionBy(group)
    raw = F.coalesce(F.try_divide(F.col(wanted) * F.col(weight).cast("double"), F.sum(F.col(weight).cast("double")).over(own)), F.lit(0.0))
    rows = windows.withColumn("_raw", F.when(F.col(wanted) > 0, raw).otherwise(0.0)).withColumn("_base", F.floor(F.col("_raw") + 1e-9))
    left = F.when(F.sum("_raw").over(own) > 0, F.col(wanted) - F.sum("_base").over(own)).otherwise(0)
    place = F.row_number().over(own.orderBy(F.desc(F.round(F.col("_raw") - F.col("_base"), 9)), "window_no"))
    return rows.select(group, "window_no", (F.col("_base") + (place <= left).cast("int")).cast("bigint").alias("goal"))


def plan_topics(content: DataFrame, coverage: float = 0.35, max_coverage: float = 0.8, claims: float = 3.2, margin: float = 0.2) -> DataFrame:
    """(topic, chunks, units, content, ceiling, canonical, reason): questions a topic's content carries, raised to the precision
    floor where the content allows; content is (topic, units) for each chunk. Halves are rounded to even."""
    floor = precision_floor(margin)
    has = F.col("units") > 0
    g = content.groupBy("topic").agg(
        F.count("*").alias("chunks"), F.sum("units").alias("units"),
        F.coalesce(F.sum(F.when(has, F.greatest(F.lit(1), F.bround(F.col("units") * coverage / claims, 0).cast("bigint")))), F.lit(0)).alias("content"),
    ).withColumn("ceiling", F.greatest(F.lit(1), F.floor(F.col("units") * max_coverage / claims)))
    canonical = F.greatest("content", F.least(F.lit(floor), F.col("ceiling")))
    reason = F.when(F.col("content") >= canonical, "content").when(F.col("ceiling") < floor, "precision_capped").otherwise("precision")
    return g.withColumn("canonical", canonical).withColumn("reason", reason)


def set_sizes(canonical: int, boundary_share: float = 0.15, natural: float = 1.0, broad: int = 1, per_topic: int = 1) -> dict[str, int]:
    """Counts of the derived questions of a set."""
    boundary = math.ceil(canonical * boundary_share)
    return {"canonical": canonical, "boundary": boundary, "natural": round(canonical * natural), "broad": broad * per_topic, "visible": boundary + round(canonical * natural) + broad * per_topic}


def canonical_for_target(target: int, most: int, **parameters) -> int:
    """The largest canonical count whose visible set is within target; the search ends at the first that isn't."""
    best = 0
    for n in range(1, most + 1):
        if set_sizes(n, **parameters)["visible"] > target:
            break
        best = n
    return best


def suggested_graph_parameters(n_chunks: int) -> dict[str, int]:
    topics = max(6, min(30, round(math.sqrt(n_chunks))))
    return {"max_topics": topics, "max_cluster_size": max(8, math.ceil(2 * n_chunks / topics)) if n_chunks else 8}


def upper_median(values: DataFrame, column: str) -> DataFrame:
    """One row (median): the element in the middle, the upper one of two; by a rank, not by gathering the values."""
    rows = values.where(F.col(column).isNotNull())
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = rows.agg(F.count("*").alias("total"))
    return counts.withColumn("upto", running).crossJoin(F.broadcast(total)).where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min(column).alias("median"))
