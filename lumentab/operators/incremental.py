"""Batch-incremental state: pending work, resumed journals, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Part of every cache key: bump it when an operator's results change.
OPERATOR_VERSION = "1"


def fingerprint(*columns: Column) -> Column:
    """SHA-256 over the columns and the operator version; nulls and blanks differ."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null")) for c in columns]
    return F.sha2(F.concat_ws("\0", F.lit(OPERATOR_VERSION), *parts), 256)


def latest(journal: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last entry of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return journal.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def resume(inputs: DataFrame, journal: DataFrame, key: str, digest: str = "digest", retry: tuple[str, ...] = ()) -> DataFrame:
    """(key, state): done, changed (journalled from another input), retry (its outcome is one to try again), pending."""
    j = journal.select(key, F.col(digest).alias("_d"), F.col("outcome").alias("_o"))
    state = F.when(F.col("_d").isNull(), "pending").when(F.col("_d") != F.col(digest), "changed").when(F.col("_o").isin(*retry), "retry").otherwise("done") if retry else F.when(F.col("_d").isNull(), "pending").when(F.col("_d") != F.col(digest), "changed").otherwise("done")
    return inputs.join(j, key, "left").select(key, state.alias("state"))


def replay(calls: DataFrame, stored: DataFrame, key: str = "call_key", order: str = "pos") -> DataFrame:
    """calls with the response of the n-th stored call of the same key for the n-th call."""
    nth = lambda df: df.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return nth(calls).join(nth(stored).select(key, "nth", "response"), [key, "nth"], "left")


def pending(inputs: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return inputs.join(cache.select(key).distinct(), key, "left_anti")


def pruned(cache: DataFrame, used: DataFrame, key: str, kind: str = "kind") -> DataFrame:
    """The cache without the entries that weren't looked up, of those kinds that were looked up at all."""
    kinds = used.select(kind).distinct().withColumn("_touched", F.lit(True))
    hits = used.select(kind, key).distinct().withColumn("_hit", F.lit(True))
    return cache.join(kinds, kind, "left").join(hits, [kind, key], "left").where("_touched IS NULL OR _hit").drop("_touched", "_hit")


def valid_entries(cache: DataFrame, version: int, payload: str = "payload") -> DataFrame:
    """Entries of this schema version whose payload is a JSON object; the others are computed again."""
    return cache.where((F.col("version") == version) & F.get_json_object(payload, "$").isNotNull() & F.col(payload).startswith("{"))


def torn_tail(lines: DataFrame, line_no: str = "line_no", text: str = "text") -> DataFrame:
    """Journal lines without an unfinished last one; any other bad line is an error."""
    last = lines.agg(F.max(line_no).alias("_last"))
    bad = F.get_json_object(text, "$").isNull()
    rows = lines.crossJoin(F.broadcast(last)).where(~(bad & (F.col(line_no) == F.col("_last"))))
    return rows.withColumn(text, F.when(bad, F.raise_error(F.concat(F.lit("bad journal line "), F.col(line_no).cast("string")))).otherwise(F.col(text))).drop("_last")
