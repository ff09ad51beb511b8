"""Mixing sources to target weights by a low-discrepancy schedule.

The texts of each source, in an order shuffled by hash, are laid end to end and cut into blocks of equal tokens (a text is in
the block of its middle), of about the same size in all sources. Slot i of the mixture gets the source in whose part of the
cumulative weights (share over block size) the point frac(i * golden ratio) falls; any stretch of the mixture so has the target
shares up to a block or two. The r-th slot of a source takes its block r modulo the number of its blocks, in round r div that
number.

The default size is the largest at which each source has enough for its share within max_repeats rounds; with a `tolerance`,
for all but that part of its share. Where total_tokens asks for more, a source that has too little gives all it may, spread
over the whole mixture; the report shows the shares reached.

A text that comes under several ids, or in several sources, counts as one, with the least id; so that no text is used more
than max_repeats times. Sources without target (null among them), null and empty texts take no part. Targets are taken in
proportion to their sum; a null target, or a max_repeats below 1, is none.

Running sums never run over a whole source in one task: they are sums within hash buckets plus the sums of the buckets before;
a source has a bucket for every `per_bucket` of its texts. Texts of more than a fifth of what their source is to give stand
behind all others, by size (in steps of a quarter of a doubling) and within a size by hash, as one of them in front would miss
the share by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .tokenizers import VOCABULARY, token_count

GOLDEN = 0.6180339887498949


def text_pool(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """(source, key, n_tokens) of the distinct texts of the sources that have a target; written once to the shared folder."""
    wanted = targets.select(F.col("source").alias("_s")).distinct()
    rows = documents.where(F.col(text).isNotNull() & (F.col(text) != "")).join(wanted, F.col(source) == F.col("_s"), "left_semi")
    sizes = rows.select(F.col(source).alias("source"), F.col(key).alias("key"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), token_count(F.col(text), vocabulary).alias("n_tokens"))
    one = sizes.groupBy("h1", "h2").agg(F.min_by(F.struct("source", "key", "n_tokens"), F.struct("key", "source")).alias("x"))
    return staged(one.select("x.source", "x.key", "x.n_tokens").where("n_tokens > 0"), "mix-pool")


def _running(rows: DataFrame, by: str, bucket: str, order: list[str], size: str, into: str) -> DataFrame:
    """rows with the sum of size over the rows before, by `by`, in order of bucket and then order."""
    inner = Window.partitionBy(by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(by, bucket).agg(F.sum(size).alias("_sum"))
    before = totals.select(by, bucket, F.coalesce(F.sum("_sum").over(Window.partitionBy(by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(before, [by, bucket]).withColumn(into, F.col("_before") + F.coalesce(F.sum(size).over(inner), F.lit(0))).drop("_before")


def mix_sources(pool: DataFrame, targets: DataFrame, total_tokens: int | None = None, tolerance: float = 0.0, block_tokens: int = 4096, per_bucket: int = 20_000) -> DataFrame:
    """(slot, source, round, block, offset, key, n_tokens): the mixture, in order of slot and offset."""
    spark = pool.sparkSession
    want = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats >= 1").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    have = pool.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("texts"))
    rows = want.join(have, "source").orderBy("source").collect()  # one row for each target
    shares = sum(r["share"] for r in want.collect()) or 1.0
    if not rows:
        return spark.createDataFrame([], "slot long, source string, round int, block long, offset long, key long, n_tokens int")
    caps = {r["source"]: float(r["repeats"] * r["tokens"]) for r in rows}
    wish = {r["source"]: r["share"] / shares for r in rows}
    enough = [caps[k] / wish[k] for k in wish]
    total = float(total_tokens or min(min(enough) / max(1e-9, 1.0 - tolerance), max(enough)))
    given = {k: min(wish[k], caps[k] / total) for k in wish}
    total *= sum(given.values())
    given = {k: v / sum(given.values()) for k, v in given.items()}
    # blocks small enough for the shares of small sources to come out
    grain = max(64, min(block_tokens, int(total * min(given.values()) / 64)))
    blocks_of = {r["source"]: max(1, math.ceil(r["tokens"] / grain)) for r in rows}
    size = {r["source"]: r["tokens"] / blocks_of[r["source"]] for r in rows}  # no block is left with a rest
    due = {k: total * v / size[k] for k, v in given.items()}
    slots = max(1, round(sum(due.values())))
    bounds, at = [], 0.0
    for r in rows:
        part = due[r["source"]] / sum(due.values())
        bounds.append((r["source"], at, at + part, r["repeats"], blocks_of[r["source"]]))
        at += part
    # the texts of a source in shuffled order, laid end to end, the large ones last
    much, block, buckets = (F.lit(None).cast(t) for t in ("double", "double", "int"))
    for r in rows:
        own = F.col("source") == r["source"]
        block = F.when(own, F.lit(size[r["source"]])).otherwise(block)
        much = F.when(own, F.lit(max(float(grain), 0.2 * total * given[r["source"]]))).otherwise(much)
        buckets = F.when(own, F.lit(math.ceil(r["texts"] / per_bucket))).otherwise(buckets)
    laid = pool.withColumn("h", F.xxhash64(F.lit(11), "key")).withColumn("k", buckets)
    step = F.when(F.col("n_tokens") > much, 1 + F.floor(4 * F.log2("n_tokens"))).otherwise(0)
    laid = laid.withColumn("bucket", step * F.col("k") + F.pmod("h", F.col("k"))).drop("k")
    laid = _running(laid, "source", "bucket", ["h", "key"], "n_tokens", "offset").withColumn("block", F.floor((F.col("offset") + F.col("n_tokens") / 2) / block))
    # the schedule
    point = F.pmod(F.col("id").cast("double") * F.lit(GOLDEN), F.lit(1.0))
    chosen = F.lit(None)
    for name, low, high, repeats, blocks in reversed(bounds):
        chosen = F.when((point >= low) & (point < high), F.struct(F.lit(name).alias("source"), F.lit(repeats).cast("int").alias("repeats"), F.lit(blocks).cast("long").alias("blocks"))).otherwise(chosen)
    plan = spark.range(slots).withColumn("c", chosen).where("c IS NOT NULL").select(F.col("id").alias("slot"), "c.*", F.lit(1).alias("one"))
    plan = _running(plan.withColumn("part", F.floor(F.col("slot") / 100_000)), "source", "part", ["slot"], "one", "rank")
    turn = F.floor(F.col("rank") / F.col("blocks"))
    plan = plan.withColumn("round", turn.cast("int")).where("round < repeats").withColumn("block", F.pmod(F.col("rank") + turn * 7919, F.col("blocks")))
    return plan.join(laid, ["source", "block"]).select("slot", "source", "round", "block", F.col("offset").cast("long").alias("offset"), "key", "n_tokens")


def mix_report(mixture: DataFrame, pool: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, available_tokens, used_tokens, actual_share, most_uses) for each target."""
    wanted = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = pool.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    uses = mixture.groupBy("source", "key").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"))
    used = uses.groupBy("source").agg(F.sum("t").alias("used_tokens"), F.max("n").alias("most_uses"))
    out = wanted.join(have, "source", "left").join(used, "source", "left").fillna(0, ["available_tokens", "used_tokens", "most_uses"])
    total = out.agg(F.sum("used_tokens").alias("_total"))
    return out.crossJoin(F.broadcast(total)).withColumn("actual_share", F.round(F.col("used_tokens") / F.col("_total"), 6)).drop("_total")
