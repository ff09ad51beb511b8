"""Pairs of rows that meet under a key, and all similar pairs of sets; keys of any number of rows."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged


def meetings(posts: DataFrame, token: str = "token", id: str = "id", block: int = 4_000, split: bool = True) -> DataFrame:
    """The pairs of rows of posts under each token, with id < o_id; the other row's columns have o_ before their names.

    The rows are shuffled once, by token. A token of more than `block` rows is split: its rows are dealt into blocks, and each
    pair of blocks is a key of its own, so that no task holds more than two blocks of one token. Rows without a token meet none.
    Without `split`, it is known that no token has so many.
    """
    fields = [c for c in posts.columns if c != token]
    routed = posts.where(F.col(token).isNotNull()).repartition(token)
    large = routed.groupBy(token).agg(F.count("*").alias("_n")).where(F.col("_n") > block).select(token, F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))

    def paired(a: DataFrame, b: DataFrame, on: list[str], apart: Column) -> DataFrame:
        met = a.join(b.select(*on, *[F.col(c).alias(f"o_{c}") for c in fields]), on)
        inside = met.where(F.col(id) < F.col(f"o_{id}")) if apart is None else met.where(apart | (F.col(id) < F.col(f"o_{id}")))
        # of two blocks, the rows may stand either way round
        turn = F.col(id) > F.col(f"o_{id}")
        cols = [x for c in fields for x in (F.when(turn, F.col(f"o_{c}")).otherwise(F.col(c)).alias(c), F.when(turn, F.col(c)).otherwise(F.col(f"o_{c}")).alias(f"o_{c}"))]
        return inside.where(F.col(id) != F.col(f"o_{id}")).select(token, *cols)

    if not split:
        return paired(routed, routed, [token], None)
    small = routed.join(large, token, "left_anti")
    dealt = routed.join(large, token).withColumn("_own", F.pmod(F.xxhash64(id), F.col("_blocks")).cast("int"))
    first = dealt.select(token, *fields, F.col("_own").alias("_i"), F.explode(F.sequence("_own", F.col("_blocks") - 1)).alias("_j"))
    second = dealt.select(token, *fields, F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("_i"), F.col("_own").alias("_j"))
    return paired(small, small, [token], None).unionByName(paired(first, second, [token, "_i", "_j"], F.col("_i") < F.col("_j")))


def _bucket(values: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of each 64-bit value among 2^bits."""
    x = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def bucket_counts(values: DataFrame, bits: int, slices: int = 64) -> np.ndarray:
    """How many of the values (arrays of 64-bit numbers, one column) fall into each of 2^bits buckets.

    All values are counted. Each task sends its counts in packed slices, which are added up slice by slice; the driver gets the
    table, whose size is fixed.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << bits, np.int64)
        for b in batches:
            rows = [x for x in b.iloc[:, 0] if x is not None and len(x)]
            if rows:
                total += np.bincount(_bucket(np.concatenate(rows).astype(np.int64), bits), minlength=1 << bits)
        parts = [(i, zlib.compress(x.tobytes(), 1)) for i, x in enumerate(np.split(total, slices)) if x.any()]
        yield pd.DataFrame(parts, columns=["slice", "counts"]).astype({"slice": np.int32})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in pdf["counts"])
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})

    kind = "slice int, counts binary"
    out = np.zeros((slices, (1 << bits) // slices), np.int64)
    for r in values.mapInPandas(count, kind).groupBy("slice").applyInPandas(add, kind).collect():
        out[r["slice"]] = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.int64)
    return out.reshape(-1)


def among(df: DataFrame, id: str, ids: DataFrame, bits: int = 23) -> DataFrame:
    """df without most of the rows whose id isn't in ids (one column): those are left out whose bucket no id of ids has.

    It spares a shuffle of large rows before a join, which still has to be made.
    """
    held = np.packbits(bucket_counts(ids.select(F.array(F.xxhash64(ids.columns[0]))), bits) > 0)

    @F.pandas_udf("boolean")
    def may_be(h: pd.Series) -> pd.Series:
        k = _bucket(h.to_numpy(np.int64), bits)
        return pd.Series((held[k >> 3] >> (7 - (k & 7))) & 1 == 1)

    return df.where(may_be(F.xxhash64(id)))


def set_heads(sets: DataFrame, threshold: float, bits: int = 20, same: tuple[str, ...] = ()) -> DataFrame:
    """(id, n, s, z, wide, tokens), a table: of each set that isn't empty its size, its signs and its first tokens.

    The first |s| - ceil(t |s|) + 1 tokens are those in the order rare ones first, by the counts of 2^bits buckets of tokens. The
    signs are 128 bits, in which each token of the set has turned one, and wide has two bits at least for each token: two sets
    differ in as many tokens at least as in bits. Of rows that are equal in the columns `same` only the least id takes part.
    """
    counts = np.minimum(bucket_counts(sets.select("set"), bits), 2**31 - 1).astype(np.int32)

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b["set"].map(len) > 0]
            if not len(b):
                continue
            size = b["set"].map(len).to_numpy()
            begin = np.cumsum(size) - size
            flat = np.concatenate(b["set"].to_list())
            row = np.repeat(np.arange(len(b)), size)
            order = np.lexsort((flat, counts[_bucket(flat, bits)], row))
            keep = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
            ordered = flat[order]
            turned = _bucket(flat ^ (flat << 21), 7)
            bit = np.uint64(1) << (turned & 63).astype(np.uint64)
            signs = [np.bitwise_xor.reduceat(np.where(turned >> 6 == i, bit, np.uint64(0)), begin).view(np.int64) for i in (0, 1)]
            longs = np.maximum(1, 1 << np.ceil(np.log2(size / 32)).astype(np.int64).clip(0))
            base = np.cumsum(longs) - longs
            h = flat.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            h = ((h ^ (h >> np.uint64(32))) & np.uint64(2**31 - 1)).astype(np.int64)
            wide = np.zeros(longs.sum(), np.uint64)
            np.bitwise_xor.at(wide, base[row] + ((h >> 6) & (longs[row] - 1)), np.uint64(1) << (h & 63).astype(np.uint64))
            wide = wide.view(np.int64)
            yield b.drop(columns="set").assign(n=size.astype(np.int32), s=signs[0], z=signs[1], wide=[wide[i : i + k] for i, k in zip(base, longs)], tokens=[ordered[i : i + k] for i, k in zip(begin, keep)])

    kinds = dict(sets.dtypes)
    kind = ", ".join(f"{c} {kinds[c]}" for c in ("id", *same))
    heads = sets.select("id", *same, "set").mapInPandas(prefixes, f"{kind}, n int, s long, z long, wide array<long>, tokens array<long>")
    if same:
        heads = heads.groupBy(*same).agg(F.min(F.struct("id", "n", "s", "z", "wide", "tokens")).alias("x")).select("x.*")
    return staged(heads, "set-heads")


def _bits_apart(a: str, b: str) -> Column:
    """In how many bits two arrays of longs differ; of a pair with unlike sizes (powers of two) the longer one is folded."""
    least = F.least(F.size(a), F.size(b))
    even = lambda c: F.transform(F.sequence(F.lit(0), least - 1), lambda i: F.aggregate(F.sequence(i, F.size(c) - 1, least), F.lit(0).cast("long"), lambda s, k: s.bitwiseXOR(F.get(c, k))))
    fold = lambda c: F.when(F.size(c) == least, F.col(c)).otherwise(even(c))
    return F.aggregate(F.zip_with(fold(a), fold(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def similar_sets(sets: DataFrame | Callable[[DataFrame], DataFrame], threshold: float, bits: int = 20, block: int = 4_000, heads: DataFrame | None = None) -> DataFrame:
    """(a, b, shared, na, nb), a < b, of all pairs of sets (id, set of 64-bit tokens) whose Jaccard similarity reaches threshold.

    Two such sets share one of their first tokens at places that still allow the overlap, and their signs differ in few bits;
    both are in `heads`, which set_heads makes for this threshold. The pairs left are verified on the sets, of which only those of
    such pairs are moved. Read several times, sets should be a table; given heads, they may also be a function that gets the rows
    (id and other columns) for which sets are needed, and adds to each its set.
    """
    heads = set_heads(sets, threshold, bits) if heads is None else heads
    split = bool(bucket_counts(heads.select("tokens"), bits).max() > block)  # a token has at most as many rows as its bucket
    met = meetings(heads.select("id", "n", "s", "z", F.posexplode("tokens").alias("pos", "token")), block=block, split=split)
    n, m = F.col("n"), F.col("o_n")
    need = F.ceil(threshold / (1 + threshold) * (n + m) - 1e-9)
    fits = (n >= threshold * m - 1e-9) & (m >= threshold * n - 1e-9) & (1 + F.least("pos", "o_pos") + F.least(n - F.col("pos") - 1, m - F.col("o_pos") - 1) >= need)
    apart = F.bit_count(F.col("s").bitwiseXOR(F.col("o_s"))) + F.bit_count(F.col("z").bitwiseXOR(F.col("o_z")))
    near = met.where(fits & (apart <= n + m - 2 * need)).select(F.col("id").alias("a"), F.col("o_id").alias("b")).distinct()
    end = lambda side: heads.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("wide").alias(f"w_{side}"))
    both = near.join(end("a"), "a").join(end("b"), "b")
    near = staged(both.where(_bits_apart("w_a", "w_b") <= F.col("n_a") + F.col("n_b") - 2 * F.ceil(threshold / (1 + threshold) * (F.col("n_a") + F.col("n_b")) - 1e-9)).select("a", "b"), "near-sets")
    return verified(near, sets, threshold)


def verified(near: DataFrame, sets: DataFrame | Callable[[DataFrame], DataFrame], threshold: float, block: int = 64) -> DataFrame:
    """The rows of similar_sets for those pairs (a, b), a < b, of near that reach the threshold.

    Sets aren't moved for each pair: pairs go to the place of a, the least id of a pair that it is in, and a set once to each place
    where it has pairs, so that of ids that are all alike each set is moved once. A place of more than `block` ids is split by
    dealing the ids; of one part no more than two blocks of sets, as they are dealt, are held together.
    """
    at = ["_at", "_i", "_j"]
    homes = near.select(F.col("a").alias("id"), F.col("a").alias("_at")).unionByName(near.select(F.col("b").alias("id"), F.col("a").alias("_at"))).groupBy("id").agg(F.min("_at").alias("_at"))
    placed = near.join(homes.withColumnRenamed("id", "a"), "a")
    deals = placed.select("_at", F.explode(F.array("a", "b")).alias("id")).distinct().groupBy("_at").agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    deal = lambda c: F.pmod(F.xxhash64(c), F.col("_n")).cast("int")
    placed = staged(placed.join(deals, "_at").select("_at", deal("a").alias("_i"), deal("b").alias("_j"), "a", "b"), "placed-pairs")
    needed = placed.select(*at, F.explode(F.array("a", "b")).alias("id")).distinct()
    made = sets(needed) if callable(sets) else among(sets.select("id", "set"), "id", needed.select("id")).join(needed, "id")
    held = made.select(*at, "id", "set").repartition(*at).groupBy(*at).agg(F.collect_list(F.struct("id", "set")).alias("_s"))
    asked = placed.repartition(*at).groupBy(*at).agg(F.collect_list(F.struct("a", "b")).alias("_p"))
    of = lambda id: F.filter("_s", lambda x: x["id"] == id)
    row = lambda p, x, y: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.size(F.array_intersect(x["set"], y["set"])).alias("shared"), F.size(x["set"]).alias("na"), F.size(y["set"]).alias("nb"))
    rows = F.flatten(F.transform("_p", lambda p: F.flatten(F.transform(of(p["a"]), lambda x: F.transform(of(p["b"]), lambda y: row(p, x, y))))))
    out = asked.join(held, at).select(F.explode(rows).alias("x")).select("x.*")
    return out.where(F.col("shared") >= threshold * (F.col("na") + F.col("nb") - F.col("shared")) - 1e-9).distinct()
