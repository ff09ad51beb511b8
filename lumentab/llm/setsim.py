"""All similar pairs between set-valued records.

Method: T-occurrence list merging over partitioned inverted lists. Records go to the partitions of their prefix tokens
(the |s| - ceil(t |s|) + 1 first ones of a global order, rare tokens first): two records that reach the threshold share one
of these. Each partition holds the inverted lists of its records; every record probes it: its longest lists are put aside,
the others are merged on a heap that skips to the first id that can still reach the required number of occurrences, and
candidates are looked up in the long lists by binary search.

Records with equal sets are one class, found before; results are pairs of classes and the members of each. A prefix token
of many records is split: its records are dealt into blocks, and each pair of blocks is a partition of its own.

Values are compared after lower-casing, trimming and reducing inner blanks to one, as 64-bit hashes. Null sets, and sets
below min_size, take part in no pair; null and blank values are no values. Repeated rows (same key, same set) count once;
a key with two sets takes part with both.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .tokens import frequent_tokens, ranks


def normalized_values(values: Column) -> Column:
    """The distinct values of an array, lower case, trimmed, inner blanks reduced to one."""
    clean = F.transform(values, lambda x: F.trim(F.regexp_replace(F.lower(x), r"[\s ]+", " ")))
    return F.array_distinct(F.filter(clean, lambda x: x.isNotNull() & (x != "")))


def required(a: int, b: int, threshold: float) -> int:
    """The least overlap of sets of a and b values that reach the threshold."""
    return math.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def occurrences(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """(id, occurrences) of the ids that stand in at least `least` of the ascending lists, by heap with skips.

    DivideSkip: the longest lists are only searched, those left over are merged; the more lists are put aside, the fewer
    occurrences the merge itself must find.
    """
    lists = sorted((x for x in lists if x), key=len)
    if len(lists) < least:
        return
    longest = len(lists[-1])
    aside = min(least - 1, max(0, int(least / (0.5 * math.log2(longest + 2) + 1))))
    long, short = lists[len(lists) - aside :], lists[: len(lists) - aside]
    need = least - aside
    at = [0] * len(short)
    heap = [(x[0], k) for k, x in enumerate(short)]
    heapq.heapify(heap)
    while len(heap) >= need:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= need:
            n = len(popped)
            for x in long:
                i = bisect_left(x, top)
                n += i < len(x) and x[i] == top
            if n >= least:
                yield top, n
            for k in popped:
                at[k] += 1
                if at[k] < len(short[k]):
                    heapq.heappush(heap, (short[k][at[k]], k))
        else:
            while heap and len(popped) < need - 1:  # too few: everything below the next head can't reach the number
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                return
            head = heap[0][0]
            for k in popped:
                at[k] = bisect_left(short[k], head, at[k])
                if at[k] < len(short[k]):
                    heapq.heappush(heap, (short[k][at[k]], k))


def merge_partition(ids: list[int], sets: list[np.ndarray], sides: list[int], threshold: float, across: bool) -> Iterator[tuple[int, int, int, int, int]]:
    """(class a, class b, size a, size b, overlap) of all pairs of one partition; each record probes the smaller ones."""
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i], sides[i]))
    lists: dict[int, list[int]] = {}
    for now, i in enumerate(order):
        mine = sets[i].tolist()
        least = math.ceil(threshold * len(mine) - 1e-9)
        for other, n in occurrences([lists[t] for t in mine if t in lists], least):
            j = order[other]
            a, b = len(mine), len(sets[j])
            if n >= required(a, b, threshold) and (not across or sides[i] != sides[j]):
                yield (ids[j], ids[i], b, a, n) if not across or sides[j] < sides[i] else (ids[i], ids[j], a, b, n)
        for t in mine:
            lists.setdefault(t, []).append(now)


def class_table(records: DataFrame) -> DataFrame:
    """(class_id, set, field, rep, copies) of the distinct sets of set_records; rep is the least key of a class."""
    return records.groupBy("class_id").agg(F.first("set").alias("set"), F.first("field").alias("field"), F.min("key").alias("rep"), F.count_distinct("key").alias("copies"))


def similar_classes(classes: DataFrame, threshold: float, across: bool = False, share: float = 0.001, block: int = 4_000, per_partition: int = 20_000) -> DataFrame:
    """(class_a, class_b, size_a, size_b, overlap) of all pairs of classes (class_id, set[, side]) that reach the threshold.

    share: tokens in at least this share of the classes are ordered by frequency; block: prefix tokens of more classes are
    split into pairs of blocks; per_partition: records a partition holds on average.
    """
    spark = classes.sparkSession
    if "side" not in classes.columns:
        classes = classes.withColumn("side", F.lit(0))
    frequent, counts, n = frequent_tokens(classes, "set", share)

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            sets = b["set"].to_list()
            sizes = np.array([len(x) for x in sets])
            flat = np.concatenate(sets)
            row = np.repeat(np.arange(len(sets)), sizes)
            order = np.lexsort((flat, ranks(flat, frequent, counts), row))
            nth = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            most = sizes - np.ceil(threshold * sizes - 1e-9).astype(int) + 1
            keep = nth < most[row]
            r = row[keep]
            yield pd.DataFrame({"token": flat[order][keep], "class_id": b["class_id"].to_numpy()[r], "side": b["side"].to_numpy()[r], "set": [sets[i] for i in r]})

    parts = max(spark.sparkContext.defaultParallelism, math.ceil(4 * n / per_partition))
    routed = staged(classes.select("class_id", "side", "set").mapInPandas(prefixes, "token long, class_id long, side int, set array<long>"), "set-postings")
    large = routed.groupBy("token").agg(F.count("*").alias("_n")).where(F.col("_n") > block).select("token", F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    large = staged(large, "set-large-tokens")
    # all of a token of one block, and of many more tokens, is one partition
    small = routed.join(large, "token", "left_anti").repartition(parts, "token").select(F.lit(0).alias("part"), "class_id", "side", "set")
    dealt = routed.join(large, "token")
    mine = F.pmod(F.hash("class_id", "side"), F.col("_blocks"))
    # a record of block i meets block j in the partition (i, j), i <= j
    places = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))
    placed = dealt.select("token", "class_id", "side", "set", F.explode(places).alias("p"))
    placed = placed.withColumn("part", F.pmod(F.hash("token", "p.i", "p.j"), F.lit(parts))).repartition(parts, "part").select("part", "class_id", "side", "set")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, dict[tuple[int, int], np.ndarray]] = {}
        for b in batches:
            for part, c, s, v in zip(b["part"], b["class_id"], b["side"], b["set"]):
                held.setdefault(part, {})[(c, s)] = v  # a record comes once, for however many of its tokens
        for part in sorted(held):
            own = held.pop(part)
            keys = list(own)
            found = merge_partition([k[0] for k in keys], list(own.values()), [k[1] for k in keys], threshold, across)
            out: list = []
            for x in found:
                out.append(x)
                if len(out) >= 50_000:
                    yield pd.DataFrame(out, columns=["class_a", "class_b", "size_a", "size_b", "overlap"])
                    out = []
            yield pd.DataFrame(out, columns=["class_a", "class_b", "size_a", "size_b", "overlap"], dtype="int64")

    # a pair may share tokens of several partitions
    pairs = "class_a long, class_b long, size_a long, size_b long, overlap long"
    return small.mapInPandas(merge, pairs).unionByName(placed.mapInPandas(merge, pairs)).distinct()


def set_records(df: DataFrame, key: str, column: str, min_size: int = 1, field: str | None = None) -> DataFrame:
    """(field, key, class_id, set) for each record with at least min_size distinct values."""
    name = field or column
    values = df.select(F.col(key).cast("long").alias("key"), normalized_values(F.col(column)).alias("v")).where(F.col("key").isNotNull() & (F.size("v") >= min_size))
    hashed = values.select(F.lit(name).alias("field"), "key", F.array_sort(F.transform("v", lambda x: F.xxhash64(F.lit(name), x))).alias("set"))
    return hashed.withColumn("class_id", F.xxhash64("set")).select("field", "key", "class_id", "set")


def similar_pairs(records: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(field, key_a, key_b) of all pairs of records, copies expanded, within each field of set_records."""
    records = staged(records.dropDuplicates(["field", "key", "class_id"]), "set-records")
    pairs = staged(similar_classes(class_table(records), threshold), "set-pairs")
    members = records.select("field", "key", "class_id")
    a, b = members.select(F.col("class_id").alias("class_a"), "field", F.col("key").alias("ka")), members.select(F.col("class_id").alias("class_b"), F.col("key").alias("kb"))
    between = pairs.select("class_a", "class_b").join(a, "class_a").join(b, "class_b").select("field", "ka", "kb")
    # copies: the pairs of keys of one class, asked for by the result's definition
    twin = members.select("class_id", F.col("key").alias("kb"))
    within = members.select("class_id", "field", F.col("key").alias("ka")).join(twin, "class_id").where("ka < kb").select("field", "ka", "kb")
    both = between.where("ka != kb").unionByName(within)
    return both.select("field", F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()


def similar_representatives(records: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(field, rep_a, rep_b, overlap, size_a, size_b): pairs of classes by their least keys, to be read with class_members."""
    classes = staged(class_table(records), "set-classes")
    name = lambda side: classes.select(F.col("class_id").alias(f"class_{side}"), F.col("rep").alias(f"rep_{side}"), *(["field"] if side == "a" else []))
    pairs = similar_classes(classes, threshold).join(name("a"), "class_a").join(name("b"), "class_b")
    turn = F.struct("rep_a", "size_a") > F.struct("rep_b", "size_b")  # the lower key first
    either = lambda x, a, b: F.when(turn, F.col(b)).otherwise(F.col(a)).alias(x)
    return pairs.select("field", either("rep_a", "rep_a", "rep_b"), either("rep_b", "rep_b", "rep_a"), "overlap", either("size_a", "size_a", "size_b"), either("size_b", "size_b", "size_a"))


def class_members(records: DataFrame) -> DataFrame:
    """(field, key, rep, copies) of every record: the least key of the records with its set, and their number."""
    own = records.select("field", "class_id", "key").distinct()
    return own.join(class_table(records).select("class_id", "rep", "copies"), "class_id").select("field", "key", "rep", "copies")


def similar_between(left: DataFrame, right: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(rep_a, rep_b, overlap, size_a, size_b): pairs of a class of left and one of right, by their least keys.

    Both are set_records under one name of the field, so that their values are compared with each other.
    """
    sides = staged(class_table(left).withColumn("side", F.lit(0)).unionByName(class_table(right).withColumn("side", F.lit(1))), "set-sides")
    name = lambda side, k: sides.where(F.col("side") == k).select(F.col("class_id").alias(f"class_{side}"), F.col("rep").alias(f"rep_{side}"))
    pairs = similar_classes(sides, threshold, across=True).join(name("a", 0), "class_a").join(name("b", 1), "class_b")
    return pairs.select("rep_a", "rep_b", "overlap", "size_a", "size_b")
