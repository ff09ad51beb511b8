"""Near-duplicate records with small edits, by multiple-global-order filtering.

A record is the set of its lower-cased words. Two sets that reach the threshold share, under any global order of all words,
a word of their prefixes (the first |s| - ceil(t |s|) + 1 words). Candidates must do so under three orders:

1. rare words first, frequent ones by frequency: the key under which records meet. Where the key would be a frequent word, it
   is made of the first two common words instead: both stand in the prefix made longer by one, so that no pair is lost;
2. and 3. two independent hash orders over all words. A record carries its prefix under each as a bitmap of 32 places; where
   the bitmaps of two records have no place in common, neither have the prefixes.

All filters meet where the records do, before any text is fetched: the sizes, the two prefix bitmaps, and a third bitmap, the
parity of the words at each of 64 hash values, which differs in at most as many places as the sets do in words. What is left
is verified on the words themselves.

A key of more than `block` classes is split: its classes are dealt into blocks, and each pair of blocks is a key of its own,
so that no task holds more than two blocks of one key.

Equal sets are one class, whatever the number of copies; the classes are paired. Records with a null or empty text in any
of the columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .tokens import frequent_tokens, ranks


def word_set(text: Column) -> Column:
    """The distinct lower-cased words: longest runs of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))


def record_classes(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, class_id, words) for each record; records of one word set have one class_id."""
    filled = df.where(" AND ".join(f"`{c}` IS NOT NULL AND `{c}` <> ''" for c in columns)).where(F.col(key).isNotNull())
    rows = filled.select(F.col(key).cast("long").alias("key"), word_set(F.concat_ws(" ", *[F.col(f"`{c}`") for c in columns])).alias("w"))
    rows = rows.where(F.size("w") > 0)
    return rows.select("key", F.xxhash64(F.array_sort("w")).alias("class_id"), F.array_join("w", " ").alias("words"))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def _prefix_map(flat: np.ndarray, row: np.ndarray, at: np.ndarray, most: np.ndarray, seed: int) -> np.ndarray:
    """For each set the places, of 32, of the hashes of its first `most` words in the hash order of seed."""
    order = _mix(np.full(len(flat), seed), flat)
    by = np.lexsort((order, row))
    kept = np.arange(len(flat)) - at[row] < most[row]  # by keeps the rows where they are
    place = np.where(kept, np.uint64(1) << (order[by] & np.uint64(31)), np.uint64(0))
    return np.bitwise_or.reduceat(place, at)


def postings(classes: DataFrame, threshold: float, share: float, heavy: int) -> DataFrame:
    """(token, class_id, size, words, prefixes): the keys of order 1 of each class, with its size and bitmaps."""
    hashed = classes.select("class_id", F.transform(F.split("words", " "), lambda w: F.xxhash64(w)).alias("set"))
    frequent, counts, n = frequent_tokens(hashed, "set", share)
    hot = np.sort(frequent[counts >= heavy])

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            sets = b["set"].to_list()
            size = np.array([len(x) for x in sets])
            flat = np.concatenate(sets)
            row = np.repeat(np.arange(len(sets)), size)
            at = np.cumsum(size) - size
            one = np.uint64(1) << (flat.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(58))
            slack = size - np.ceil(threshold * size - 1e-9).astype(np.int64)
            maps = {"words": np.bitwise_xor.reduceat(one, at).view(np.int64)}
            maps["prefixes"] = (_prefix_map(flat, row, at, slack + 1, 2) << np.uint64(32) | _prefix_map(flat, row, at, slack + 1, 3)).view(np.int64)
            ids = b["class_id"].to_numpy()

            def posted(r: np.ndarray, key: np.ndarray, size=size, maps=maps, ids=ids) -> pd.DataFrame:
                return pd.DataFrame({"token": key.view(np.int64), "class_id": ids[r], "size": size[r].astype(np.int32)} | {k: m[r] for k, m in maps.items()})

            order = np.lexsort((flat, ranks(flat, frequent, counts), row))
            flat = flat[order]
            nth = np.arange(len(flat)) - at[row]
            k = np.minimum(np.searchsorted(hot, flat), max(0, len(hot) - 1))
            is_hot = hot[k] == flat if len(hot) else np.zeros(len(flat), bool)
            prefix = nth <= slack[row]
            # sets so small that they need share but one word keep their single words, frequent or not
            tiny = (np.ceil(threshold * size - 1e-9) < 2)[row]
            single = prefix & (~is_hot | tiny)
            yield posted(row[single], flat[single])
            # the first frequent word of the order and all after it are frequent: pairs of two in the longer prefix
            cold = np.add.reduceat((~is_hot).astype(np.int64), at)
            width = np.minimum(slack + 2, size) - cold
            for w in np.unique(width[width > 1]):  # a set of one frequent word, or one left after the rare ones, has no pair
                who = np.flatnonzero(width == w)
                i, j = np.triu_indices(w, 1)
                some = max(1, 1_000_000 // len(i))
                for first in range(0, len(who), some):
                    part = who[first : first + some]
                    window = flat[(at[part] + cold[part])[:, None] + np.arange(w)]
                    yield posted(np.repeat(part, len(i)), _mix(window[:, i].ravel().view(np.uint64), window[:, j].ravel().view(np.uint64)))

    return hashed.mapInPandas(keys, "token long, class_id long, size int, words long, prefixes long")


def _near(a: DataFrame, b: DataFrame, on: list[str], threshold: float, distinct_blocks: Column) -> DataFrame:
    """(class_a, class_b) of the classes that meet under a key and pass all filters."""
    fields = [c for c in a.columns if c not in on]
    both = a.join(b.select(*on, *[F.col(c).alias(f"o_{c}") for c in fields]), on)
    x, y = F.col("size"), F.col("o_size")
    apart = F.bit_count(F.col("words").bitwiseXOR(F.col("o_words")))
    kept = (x >= threshold * y - 1e-9) & (y >= threshold * x - 1e-9) & (apart <= (x + y) * ((1 - threshold) / (1 + threshold)) + 1e-9)
    common = F.col("prefixes").bitwiseAND(F.col("o_prefixes"))
    kept = kept & (F.shiftrightunsigned(common, 32) != 0) & (common.bitwiseAND(F.lit(0xFFFFFFFF)) != 0)
    met = both.where((distinct_blocks | (F.col("class_id") < F.col("o_class_id"))) & kept)
    return met.select(F.least("class_id", "o_class_id").alias("class_a"), F.greatest("class_id", "o_class_id").alias("class_b"))


def candidates(classes: DataFrame, threshold: float, share: float, heavy: int, block: int) -> DataFrame:
    """(class_a, class_b), class_a < class_b, of all pairs of classes that pass the filters of all three orders."""
    routed = staged(postings(classes, threshold, share, heavy), "neardup-postings")  # read for the counts, and on either side
    large = routed.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > block).select("token", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    large = staged(large, "neardup-large-keys")
    small = routed.join(large, "token", "left_anti")
    near = _near(small, small, ["token"], threshold, F.lit(False))
    dealt = routed.join(large, "token").withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    first = dealt.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence("own", F.col("blocks") - 1))).drop("own", "blocks")
    second = dealt.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("own")))).withColumn("j", F.col("own")).drop("own", "blocks")
    return near.unionByName(_near(first, second, ["token", "i", "j"], threshold, F.col("i") < F.col("j"))).distinct()


def similar_records(classes: DataFrame, threshold: float = 0.8, share: float = 2e-4, heavy: int = 1000, block: int = 4_000) -> DataFrame:
    """(class_a, class_b) of all pairs of different classes (class_id, words) that reach the threshold.

    share: words in at least this share of the classes are ordered by frequency; heavy: of these, words of at least so many
    classes are keys in pairs only; block: keys of more classes are split.
    """
    near = candidates(classes, threshold, share, heavy, block)
    text = classes.select("class_id", "words")
    full = near.join(text.withColumnRenamed("class_id", "class_a").withColumnRenamed("words", "ta"), "class_a")
    full = full.join(text.withColumnRenamed("class_id", "class_b").withColumnRenamed("words", "tb"), "class_b")
    full = full.select("class_a", "class_b", F.split("ta", " ").alias("wa"), F.split("tb", " ").alias("wb"))
    shared = F.size(F.array_intersect("wa", "wb"))
    return full.where(shared >= threshold * (F.size("wa") + F.size("wb") - shared) - 1e-9).select("class_a", "class_b")


def class_table(records: DataFrame) -> DataFrame:
    return records.groupBy("class_id").agg(F.first("words").alias("words"))


def near_duplicate_pairs(df: DataFrame, key: str = "result_no", columns: tuple[str, ...] = ("question", "expected_answer"), threshold: float = 0.8) -> DataFrame:
    """(key_a, key_b), key_a < key_b: all pairs of records, repeats of one word set included."""
    records = staged(record_classes(df, key, list(columns)), "neardup-records")
    pairs = similar_records(staged(class_table(records), "neardup-classes"), threshold)
    members = records.select("class_id", "key").distinct()
    between = (
        pairs.join(members.select(F.col("class_id").alias("class_a"), F.col("key").alias("ka")), "class_a")
        .join(members.select(F.col("class_id").alias("class_b"), F.col("key").alias("kb")), "class_b").select("ka", "kb")
    )
    twin = members.select("class_id", F.col("key").alias("kb"))
    within = members.select("class_id", F.col("key").alias("ka")).join(twin, "class_id").where("ka < kb").select("ka", "kb")
    both = between.where("ka != kb").unionByName(within)
    return both.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()


def near_duplicate_groups(df: DataFrame, key: str = "result_no", columns: tuple[str, ...] = ("question", "expected_answer"), threshold: float = 0.8) -> DataFrame:
    """(key, class_key, copies, links): each record with the least key of its class, the number of the class's records, and
    that of the other classes linked to it. Copies are not expanded into pairs."""
    records = staged(record_classes(df, key, list(columns)), "neardup-records")
    pairs = similar_records(staged(class_table(records), "neardup-classes"), threshold)
    ends = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    members = records.select("class_id", "key").distinct()
    size = members.groupBy("class_id").agg(F.min("key").alias("class_key"), F.count("*").alias("copies"))
    whole = size.join(ends, "class_id", "left")
    return members.join(whole, "class_id").select(F.col("key").alias(key), "class_key", "copies", F.coalesce("links", F.lit(0)).alias("links"))
