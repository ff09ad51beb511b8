"""Shared by the set operators: frequent tokens, in a table whose size has a bound."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequent_tokens(sets: DataFrame, column: str, share: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens (64-bit) that stand in at least share of the sets, ascending, the number of sets of each, and of all sets.

    The frequencies of all sets are counted, in one aggregation with partial counts. As the frequencies add up to the
    number of sets times their mean size, at most mean size / share tokens reach the driver, however many sets there are.
    """
    n = sets.count()
    rows = (
        sets.select(F.explode(column).alias("_t")).groupBy("_t").agg(F.count("*").alias("_n"))
        .where(F.col("_n") >= max(2.0, share * n)).toPandas()
    )
    rows = rows.sort_values("_t")
    return rows["_t"].to_numpy(np.int64), rows["_n"].to_numpy(np.int64), n


def ranks(tokens: np.ndarray, frequent: np.ndarray, counts: np.ndarray, seed: int = 0) -> np.ndarray:
    """A global order of tokens as one number each: the rare ones first, by a hash, then the frequent ones by frequency."""
    mixed = (tokens.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
    out = (mixed ^ (mixed >> np.uint64(32))) >> np.uint64(24)  # 40 bits
    if len(frequent):
        k = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        hit = frequent[k] == tokens
        out = out + np.where(hit, counts[k] + 1, 0).astype(np.uint64) * np.uint64(1 << 40)
    return out
