"""Filling fixed-capacity containers with items, as vector bin packing.

A container has three limits at once: tokens, segments (items in it), and loss-bearing tokens. An item's first sentence or
line is its prompt, which bears no loss; where nothing follows it, only its first token bears none, as no token predicts it.
The dot-product heuristic fills one container after the other: of the items that still fit in every dimension it takes the one
whose demand has the largest product with the room left, both as shares of the limits. Items of equal demand are one class, so
that a step looks at classes, not items; for it, prompts are rounded down to a multiple of eight, and loss so rounded up.

A text above the capacity is cut into full pieces and a rest, which is an item like any other; no other text is split. An
item that alone bears more loss than the limit, as full pieces do, therefore has a container of its own. Texts are dealt at
random into groups of about `group` items, each packed by itself, so that no task grows with the input; a group leaves a few
containers not full, which is less than a per mille of its tokens.

Texts without tokens (null or empty) fill nothing and are left out. Each repeated row is an item of its own. Capacities that
are null or below 1 have no containers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .tokenizers import VOCABULARY, prompt_count


PROMPT_STEP = 8


def pack(sizes: np.ndarray, losses: np.ndarray, capacity: int, max_segments: int, max_loss: int) -> np.ndarray:
    """The container of each item; sizes are at most capacity, losses at most sizes."""
    out = np.empty(len(sizes), np.int64)
    kind = sizes.astype(np.int64) << 32 | losses.astype(np.int64)
    order = np.argsort(kind, kind="stable")
    both, first, left = np.unique(kind[order], return_index=True, return_counts=True)
    value, loss = both >> 32, both & 0xFFFFFFFF
    limits = np.array([capacity, max_segments, max(1, max_loss)])
    demand = np.stack([value / capacity, np.full(len(value), 1 / max_segments), loss / limits[2]])
    container, remaining = -1, len(sizes)
    while remaining:
        container += 1
        room = limits.copy()
        top, empty = len(value), True
        while remaining:
            # classes are in order of size: what fits is a prefix of them
            top = int(np.searchsorted(value[:top], room[0], side="right"))
            if room[1] < 1 or not top:
                break
            fits = left[:top] > 0
            if not empty:
                fits &= loss[:top] <= room[2]
            gain = np.where(fits, (room / limits) @ demand[:, :top], -1.0)
            k = top - 1 - int(gain[::-1].argmax())
            if not fits[k]:
                break
            take = 1
            if value[k] * 4 < room[0] and loss[k] * 4 < room[2]:  # many small ones of a class go in together
                take = int(min(left[k], max(1, min(room[0] // max(1, value[k]), room[1], room[2] // max(1, loss[k])) // 4)))
            out[order[first[k] : first[k] + take]] = container
            first[k] += take
            left[k] -= take
            remaining -= take
            room -= (take * value[k], take, take * loss[k])
            empty = False
        if len(value) > 64 and (left == 0).mean() > 0.5:
            keep = left > 0
            value, loss, first, left, demand = value[keep], loss[keep], first[keep], left[keep], demand[:, keep]
    return out


def sized(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens, prompt_tokens), counted once and written to the shared folder."""
    rows = documents.where(F.col(text).isNotNull() & (F.col(text) != ""))
    return staged(rows.select(F.col(key), prompt_count(F.col(text), vocabulary).alias("t")).select(key, "t.*"), "token-sizes")


def fill_containers(sizes: DataFrame, limits: DataFrame, key: str = "doc_id", max_segments: int | None = None, loss_share: float = 0.97, group: int = 40_000) -> DataFrame:
    """(container, capacity, container_id, key, piece_no, token_begin, token_end, loss_tokens) for each piece of each text.

    max_segments: most items of a container, a sixteenth of its tokens where not given; loss_share: most loss-bearing tokens of
    several items, as a share of the capacity.
    """
    kinds = limits.where("capacity_tokens >= 1 AND container IS NOT NULL").select("container", F.col("capacity_tokens").cast("int").alias("capacity")).distinct()
    groups = max(1, math.ceil(sizes.count() / group))
    prompt = F.greatest(F.col("prompt_tokens"), F.lit(1)) if "prompt_tokens" in sizes.columns else F.lit(1)
    items = sizes.select(key, "n_tokens", prompt.alias("prompt")).where("n_tokens > 0").crossJoin(kinds)  # one copy for each kind of container
    items = items.withColumn("group", F.pmod(F.hash(F.lit(5), key, "n_tokens"), F.lit(groups)))

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["capacity"].iloc[0])
        n, prompts = pdf["n_tokens"].to_numpy(np.int64), pdf["prompt"].to_numpy(np.int64)
        most = max_segments or max(1, capacity // 16)
        full = np.where(n > capacity, n // capacity, 0)
        rest = n - full * capacity
        small = np.flatnonzero(rest > 0)
        # of a rest, as much is prompt as the full pieces before it leave of it
        own = np.maximum(prompts[small] - full[small] * capacity, (full[small] == 0).astype(np.int64))
        loss = rest[small] - np.minimum(rest[small], np.maximum(own // PROMPT_STEP * PROMPT_STEP, np.minimum(own, 1)))
        where = pack(rest[small], loss, capacity, most, max(1, int(loss_share * capacity))) if len(small) else np.zeros(0, np.int64)
        used = int(where.max()) + 1 if len(where) else 0
        doc = np.concatenate([np.repeat(np.arange(len(n)), full), small])
        nth = np.concatenate([np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full), full[small]])
        bins = np.concatenate([used + np.arange(full.sum()), where])
        begin = nth * capacity
        end = np.minimum(begin + capacity, n[doc])
        tag = f"{pdf['container'].iloc[0]}-{int(pdf['group'].iloc[0])}-"
        return pd.DataFrame({
            "container": pdf["container"].iloc[0], "capacity": np.int32(capacity), "container_id": [f"{tag}{b}" for b in bins], key: pdf[key].to_numpy()[doc],
            "piece_no": (nth + 1).astype(np.int32), "token_begin": begin.astype(np.int32), "token_end": end.astype(np.int32), "loss_tokens": (end - np.clip(prompts[doc], begin, end)).astype(np.int32),
        })

    kind = dict(sizes.dtypes)[key]
    return items.groupBy("container", "group").applyInPandas(assign, f"container string, capacity int, container_id string, `{key}` {kind}, piece_no int, token_begin int, token_end int, loss_tokens int")


def fill_report(filled: DataFrame) -> DataFrame:
    """(container, capacity, containers, pieces, tokens, unused_share, loss_tokens, most_loss_share) over all containers of a kind;
    most_loss_share: the largest share of loss-bearing tokens of a container of several pieces."""
    one = filled.groupBy("container", "capacity", "container_id").agg(F.count("*").alias("n"), F.sum(F.col("token_end") - F.col("token_begin")).alias("t"), F.sum("loss_tokens").alias("l"))
    return one.groupBy("container", "capacity").agg(
        F.count("*").alias("containers"), F.sum("n").alias("pieces"), F.sum("t").alias("tokens"), F.round(1 - F.sum("t") / (F.count("*") * F.col("capacity")), 6).alias("unused_share"),
        F.sum("l").alias("loss_tokens"), F.round(F.max(F.when(F.col("n") > 1, F.col("l") / F.col("capacity"))), 6).alias("most_loss_share"),
    )
