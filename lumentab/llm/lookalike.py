"""One form for text that looks the same.

Method: the UTF-8 buffer of an Arrow column becomes one array of code points; a table gives for each code point how many
it turns into and where they stand (none for invisible ones); the expansion is one repeat and one gather; marks are put in
canonical order and composed with their bases by binary search over the pairs, all rows of a batch at once.

What is brought to one form: canonical decomposition and composition, full- and half-width forms, Latin and Hebrew ligatures,
no-break and other blanks (runs of blanks become one; a line break counts as a blank), invisible format characters (removed),
letters of Cyrillic, Greek, Armenian and other scripts that are drawn like Latin ones, apostrophes and hyphens.
What stays apart: case, accents, digits against letters, dashes against hyphens, superscripts.

A null stays null, a text of invisible characters becomes empty. Lengths have no limit but memory for one Arrow batch.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters drawn like Latin ones, each list in the order of the Latin letters before it.
LOOKALIKES = {
    "Cyrillic": ("ABCEHIJKMOPSTXYacehijlopqswxyds", "АВСЕНІЈКМОРЅТХҮасеһіјӏорԛѕԝхуԁѕ"),
    "Greek": ("ABEZHIKMNOPTYXovijaup", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιϳαυρ"),
    "Armenian": ("hnouSOL", "հոօսՏՕԼ"),
    "other": ("gilnoqahd", "ɡıǀոഠզɑһԁ"),
}
# Characters that stand for an apostrophe or a hyphen.
APOSTROPHES = "‘’‛ʼʹ′´`ꞌ＇"
HYPHENS = "‐‑−﹣－˗"
# Hebrew ligatures and the letters they are drawn as.
HEBREW = {"װ": "וו", "ױ": "וי", "ײ": "יי", "׳": "'", "ﭏ": "אל"}

SIZE = 0x110000
SPACE = 0x20
_FOLDED_TAGS = ("<wide>", "<narrow>", "<noBreak>")


def _plain(c: str) -> str:
    """The form of one character before marks are composed."""
    if c in HEBREW:
        return HEBREW[c]
    if unicodedata.category(c) in ("Cf", "Cc") and not c.isspace():
        return ""
    if 0xFE00 <= ord(c) <= 0xFE0F or ord(c) in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0):
        return ""
    if c.isspace() or unicodedata.category(c) in ("Zs", "Zl", "Zp"):
        return " "
    if c in APOSTROPHES:
        return "'"
    if c in HYPHENS:
        return "-"
    if 0xAC00 <= ord(c) <= 0xD7A3:
        return c
    how = unicodedata.decomposition(c)
    if not how:
        return c
    tag, _, codes = how.rpartition(">")
    parts = "".join(chr(int(x, 16)) for x in codes.split())
    ligature = tag == "<compat" and len(parts) > 1 and parts.isalpha() and "LIGATURE" in unicodedata.name(c, "")
    if tag and f"{tag}>" not in _FOLDED_TAGS and not ligature:
        return c
    return "".join(map(_plain, parts))


@functools.cache
def tables() -> dict[str, np.ndarray]:
    """Built by rule from the Unicode data of this Python and the lists above, once in each process."""
    like = {b: a for latin, other in LOOKALIKES.values() for a, b in zip(latin, other)}
    count = np.ones(SIZE, np.uint8)
    first = np.arange(SIZE, dtype=np.uint32)
    flat: list[int] = []
    scripts = [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)]
    for cp in scripts:
        c = chr(cp)
        to = "".join(like.get(x, x) for x in _plain(c))
        if to != c:
            count[cp] = len(to)
            if len(to) == 1:
                first[cp] = ord(to)
            elif to:
                first[cp] = SIZE + len(flat)  # where the expansion begins
                flat.extend(map(ord, to))
    ccc = np.zeros(SIZE, np.uint8)
    pairs: dict[int, int] = {}
    for cp in scripts:
        c = chr(cp)
        ccc[cp] = unicodedata.combining(c)
        how = unicodedata.decomposition(c)
        if how and how[0] != "<" and len(how.split()) == 2:
            a, b = (int(x, 16) for x in how.split())
            if unicodedata.normalize("NFC", chr(a) + chr(b)) == c:
                pairs[a << 21 | b] = cp
    keys = np.array(sorted(pairs), np.int64)
    return {"count": count, "first": first, "flat": np.array(flat or [0], np.uint32), "ccc": ccc, "keys": keys, "made": np.array([pairs[k] for k in keys.tolist()], np.uint32)}


def code_points(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all rows together, and where each row begins (one more than rows); a null is an empty row."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    starts = (raw & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(starts)])
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, before[at - at[0]]


def fold_points(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = tables()
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    many = t["count"][points].astype(np.int64)
    if len(points) and (many != 1).any():
        row = np.repeat(row, many)
        first = np.repeat(t["first"][points], many)
        nth = np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)
        out = first.copy()
        long = first >= SIZE
        out[long] = t["flat"][first[long] - SIZE + nth[long]]
    else:
        out = t["first"][points]
    ccc = t["ccc"][out]
    if ccc.any():
        for _ in range(8):  # canonical order of the marks of one base; longer runs are settled by the sort below
            wrong = np.flatnonzero((ccc[1:] > 0) & (ccc[:-1] > ccc[1:]) & (row[1:] == row[:-1]))
            wrong = wrong[np.concatenate([[True], np.diff(wrong) > 1])] if len(wrong) else wrong
            if not len(wrong):
                break
            for a in (out, ccc):
                a[wrong], a[wrong + 1] = a[wrong + 1].copy(), a[wrong].copy()
        else:
            base = np.maximum.accumulate(np.where(ccc == 0, np.arange(len(out)), 0))
            order = np.lexsort((np.arange(len(out)), ccc, base, row))
            out, ccc = out[order], ccc[order]
        while True:
            here = np.flatnonzero((ccc[1:] > 0) & (ccc[:-1] == 0) & (row[1:] == row[:-1]))
            if not len(here):
                break
            key = out[here].astype(np.int64) << 21 | out[here + 1]
            k = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
            hit = t["keys"][k] == key
            if not hit.any():
                break
            out[here[hit]] = t["made"][k[hit]]
            keep = np.ones(len(out), bool)
            keep[here[hit] + 1] = False
            out, ccc, row = out[keep], ccc[keep], row[keep]
    for low, high, step in ((0x1161, 0x1175, 28), (0x11A8, 0x11C2, 1)):  # Korean syllables are put together by rule
        second = np.flatnonzero((out >= low) & (out <= high))
        second = second[second > 0]
        if not len(second):
            continue
        before = out[second - 1].astype(np.int64)
        leads = (before >= 0x1100) & (before <= 0x1112) if step == 28 else (before >= 0xAC00) & (before <= 0xD7A3) & ((before - 0xAC00) % 28 == 0)
        second = second[leads & (row[second - 1] == row[second])]
        b, now = out[second - 1].astype(np.int64), out[second].astype(np.int64)
        out[second - 1] = 0xAC00 + (b - 0x1100) * 588 + (now - low) * 28 if step == 28 else b + now - low + 1
        keep = np.ones(len(out), bool)
        keep[second] = False
        out, row = out[keep], row[keep]
    blank = out == SPACE
    again = blank[1:] & blank[:-1] & (row[1:] == row[:-1])
    if again.any():
        keep = np.concatenate([[True], ~again])
        out, row = out[keep], row[keep]
    return out, np.searchsorted(row, np.arange(len(at)))


def fold_arrow(texts: pa.Array) -> pa.Array:
    """Each text in its one form; nulls stay null."""
    points, at = code_points(texts)
    out, at = fold_points(points, at)
    data = out.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (out >= 0x80).astype(np.int64) + (out >= 0x800) + (out >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(width)])[at].astype(np.int64)
    made = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(data))
    if texts.null_count:
        import pyarrow.compute as pc

        made = pc.if_else(pc.is_valid(texts), made, pa.scalar(None, pa.large_string()))
    return made.cast(pa.string()) if len(data) < 2**31 - 1 else made


def _as_arrow(texts: pd.Series) -> pa.Array:
    return pa.array(texts, pa.string(), from_pandas=True)


@F.pandas_udf(T.StringType())
def fold(texts: pd.Series) -> pd.Series:
    return fold_arrow(_as_arrow(texts)).to_pandas()


@F.pandas_udf(T.StringType())
def _fold_repeated(texts: pd.Series) -> pd.Series:
    """fold, each distinct text of a batch once."""
    coded = _as_arrow(texts).dictionary_encode()
    return fold_arrow(coded.dictionary).take(coded.indices).to_pandas()


# so that the optimiser neither repeats it nor runs it over rows that the filters before it leave out
_fold_repeated = _fold_repeated.asNondeterministic()


def fold_text(text: str) -> str:
    return fold_arrow(pa.array([text], pa.string()))[0].as_py()


def folded(df: DataFrame, column: str, into: str | None = None) -> DataFrame:
    """df with column (or a copy of it) in one form."""
    return df.withColumn(into or column, fold(F.col(f"`{column}`")))


def lookalike_quotes(quotes: DataFrame, chunks: DataFrame, quote_id: str = "quote_id", source_id: str = "source_id", quote: str = "quote", chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """Ids of the quotes that read the same as a stretch of their chunk, though no such characters stand in it.

    Quotes with a null or unknown source, and quotes without a visible character, are no cases. Repeated chunks and quotes
    give one row.
    """
    q = quotes.where(F.col(source_id).isNotNull() & F.col(quote).isNotNull()).select(F.col(quote_id).alias("_id"), F.col(source_id).alias("_chunk"), F.col(quote).alias("_quote")).distinct()
    c = chunks.where(F.col(chunk_id).isNotNull() & F.col(text).isNotNull()).select(F.col(chunk_id).alias("_chunk"), F.col(text).alias("_text")).distinct()
    both = q.join(c, "_chunk").where(~F.contains("_text", "_quote"))
    # rows of one chunk follow each other after the join, and its text is folded once for all of them
    found = both.select("_id", _fold_repeated("_quote").alias("_q"), _fold_repeated("_text").alias("_t"))
    return found.where((F.trim("_q") != "") & F.contains("_t", F.trim("_q"))).select(F.col("_id").alias(quote_id)).distinct()
