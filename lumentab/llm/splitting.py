"""Splitting oversized items at natural boundaries, by structure-tree packing.

A text is parsed into a tree: sections under headings of the first level, those of the second within them and so on,
paragraphs between blank lines, list items by their indentation, lines, sentences, words, characters. Only a node above the
limit is descended into; the pieces of its children are merged again, in order, as long as they fit. Every piece after the
first begins with the last overlap_chars characters of the text before it.

All positions are code points. A piece is never longer than max_chars, and the pieces without their overlaps are, put
together, the text. A text within the limit is one piece. Null and empty texts have none. A max_chars below 1 or null, and
files whose suffix has no limit, leave the text whole; an overlap that would leave no room counts as the limit less one.
Rows repeated with the same key and text are split once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_LINE = re.compile(r"\n+")
_ITEM = re.compile(r"(?<=\s)(?=(?:[-*•‣▪]|\d{1,3}[.)])\s)")
_SENTENCE = re.compile(r"(?<=[.?!])\s+")
_SPACE = re.compile(r"\s+")

_MARK = r"(?:[-*+•‣▪·]|\d{1,3}[.)]|[A-Za-z][.)])[ \t]"


def _section(depth: int) -> re.Pattern:
    """Before a heading of at most this depth."""
    return re.compile(rf"^(?=[ \t]*(?:#{{1,{depth}}}[ \t]|<h[1-{depth}]\b))", re.M | re.I)


def _list(indent: int | None) -> re.Pattern:
    """Before a line that is a list item of at most this indentation (a tab counts as two); of any where there is none."""
    blanks = r"[ \t]*" if indent is None else "" if indent == 0 else rf"(?:[ ]{{0,{indent}}}|\t{{1,{indent // 2}}})"
    return re.compile(rf"^(?={blanks}{_MARK})", re.M)


#: What separates the children of a node, from the top of the tree down; separators belong to the child before them.
LEVELS = (
    *((f"section {k}", _section(k)) for k in range(1, 7)), ("paragraph", _BLANK), *((f"item {k}", _list(k)) for k in (0, 2, 4, 8)), ("item", _list(None)),
    ("line", _LINE), ("inline item", _ITEM), ("sentence", _SENTENCE), ("word", _SPACE),
)


def children(text: str, start: int, end: int, separator: re.Pattern) -> list[tuple[int, int]]:
    cuts = sorted({m.end() for m in separator.finditer(text, start, end) if start < m.end() < end})
    return list(zip([start, *cuts], [*cuts, end]))


def spans(text: str, limit: int, room: int) -> list[tuple[int, int]]:
    """Consecutive spans that cover the text: the first of at most limit characters, the others of at most room."""

    def pack(start: int, end: int, level: int, first: bool) -> list[tuple[int, int]]:
        most = limit if first else room
        if end - start <= most:
            return [(start, end)]
        while level < len(LEVELS) and len(kids := children(text, start, end, LEVELS[level][1])) < 2:
            level += 1
        if level == len(LEVELS):
            cuts = [start, *range(start + most, end, room), end]
            return list(zip(cuts, cuts[1:]))
        out: list[tuple[int, int]] = []
        for a, b in kids:
            alone = first and not out
            if out and b - out[-1][0] <= (limit if first and len(out) == 1 else room):
                out[-1] = (out[-1][0], b)  # siblings merge as long as they fit
            elif b - a <= (limit if alone else room):
                out.append((a, b))
            else:
                out.extend(pack(a, b, level + 1, alone))
        return out

    return pack(0, len(text), 0, True) if text else []


def pieces(text: str, max_chars: int, overlap_chars: int) -> list[tuple[int, int, int]]:
    """(begin with overlap, begin, end) of each piece."""
    if not text:
        return []
    if max_chars < 1 or len(text) <= max_chars:
        return [(0, 0, len(text))]
    overlap = max(0, min(overlap_chars, max_chars - 1))
    return [(max(0, a - overlap), a, b) for a, b in spans(text, max_chars, max_chars - overlap)]


def boundary(text: str, max_chars: int) -> str:
    """The first level of the tree at which all parts are within the limit."""
    for name, levels in (("paragraph", (_BLANK,)), ("sentence", (_BLANK, _SENTENCE)), ("word", (_SPACE,))):
        parts = [text]
        for separator in levels:
            parts = [y for x in parts for y in separator.split(x)]
        if all(len(x.strip()) <= max_chars for x in parts):
            return name
    return "none"


def with_limits(chunks: DataFrame, limits: DataFrame, file: str = "file") -> DataFrame:
    """chunks with max_chars and overlap_chars of their file's suffix; the join is small against chunks, whatever its size."""
    suffix = F.lower(F.regexp_extract(F.col(file), r"\.([^./\\]+)$", 1))
    small = limits.select(F.lower(F.trim("suffix")).alias("_suffix"), F.col("max_chars").alias("_max"), F.col("overlap_chars").alias("_overlap")).dropDuplicates(["_suffix"])
    return chunks.withColumn("_suffix", suffix).join(small, "_suffix", "left")


def split_oversized(chunks: DataFrame, limits: DataFrame, key: str = "chunk_id", file: str = "file", text: str = "text", location: str = "location", only_oversized: bool = True) -> DataFrame:
    """(key, file, location, piece_no, begin, end, overlap, text, boundary) for each piece, boundary that of the whole text.

    The location of a piece is that of its chunk and the characters it covers. With only_oversized, texts within their
    limit (nothing to cut) are left out before any Python runs.
    """
    rows = with_limits(chunks.where(F.col(text).isNotNull()), limits, file)
    if only_oversized:
        rows = rows.where((F.col("_max") >= 1) & (F.length(text) > F.col("_max")))
    rows = rows.select(F.col(key).alias("key"), F.col(file).alias("file"), F.col(location).alias("location"), F.col(text).alias("text"), "_max", "_overlap").dropDuplicates(["key", "text"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, f, where, t, most, lap in zip(b["key"], b["file"], b["location"], b["text"], b["_max"], b["_overlap"]):
                most, lap = (0 if pd.isna(x) else int(x) for x in (most, lap))
                level = boundary(t, most) if 0 < most < len(t) else None
                for n, (a0, a, e) in enumerate(pieces(t, most, lap), 1):
                    place = f"characters {a + 1}-{e}" if where is None or pd.isna(where) else f"{where}, characters {a + 1}-{e}"
                    out.append((k, f, place, n, a0, e, a - a0, t[a0:e], level))
            yield pd.DataFrame(out, columns=["key", "file", "location", "piece_no", "begin", "end", "overlap", "text", "boundary"])

    made = rows.mapInPandas(cut, "key string, file string, location string, piece_no int, begin int, end int, overlap int, text string, boundary string")
    return made.withColumnRenamed("key", key).withColumnRenamed("file", file)
