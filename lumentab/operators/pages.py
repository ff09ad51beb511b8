"""Page lines to Markdown: body size, headings, bullets, tables, running lines, right-to-left text."""

from __future__ import annotations

import math
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BULLET = re.compile(r"^\s*(?:[•●▪‣◦*·–-]|\d{1,3}[.)])\s+")


def is_rtl(text: str) -> bool:
    strong = [unicodedata.bidirectional(c) for c in text]
    right = sum(x in ("R", "AL") for x in strong)
    return right > sum(x == "L" for x in strong)


def visual_to_logical(text: str) -> str:
    """A right-to-left line stored in the order it is seen: turned around, with its numbers and Latin words kept."""
    if not is_rtl(text):
        return text
    swap = str.maketrans("()[]{}<>«»", ")(][}{><»«")
    turned = text[::-1].translate(swap)
    return re.sub(r"[A-Za-z0-9](?:[A-Za-z0-9.,:/@%_+-]*[A-Za-z0-9%])?", lambda m: m.group()[::-1], turned)


def garbled(text: str) -> bool:
    """Whether a text layer is of no use: more than 30 % of it are private or undefined characters."""
    seen = [c for c in text if not c.isspace()]
    return bool(seen) and sum(unicodedata.category(c) in ("Co", "Cn", "Cc") or c == "�" for c in seen) > 0.3 * len(seen)


def table_markdown(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    cell = lambda x: " ".join((x or "").split()).replace("|", "\\|")
    lines = ["| " + " | ".join(cell(x) for x in [*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]) if rows else ""


def body_sizes(lines: DataFrame) -> DataFrame:
    """(file, body): the size in which most characters of a file are set; the smaller of two."""
    n = lines.where("size IS NOT NULL AND trim(text) <> ''").groupBy("file", "size").agg(F.sum(F.length("text")).alias("n"))
    return n.groupBy("file").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("body"))


def running_lines(lines: DataFrame) -> DataFrame:
    """(file, line, pages): lines (without their numbers) on at least half of a file's pages, and on two."""
    key = F.trim(F.regexp_replace(F.regexp_replace("text", "[0-9]+", "#"), r"\s+", " "))
    pages = lines.groupBy("file").agg(F.countDistinct("page").alias("all"))
    n = lines.where("trim(text) <> ''").groupBy("file", key.alias("line")).agg(F.countDistinct("page").alias("pages"))
    return n.join(pages, "file").where(F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("all") / 2))).select("file", "line", "pages")


def page_markdown(lines: list[tuple[str, float, bool]], body: float) -> str:
    """Markdown of one page from (text, size, bold) in reading order."""
    out: list[str] = []
    for text, size, bold in lines:
        t = " ".join(text.split())
        if not t:
            out.append("")
        elif size and body and size >= 1.15 * body:
            out.append(f"{'#' * (1 if size >= 1.6 * body else 2)} {t}")
        elif bold and len(t) < 80 and t[-1] not in ".!?,;":
            out.append(f"### {t}")
        elif _BULLET.match(t):
            out.append(f"- {_BULLET.sub('', t)}")
        elif out and out[-1] and not out[-1].startswith(("#", "- ")):
            out[-1] += f" {t}"
        else:
            out.append(t)
    return "\n\n".join(x for x in out if x)


def pages_of(count: int, per_call: int) -> list[tuple[int, int]]:
    """Balanced ranges of pages for calls of at most so many."""
    n = max(1, math.ceil(count / per_call))
    base, extra = divmod(count, n)
    out, at = [], 1
    for i in range(n):
        size = base + (i < extra)
        out.append((at, at + size - 1))
        at += size
    return out
