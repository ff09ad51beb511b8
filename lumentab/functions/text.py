"""Text functions of the corpus and evaluation operators. All are column expressions; only compatibility forms of Unicode, which
Spark lacks, are made in Python, batch by batch and for texts beyond ASCII only."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}_]+"
BLANKS = r"[ \t\n\x0B\f\r\x1C-\x1F\x85\xA0  -     　]"  # fixed value: white space
# a terminator with no digit on either side, or line breaks
CLAIM_END = r"(?<![0-9])[.!?;](?![0-9])|\n+"
# the same, or a bullet, a number of a list, a cell's border
STATEMENT_END = CLAIM_END + r"|[ \t\n\r\f][-–•▪][ \t\n\r\f]|[ \t\n\r\f][0-9]+[.)][ \t\n\r\f]|\|"
# What stands before an item of a list; vowel points; quotes that a name may have or lack; attached Hebrew letters.
BULLET = r"^[ \t\n\x0B\f\r]*(?:[-*•·]|[0-9]+[.)]|[א-ת][.)])[ \t\n\x0B\f\r]*"
NIQQUD = "[\u0591-\u05C7]"
NAME_QUOTES = "[\"'\u05F3\u05F4\u2018\u2019\u201C\u201D`]"
ATTACHED = "והבלכמש"


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def flat(c: Column) -> Column:
    """c without outer blanks, inner ones reduced to one."""
    return F.trim(F.regexp_replace(c, f"{BLANKS}+", " "))


def folded_case(c: Column) -> Column:
    """Lower case in which ß and ss are alike."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def derived_claims(c: Column) -> Column:
    """The statements of an answer, each once, in order, without bullets; the whole text where it has none."""
    parts = F.filter(F.transform(F.split(c, CLAIM_END), lambda x: flat(F.regexp_replace(x, BULLET, ""))), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    return F.when(F.size(parts) > 0, F.array_distinct(parts)).when(c.isNotNull(), F.array(flat(c)))


def statements(c: Column, least: int = 4) -> Column:
    """Distinct statements of at least so many words, each as its words in lower case."""
    plain = F.regexp_replace(c, r"\*\*|__|`|#{1,6}[ \t\n\r\f]", " ")
    word_lists = F.filter(F.transform(F.split(plain, STATEMENT_END), lambda x: words(folded_case(x))), lambda w: F.size(w) >= least)
    return F.array_distinct(F.transform(word_lists, lambda w: F.array_join(w, " ")))


def information_units(c: Column) -> Column:
    """The number of statements; at least 1 for a text that isn't blank."""
    return F.when(flat(c) == "", 0).otherwise(F.greatest(F.size(statements(c)), F.lit(1)))


def specific_sentences(c: Column, most: int = 8) -> Column:
    """The first sentences that have at least three words and a digit or a quoted name."""
    parts = F.transform(F.split(c, r"(?<=[.!?;:])|\n+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    good = F.filter(parts, lambda x: (F.size(words(x)) >= 3) & x.rlike("[0-9]|\"[^\"]+\"|“[^”]+”|«[^»]+»"))
    return F.slice(good, 1, most)


def middle_cut(c: Column, most: int, marker: str = " [...] ") -> Column:
    """At most so many characters: two thirds from the head, one third from the tail, a marker between."""
    room = max(0, most - len(marker))
    head = room * 2 // 3
    tail = room - head
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, head), F.lit(marker), F.when(F.lit(tail > 0), F.right(c, F.lit(tail))).otherwise("")))


def quote_window(text: Column, quote: Column, most: int, marker: str = "[...]") -> Column:
    """At most so many characters of a text around a quote of it, markers where something is left out; null without the quote."""
    at = F.instr(text, quote)
    room = F.greatest(F.lit(most) - F.length(quote), F.lit(0))
    start = F.greatest(F.lit(1), at - F.floor(room / 2).cast("int"))
    start = F.greatest(F.lit(1), F.least(start, F.length(text) - F.lit(most) + 1))
    piece = F.substring(text, start, F.lit(most))
    return F.when(at > 0, F.concat(F.when(start > 1, marker).otherwise(""), piece, F.when(start + most - 1 < F.length(text), marker).otherwise("")))


def sliding_windows(c: Column, size: int, overlap: int) -> Column:
    """Pieces of size characters, each beginning size - overlap after the one before."""
    step = size - overlap
    starts = F.when(F.length(c) > 0, F.sequence(F.lit(0), F.length(c) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.substring(c, i + 1, F.lit(size)).alias("piece")))


def simpler(variant: Column, parent: Column) -> Column:
    """A variant of a long parent must be shorter than it."""
    return (F.length(parent) < 40) | (F.length(variant) <= 0.85 * F.length(parent))


def front_matter(c: Column, field: str) -> Column:
    return F.trim(F.regexp_extract(c, rf"(?m)^{re.escape(field)}:[ \t]*(.*)$", 1))


def content_id(prefix: str, c: Column, digits: int = 16) -> Column:
    """A stable id: the prefix and the first hex digits of the content's SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, digits))


def seeded(seed: int | str, c: Column) -> Column:
    """A sort key for a shuffle that is the same on every run and engine."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), c.cast("string")), 256)


# --- names and quotes in one form ----------------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def compatible(texts: pd.Series) -> pd.Series:
    """Compatibility forms (NFKC) of a batch of texts; nulls stay null. (Arrow's own function doesn't compose.)"""
    return pd.Series([x if x is None or x.isascii() else unicodedata.normalize("NFKC", x) for x in texts], dtype=object)


def plain_name(c: Column | str) -> Column:
    """A name for comparisons: without vowel points and quotes, in one case, words by one blank."""
    bare = F.regexp_replace(compatible(c), f"{NIQQUD}|{NAME_QUOTES}", "")
    return F.trim(F.regexp_replace(folded_case(bare), r"[^\p{L}\p{N}_\u0590-\u05FF]+", " "))


def plain_words(c: Column | str) -> Column:
    """The words of a text in the form of plain_name."""
    return F.filter(F.split(plain_name(c), " "), lambda w: w != "")


def plain_quote(c: Column | str) -> Column:
    """A quote for comparisons: one kind of quotes and hyphens, without emphasis, heading marks, vowel points and invisible
    characters, blanks reduced to one, in one case."""
    t = F.translate(compatible(c), "״“”„׳‘’־", 4 * '"' + 3 * "'" + "-")
    t = F.regexp_replace(t, r"\*\*|__|~~|`|(?:(?<=\s)|^)#{1,6}(?=\s)|[\u200b-\u200f\u202a-\u202e\u2066-\u2069\ufeff]", "")
    return folded_case(flat(F.regexp_replace(t, NIQQUD, "")))


def _attached(c: Column, n: int) -> Column:
    """Whether a word begins with n attached letters and has three more at least."""
    return c.rlike(f"^[{ATTACHED}]{{{n}}}.{{3,}}$")


def bare_forms(c: Column) -> Column:
    """What a word may be without one attached letter, and without two; these are only proposals."""
    both = F.array(F.when(_attached(c, 1), F.substring(c, F.lit(2), F.length(c))), F.when(_attached(c, 2), F.substring(c, F.lit(3), F.length(c))))
    return F.filter(both, lambda x: x.isNotNull())


def document_terms(tokens: Column) -> Column:
    """A document's terms: its words, and marked with ~ what they may be without attached letters."""
    return F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), F.transform(bare_forms(t), lambda x: F.concat(F.lit("~"), x)))))


def text_terms(c: Column | str) -> Column:
    """document_terms of plain_words, in another order: the marked forms are put into the whole text, not made word by word."""
    a = f"[{ATTACHED}]"
    both = F.regexp_replace(plain_name(c), f"(?<![^ ])({a}({a}([^ ]{{3,}})))(?![^ ])", "$1 ~$2 ~$3")
    return F.filter(F.split(F.regexp_replace(both, f"(?<![^ ])({a}((?!{a}[^ ]{{3}})[^ ]{{3,}}))(?![^ ])", "$1 ~$2"), " "), lambda w: w != "")


def question_terms(tokens: Column) -> Column:
    """A query's terms: its words as they are and marked, and unmarked what they may be without attached letters. A word so meets
    itself and its own form with letters attached, but not another word that has but the rest in common."""
    return F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t, F.concat(F.lit("~"), t)), bare_forms(t))))


def word_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two arrays of words; a word counts without its attached letters where that form stands in either of them."""
    known = F.array_union(a, b)
    own = lambda ws: F.array_distinct(F.transform(ws, lambda t: F.coalesce(F.get(F.filter(bare_forms(t), lambda x: F.array_contains(known, x)), F.lit(0)), t)))
    x, y = own(a), own(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def name_keys(c: Column | str) -> Column:
    """The forms under which a name is met: that of plain_name, and where it has several words or quotes in it, the one without
    the letters attached to its first word."""
    surface = F.col(c) if isinstance(c, str) else c
    name = plain_name(surface)
    first = F.substring_index(name, " ", 1)
    rest = F.substring(name, F.length(first) + 1, F.length(name))
    one = F.when((F.length(first) >= 4) & first.rlike(f"^[{ATTACHED}]"), F.substring(first, F.lit(2), F.length(first)))
    two = F.when((F.length(one) >= 4) & one.rlike(f"^[{ATTACHED}]"), F.substring(one, F.lit(2), F.length(one))).otherwise(one)
    loose = surface.rlike(NAME_QUOTES) | F.contains(name, F.lit(" "))
    keys = F.filter(F.array(name, F.when(loose, F.concat(two, rest))), lambda x: x.isNotNull())
    return F.when(F.coalesce(name, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(keys))


def locate_quote(text: str, quote: str) -> tuple[int, int] | None:
    """The span of a quote in a text, word by word; fragments between ellipses must follow each other."""
    spans = [(m.start(), m.end(), m.group().casefold()) for m in re.finditer(r"\w+", text)]
    at, begin, end = 0, None, None
    for fragment in re.split(r"\.{3,}|…|\[\.\.\.\]", quote):
        want = [m.casefold() for m in re.findall(r"\w+", fragment)]
        if not want:
            continue
        for i in range(at, len(spans) - len(want) + 1):
            if [s[2] for s in spans[i : i + len(want)]] == want:
                begin = spans[i][0] if begin is None else begin
                end = spans[i + len(want) - 1][1]
                at = i + len(want)
                break
        else:
            return None
    return None if begin is None else (begin, end)
