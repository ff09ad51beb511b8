"""Noise in text from scanned pages: broken words, misread characters, running headers and page numbers.

Method: a noisy channel. The corpus gives the counts of its frequent words (all that reach a share of its tokens, so that
their number has a bound), of word pairs (one table of fixed size, filled by hash) and of the shapes of codes and numbers.
A word may stand for every frequent word that one or two confusions of characters turn into it; its probability is that of the
confusions between the two. The Viterbi decoder takes, line by line, the most probable
sequence of candidates under channel and word pairs; words that come out changed are misread.

Words broken at line ends are put together before they are looked up; a hyphen is the word's own if the corpus has the
hyphenated word more often. Headers and page numbers are told by place, size, and repetition within the file. The pieces
of work are pages and chunks, never files, and no table of the corpus is joined line by line.

Null and empty texts have no noise. Rows repeated exactly count once. Lines without a page are taken in blocks of
200 line numbers; null sizes make lines be judged by repetition alone.
"""

from __future__ import annotations

import functools
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

# Character groups confused in scans, as (read, meant), lower case.
CONFUSIONS = [
    ("rn", "m"), ("ri", "n"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("li", "h"), ("nn", "m"), ("in", "m"), ("iii", "m"), ("lc", "k"), ("m", "rn"), ("d", "cl"), ("w", "vv"), ("h", "li"),
    ("0", "o"), ("1", "l"), ("1", "i"), ("i", "l"), ("l", "i"), ("5", "s"), ("9", "g"), ("8", "b"), ("6", "b"), ("e", "c"), ("c", "e"), ("f", "t"), ("t", "f"),
    ("b", "h"), ("h", "b"), ("n", "u"), ("u", "n"), ("3", "e"), ("4", "a"), ("7", "t"), ("2", "z"), ("|", "l"), ("!", "l"), ("q", "g"), ("6", "g"),
    ("ח", "ת"), ("ת", "ח"), ("ה", "ח"), ("ח", "ה"), ("ב", "כ"), ("כ", "ב"), ("ד", "ר"), ("ר", "ד"), ("ו", "ן"), ("ן", "ו"), ("ם", "ס"), ("ס", "ם"), ("ג", "נ"), ("נ", "ג"), ("י", "ו"), ("ו", "י"), ("צ", "ע"), ("ך", "ד"),
]
# What a character of a code or number may be misread from.
CODE_CONFUSIONS = {"O": "0", "o": "0", "Q": "0", "D": "0", "l": "1", "I": "1", "|": "1", "i": "1", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2", "g": "9", "q": "9", "G": "6", "b": "6", "0": "O", "1": "Il", "5": "S", "8": "B", "2": "Z", "6": "G"}
HYPHENS = "-­¬‐"
ERROR = 0.012  # of one confusion
_LETTERS = str.maketrans("0159864", "olsgbba")
WORD = re.compile(r"[^\W_]+(?:[-'’./,|][^\W_]+)*")
EDGE = "\"'“”„‘’«».,;:!?()[]{}<>*©|·–—"
ENDS = ".!?:;…"
BUCKETS = 1 << 20
PAGE_WORDS = r"page|pages|pg|p|seite|s|página|pagina|pág|pag|blatt|folio|feuille|עמוד|דף|עמ"
_NUMBER = r"(?:[0-9lIOoSBi|]{1,5}|[ivxlcIVXLC]{1,7})"
PAGE_NUMBER = re.compile(rf"(?i)^[\W_]*(?:(?:{PAGE_WORDS})\b\.?\s*)?{_NUMBER}(?:\s*(?:/|of|von|de|sur|di|van|מתוך|\||-)\s*{_NUMBER})?[\W_]*$")


def skeleton_column(text: Column) -> Column:
    """What is left of a running line when its numbers change or its letters are misread."""
    low = F.translate(F.lower(text), "0159l|!", "oisgiii")
    return F.regexp_replace(F.regexp_replace(low, r"[0-9]+", ""), r"[^\p{L}]+", "")


@functools.cache
def _by_read() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for a, b in CONFUSIONS:
        out.setdefault(a, []).append(b)
    return out


@functools.cache
def _coarse_table() -> dict[int, str | None]:
    """Deletes every character of a confusion of groups, and those confused with them; what is left of a word no confusion
    changes, but for classes that are written as one character."""
    gone = {c for a, b in CONFUSIONS if len(a) > 1 or len(b) > 1 for c in a + b}
    while more := {c for a, b in CONFUSIONS if (a in gone) != (b in gone) and len(a) == len(b) == 1 for c in a + b} - gone:
        gone |= more
    same: dict[str, str] = {}
    for a, b in CONFUSIONS:
        if len(a) == len(b) == 1 and a not in gone:
            x, y = same.get(a, a), same.get(b, b)
            for k in [k for k, v in same.items() if v == x]:
                same[k] = y
            same[a] = same[b] = y
    return {ord(c): None for c in gone} | {ord(k): v for k, v in same.items()}


def coarse(word: str) -> str:
    """Equal for words that any confusions turn into each other (and for some others)."""
    return word.translate(_coarse_table())


def meanings(word: str) -> set[str]:
    """What word may have been before one confusion."""
    table = _by_read()
    return {word[:i] + to + word[i + n :] for n in (1, 2, 3) for i in range(len(word) - n + 1) for to in table.get(word[i : i + n], ())}


@functools.lru_cache(200_000)
def channel(read: str, meant: str) -> float:
    """Log probability that meant is read as read: the best way of confusions between the two, -inf if there is none."""
    best = {(0, 0): 0.0}
    step = math.log(ERROR)
    for i in range(len(read) + 1):
        for j in range(len(meant) + 1):
            here = best.get((i, j))
            if here is None:
                continue
            if i < len(read) and j < len(meant) and read[i] == meant[j]:
                best[(i + 1, j + 1)] = max(best.get((i + 1, j + 1), -math.inf), here)
            for a, b in CONFUSIONS:
                if read.startswith(a, i) and meant.startswith(b, j):
                    k = (i + len(a), j + len(b))
                    best[k] = max(best.get(k, -math.inf), here + step)
    return best.get((len(read), len(meant)), -math.inf)


class _Shapes(dict):
    def __missing__(self, k: int) -> str:
        c = chr(k)
        self[k] = out = "9" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c
        return out


_SHAPES = _Shapes()


def shape(word: str) -> str:
    return word.translate(_SHAPES)


def word_class(word: str) -> str:
    """Numbers, capitalised words, and all others by themselves, in lower case."""
    return "#" if any(c.isdigit() for c in word) else "^" if word[:1].isupper() else word.lower()


class _Kept(dict):
    """What a function says of each word, said once; emptied when it has grown too large."""

    def __init__(self, f, most: int = 1_000_000):
        self.f, self.most = f, most

    def __missing__(self, word: str):
        if len(self) >= self.most:
            self.clear()
        self[word] = out = self.f(word)
        return out


_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


@functools.cache
def _kinds() -> np.ndarray:
    """By code point: 1 for letters and digits, 2 for what may join two of them into one word, 3 for other visible characters."""
    out = np.full(0x110000, 3, np.uint8)
    for cp in range(0x32400):  # there are no letters, digits or blanks beyond
        if not 0xD800 <= cp < 0xE000:
            c = chr(cp)
            out[cp] = 1 if c.isalnum() else 0 if c.isspace() else 3
    out[[ord(c) for c in "-'’./,|"]] = 2
    return out


@functools.cache
def _digits_and_capitals() -> tuple[np.ndarray, np.ndarray]:
    digit, capital = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for cp in range(0x20000):
        c = chr(cp)
        digit[cp], capital[cp] = c.isdigit(), c.isupper()
    return digit, capital


@functools.cache
def _lower_and_shapes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: its lower case (0 where that is longer), the character of its shape, whether it is a lower-case letter."""
    low, form, small = np.arange(0x110000, dtype=np.uint32), np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for cp in range(0x32400):
        if not 0xD800 <= cp < 0xE000:
            c = chr(cp)
            to = c.lower()
            low[cp] = ord(to) if len(to) == 1 else 0
            form[cp] = ord(_SHAPES[cp])
            small[cp] = c.islower()
    return low, form, small


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_POWERS[0]) < n:
        for k, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[k] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, x, np.uint64)]))
    return _POWERS


def tokens_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, starts, ends, hashes, lines) of all matches of WORD in text, whose lines end in line feeds."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = _kinds()[points]
    word = np.zeros(len(points) + 2, np.int8)
    word[1:-1] = kind == 1
    word[2:-2] |= ((kind[1:-1] == 2) & (kind[:-2] == 1) & (kind[2:] == 1)).view(np.int8) if len(points) > 2 else 0
    turn = np.diff(word)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    return points, start, end, span_hashes(points, start, end), np.searchsorted(np.flatnonzero(points == 10), start)


def span_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each stretch of points, by running sums of their products with powers."""
    power, back = _powers(len(points))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((points + np.uint64(1)) * power[: len(points)])])
    h = (sums[end] - sums[start]) * back[start]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(words: list[str]) -> np.ndarray:
    """span_hashes of whole words, ascending."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    end = np.cumsum([len(w) for w in words], dtype=np.int64)
    return np.unique(span_hashes(points, np.concatenate([[0], end[:-1]]).astype(np.int64), end)) if words else np.zeros(0, np.uint64)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """(number of each token's distinct hash, those hashes, the place of the first token of each)."""
    code, values = pd.factorize(hashes)
    first = np.empty(len(values), np.int64)
    first[code[::-1]] = np.arange(len(hashes))[::-1]
    return code, values.tolist(), first


class Model:
    """Counts of frequent words, word pairs and code shapes, with the decoder over them."""

    def __init__(self, words: dict[str, int], pairs: np.ndarray, shapes: dict[str, int], total: int):
        self.words, self.pairs, self.shapes, self.total = words, pairs, shapes, max(1, total)
        self.most = max(words.values(), default=0)
        self._found: dict[tuple[str, bool], list[str]] = {}
        self.doubt = _Kept(self.doubtful)
        self._mixed: dict[str, str | None] = {}
        self.most_shape = max(shapes.values(), default=0)
        self.shapes_of: dict[int, list[tuple[str, int]]] = {}
        for x, n in sorted(shapes.items(), key=lambda kv: (-kv[1], kv[0])):
            self.shapes_of.setdefault(len(x), []).append((x, n))
        self.coarse = {coarse(w) for w in words if len(w) > 1}

    @functools.cached_property
    def misreadings(self) -> np.ndarray:
        """Hashes of all that one confusion makes of the frequent words."""
        found = {w[:i] + a + w[i + len(b) :] for w in self.words for a, b in CONFUSIONS for i in range(len(w) - len(b) + 1) if w.startswith(b, i)}
        return word_hashes(sorted(found))

    @functools.cached_property
    def known_words(self) -> np.ndarray:
        return word_hashes(sorted(self.words))

    @functools.cached_property
    def safe_words(self) -> np.ndarray:
        """Of these, the ones so frequent that they stand for nothing else."""
        return word_hashes(sorted(w for w, n in self.words.items() if n * 50 > self.most))

    @functools.cached_property
    def sound_shapes(self) -> np.ndarray:
        """Hashes of the shapes so frequent that a code of them is never doubted."""
        return word_hashes(sorted(x for x, n in self.shapes.items() if 25 * n >= self.most_shape))

    def pair(self, a: str, b: str) -> int:
        return int(self.pairs[pair_bucket(a, b)])

    def candidates(self, word: str, two: bool = True) -> list[str]:
        """Frequent words that may stand behind a word by one confusion (or two), at least fifty times as frequent as it."""
        own = self.words.get(word, 0)
        if len(word) < 2 or own * 50 > self.most or coarse(word) not in self.coarse:
            return []
        key = (word, two)
        found = self._found.get(key)
        if found is None:
            least = max(5, 50 * own)
            near = meanings(word)
            found = [c for c in near if self.words.get(c, 0) >= least]
            if not found and two and len(word) > 3:
                found = [c for x in near for c in meanings(x) if self.words.get(c, 0) >= 4 * least and c != word]
            found = sorted(set(found), key=lambda c: (-self.words[c], c))
            if len(self._found) < 300_000:
                self._found[key] = found
        return found

    def doubtful(self, token: str) -> bool:
        """Whether a token may be misread at all."""
        low = token.lower()
        if any(map(str.isdigit, token)):
            return any(map(str.isalpha, token)) and self.mixed(token) is not None
        return bool(self.candidates(low, token.islower() or token.isupper())) or "I" in token[1:] or (low[:1] == "l" and low not in self.words)

    def likelihood(self, before: str, word: str) -> float:
        """Log probability of a word after the class of the word before it; capitalised words stand alone."""
        alone = (self.words.get(word, 0) or 0.05) / self.total
        if before == "^":
            return math.log(alone)
        known = self.words.get(before, 1) if before != "#" else 1000
        seen = self.pair(before, word)
        return math.log((seen + 50.0 * alone) / (max(known, seen) + 50.0))

    def decode(self, line: list[str]) -> list[str]:
        """The most probable words behind a line, in lower case; capitalised words, often names, by one confusion only."""
        low = [w.lower() for w in line]
        lattice = [[x] if any(c.isdigit() for c in w) else [x, *self.candidates(x, w.islower() or w.isupper())] for w, x in zip(line, low)]
        if all(len(x) == 1 for x in lattice):
            return low
        scores: list[dict[str, tuple[float, str | None]]] = [{c: (math.log((self.words.get(c, 0) or 0.05) / self.total) + (channel(low[0], c) if c != low[0] else 0.0), None) for c in lattice[0]}]
        for k in range(1, len(line)):
            single = word_class(line[k])
            now = {}
            for c in lattice[k]:
                emit = 0.0 if c == low[k] else channel(low[k], c)
                best = (-math.inf, None)
                for b, (s, _) in scores[-1].items():
                    kind = word_class(line[k - 1])
                    p = s + (self.likelihood(kind if kind in "#^" else b, c) if single not in "#^" else self.likelihood("^", c))
                    if p > best[0]:
                        best = (p, b)
                now[c] = (best[0] + emit, best[1])
            scores.append(now)
        best = max(scores[-1], key=lambda c: scores[-1][c][0])
        out = [best]
        for k in range(len(line) - 1, 0, -1):
            best = scores[k][best][1]
            out.append(best)
        return out[::-1]

    def mixed(self, token: str) -> str | None:
        """What stands behind a token of letters and digits: a word, a number or a code; null where it is as it should be."""
        if token in self._mixed:
            return self._mixed[token]
        low = token.lower()
        digits, letters = sum(map(str.isdigit, token)), sum(map(str.isalpha, token))
        found = None
        if letters > 1 or digits < 2:
            only = low.translate(_LETTERS)
            found = only if self.words.get(only, 0) >= max(5, 50 * self.words.get(low, 0)) else next(iter(self.candidates(low)), None)
            if found is None and letters >= 3 and letters > digits and re.search(r"[a-zà-ÿ]{2}", token) and all(c in "01598643" for c in token if c.isdigit()) and not re.fullmatch(r"\d+\W?[^\W\d_]{1,3}", token):
                found = only
        found = found or self.code(token)
        if len(self._mixed) < 200_000:
            self._mixed[token] = found
        return found

    def code(self, word: str) -> str | None:
        """The code or number behind a token of digits and letters, where its own shape is rare and that one's frequent: of the
        frequent shapes that confusions turn it into, the one by the fewest of them, the most frequent on a tie."""
        own = self.shapes.get(shape(word), 0)
        if 25 * own >= self.most_shape:
            return None
        least, best, found = max(10, 25 * own), None, None
        for like, n in self.shapes_of.get(len(word), ()):
            if n <= least:
                break  # they come by frequency
            made, edits = [], 0
            for c, kind in zip(word, like):
                if shape(c) == kind:
                    made.append(c)
                    continue
                to = next((x for x in CODE_CONFUSIONS.get(c, "") if shape(x) == kind), None)
                if to is None:
                    break
                made.append(to)
                edits += 1
            else:
                if edits and (best is None or edits < best):
                    best, found = edits, "".join(made)
        return found

    def own_hyphen(self, left: str, right: str) -> bool:
        """Whether left-right is a hyphenated word, rather than one broken at a line's end."""
        if not left or not right or right[0].isupper() or right[0].isdigit() or left[-1].isdigit() or (left[-1].isupper() and len(left) <= 2):
            return True
        a, b = left.lower(), right.lower()
        return self.words.get(f"{a}-{b}", 0) > self.words.get(a + b, 0)


def misread(model: Model, tokens: list[str]) -> list[str | None]:
    """For each token of a line the one behind it, where it was misread; else null."""
    out: list[str | None] = [None] * len(tokens)
    flags = list(map(model.doubt.__getitem__, tokens))
    if True not in flags:
        return out
    doubt = [i for i, f in enumerate(flags) if f]
    # all other words stand for themselves only, so that the decoder's paths meet in them: it runs from one to the next
    at = 0
    while at < len(doubt):
        first = last = doubt[at]
        while at + 1 < len(doubt) and doubt[at + 1] == last + 1:
            at += 1
            last = doubt[at]
        at += 1
        begin = max(0, first - 1)
        stretch = tokens[begin : last + 2]
        for i, m in enumerate(model.decode(stretch), begin):
            if not first <= i <= last:
                continue
            t = tokens[i]
            if any(map(str.isdigit, t)):
                out[i] = model.mixed(t) if any(map(str.isalpha, t)) else None
            elif m != t.lower():
                out[i] = m
            elif re.search(r"[a-zà-ÿ]I", t) and t.replace("I", "l").lower() in model.words:  # a capital I read as l, or an l as I
                out[i] = t.replace("I", "l").lower()
            elif len(t) > 2 and re.match(r"l[b-df-hj-np-tv-z]", t) and "i" + t[1:].lower() in model.words and t.lower() not in model.words:
                out[i] = "i" + t[1:].lower()
    return out


def broken_end(line: str) -> str | None:
    """The part of a word before the hyphen that ends a line; null where none does."""
    if not line or line[-1].isalnum() or line[-1] in ".,":
        return None
    t = line.rstrip()
    if len(t) < 2 or t[-1] not in HYPHENS or not t[-2].isalpha():
        return None
    return re.search(r"[^\W\d_]+$", t[:-1]).group()


def first_part(line: str) -> str:
    m = re.match(r"\s*[\"'“„«(]*([^\W\d_]+)", line)
    return m.group(1) if m else (line.strip()[:1])


def moved_part(line: str) -> str:
    """The end of a broken word, with its marks, that goes to the page before; empty where the line breaks that word again."""
    part = line.split(None, 1)[:1]
    return part[0] if part and any(map(str.isalpha, part[0])) and (line.strip() != part[0] or broken_end(line) is None) else ""


def unit_noise(model: Model, lines: list[str], roles: list[str | None], after: str | None, before: str | None = None, doubt: Sequence[bool] | None = None) -> tuple[list[set[str]], list[str]]:
    """(noises of each line, its repaired text) for the lines of one page or chunk; after: the first line that follows it;
    before: the last of the page before, where it may break a word; doubt: whether a line has a doubtful word, where that is
    known.

    Repaired lines end in U+0001 where the word goes on in the next line. A word broken at the end of a page is put together
    there, and its end taken from the page after.
    """
    noises: list[set[str]] = [set() for _ in lines]
    fixed = ["" for _ in lines]
    body = [i for i, r in enumerate(roles) if r is None and lines[i].strip()]
    for r, n in zip(roles, noises):
        if r in ("header", "page_number"):
            n.add(r)
    carried = ""  # the beginning of a word whose end stands in this line
    if body and before is not None and (left := broken_end(before)) is not None:
        carried = left + "-" if model.own_hyphen(left, first_part(lines[body[0]])) else left
    taken = moved_part(lines[body[0]]) if carried else ""
    for at, i in enumerate(body):
        text = lines[i]
        tokens = None if doubt is not None else WORD.findall(text)
        doubtful = doubt[i] if tokens is None else True in map(model.doubt.__getitem__, tokens)
        if not carried and not doubtful and (text[-1].isalnum() or broken_end(text) is None):
            fixed[i] = text
            continue
        tokens = WORD.findall(text) if tokens is None else tokens
        follows = lines[body[at + 1]] if at + 1 < len(body) else after
        left = broken_end(text)
        ends_broken = left is not None and (follows is None or not model.own_hyphen(left, first_part(follows)))
        own = left is not None and not ends_broken
        whole = list(tokens)
        if carried and whole:
            whole[0] = carried + whole[0]
        if whole and (ends_broken or own):
            right = first_part(follows or "")
            whole[-1] = whole[-1] + ("-" if own else "") + right
        behind = misread(model, whole)
        out, last = [], 0
        spans = [(m.start(), m.end()) for m in WORD.finditer(text)] if any(behind) else []
        for k, (a, b) in enumerate(spans):
            m = behind[k]
            if m is None:
                continue
            edge = (k == 0 and carried) or (k == len(spans) - 1 and (ends_broken or own))
            if edge:  # the noise is in the part of the word that this line has
                start = len(carried) if k == 0 and carried else 0
                if whole[k].lower()[start : start + b - a] in (m[start : start + b - a], m[len(m) - (b - a) :] if k == 0 else ""):
                    continue
            else:
                out.append(text[last:a] + _case_like(tokens[k], m))
                last = b
            noises[i].add("ocr")
        mended = "".join(out) + text[last:]
        if at == 0 and taken:
            mended = re.sub(r"^\s*\S+", "", mended)
        given = moved_part(after) if at + 1 == len(body) and after is not None else ""
        if ends_broken:
            noises[i].add("hyphen")
            fixed[i] = mended.rstrip()[:-1] + (given or "\u0001")
        elif own:
            fixed[i] = mended.rstrip() + (given or "\u0001")
        else:
            fixed[i] = mended
        carried = left if ends_broken else (left + "-" if own else "")
    return noises, fixed


def _case_like(was: str, now: str) -> str:
    if any(c.isupper() for c in now):
        return now
    if was.isupper() and len(was) > 2:
        return now.upper()
    return now[:1].upper() + now[1:] if was[:1].isupper() else now


def paragraphs(fixed: list[str], roles: list[str | None], lines: list[str]) -> list[str]:
    """Continuous paragraphs of repaired lines; a blank line, and a short last line of a sentence, ends one."""
    return open_paragraphs(fixed, roles, lines)[0]


def open_paragraphs(fixed: list[str], roles: list[str | None], lines: list[str], after: str | None = None) -> tuple[list[str], bool]:
    """(paragraphs, whether the last one goes on in the page whose first line is after)."""
    width = max((len(x) for x, r in zip(lines, roles) if r is None), default=0)
    out, now = [], ""
    for k, (text, role) in enumerate(zip(fixed, roles)):
        if role is not None:
            continue
        if not lines[k].strip():
            if now and not now.endswith("\u0001"):
                out.append(now)
                now = ""
            continue
        if now.endswith("\u0001"):
            now = now[:-1] + text.lstrip()
        else:
            now = f"{now} {text.strip()}" if now else text.strip()
        if text.rstrip().endswith((".", "!", "?")) and len(lines[k]) < 0.75 * width:
            out.append(now)
            now = ""
    goes_on = bool(now) and after is not None
    if goes_on and now[-1] in ".!?" and (part := moved_part(after)) == after.strip() and now.endswith(part):
        last = [x for x, r in zip(lines, roles) if r is None and x.strip()][-1]
        goes_on = broken_end(last) is None  # the one word of that line was all that was left
    if now:
        out.append(now.rstrip("\u0001"))
    return out, goes_on


def count_lines(batches: Iterator[pd.DataFrame], most: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """(tag, key, n): words (w), hash values of pairs (p) and shapes of codes (s) of all lines of texts, summed up as far as
    memory allows before they leave the task. Words are found in arrays of code points; Python sees each distinct one once."""
    known: dict[int, int] = {}
    words: list[str] = []
    coded: list[bool] = []  # whether a word has a digit
    counts, classes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    digit, capital = _digits_and_capitals()
    number, name = class_hash("#"), class_hash("^")
    pairs = np.zeros(BUCKETS, np.int64)
    hyphen = np.zeros(0x110000, bool)
    hyphen[[ord(c) for c in HYPHENS]] = True

    def sums() -> pd.DataFrame:
        low: Counter[str] = Counter()
        shapes: Counter[str] = Counter()
        for w, has, n in zip(words, coded, counts.tolist()):
            if n:
                low[w.lower()] += n
                if has:
                    shapes[shape(w)] += n
        some = np.flatnonzero(pairs)
        out = [("w", k, n) for k, n in low.items()] + [("p", str(k), n) for k, n in zip(some.tolist(), pairs[some].tolist())] + [("s", k, n) for k, n in shapes.items()]
        return pd.DataFrame(out, columns=["tag", "key", "n"])

    for b in batches:
        text = "\n".join(b["text"]) + "\n"
        points, start, end, h, line = tokens_of(text)
        if not len(start):
            continue
        # a part of a word at a line's end is no word
        feeds = np.flatnonzero(points == 10)
        last = np.maximum.accumulate(np.where(_kinds()[points] > 0, np.arange(len(points)), -1))[feeds]
        begin = np.concatenate([[0], feeds[:-1] + 1])
        whole = np.ones(len(start), bool)
        for k in np.flatnonzero((last >= begin) & hyphen[points[last]]).tolist():
            if broken_end(text[begin[k] : feeds[k]]) and (i := int(np.searchsorted(start, feeds[k])) - 1) >= 0 and line[i] == k:
                whole[i] = False
        start, end, h, line = start[whole], end[whole], h[whole], line[whole]
        code, values, first = distinct(h)
        fresh = [k for k, v in enumerate(values) if v not in known]
        at = first[fresh]
        digits = np.concatenate([[0], np.cumsum(digit[points])])
        made = []
        for k, a, e, has, big in zip(fresh, start[at].tolist(), end[at].tolist(), (digits[end[at]] > digits[start[at]]).tolist(), capital[points[start[at]]].tolist()):
            known[values[k]] = len(words)
            words.append(text[a:e])
            coded.append(has)
            made.append(number if has else name if big else class_hash(text[a:e].lower()))
        classes = np.concatenate([classes, np.array(made, np.uint64)])
        counts = np.concatenate([counts, np.zeros(len(fresh), np.int64)])
        place = np.array([known[v] for v in values], np.int64)
        counts[place] += np.bincount(code, minlength=len(values))
        of = classes[place][code]
        beside = line[1:] == line[:-1]
        pairs += np.bincount(pair_buckets(of[:-1][beside], of[1:][beside]), minlength=BUCKETS)
        if len(words) > most:
            yield sums()
            known.clear()
            words.clear()
            coded.clear()
            counts, classes = counts[:0], classes[:0]
            pairs[:] = 0
    yield sums()


@functools.lru_cache(200_000)
def class_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode())


def pair_buckets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """pair_bucket of arrays of class hashes."""
    x = a * np.uint64(_BASE) + b
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44)).astype(np.int64)


def pair_bucket(a: str, b: str) -> int:
    x = (class_hash(a) * _BASE + class_hash(b)) & _MASK
    return ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & _MASK) >> 44


def corpus_model(texts: DataFrame, share: float = 5e-6) -> Model:
    """The model of all lines of texts (text), counted in one pass.

    What reaches the driver: at most 1 / share words, as many shapes, and the pair counts of BUCKETS hash values.
    """
    lines = texts.where("text IS NOT NULL AND text <> ''").select("text")
    counts = staged(lines.mapInPandas(count_lines, "tag string, key string, n long").groupBy("tag", "key").agg(F.sum("n").alias("n")), "scan-counts")
    total = counts.where("tag = 'w'").agg(F.sum("n")).first()[0] or 0
    least = max(2, math.ceil(share * total))
    kept = counts.where((F.col("tag") == "p") | (F.col("n") >= least)).toPandas()
    of = lambda tag: kept[kept["tag"] == tag]
    pairs = np.zeros(BUCKETS, np.int64)
    pairs[of("p")["key"].astype(np.int64).to_numpy()] = of("p")["n"].to_numpy()
    return Model(dict(zip(of("w")["key"], of("w")["n"])), pairs, dict(zip(of("s")["key"], of("s")["n"])), int(total))


def page_units(lines: DataFrame, salts: int = 16) -> DataFrame:
    """(kind, unit, file, page, keys, texts, flags, running, after, before): one row for each page, its lines in order with
    flags of place, size and repetition, the first body line of the next page, and the last of the page before if it may break a
    word.

    The texts are put together once, in a table; what is found out about a page is read from its edges: the margin lines (the
    first and last two filled ones) and the five lines at either end, of which four at most can be in the margins.
    """
    page = F.coalesce("page", F.lit(-1) - F.floor(F.coalesce("line_no", F.lit(0)) / 200)).cast("int").alias("page")
    filled = (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).alias("filled")
    rows = lines.where("line_id IS NOT NULL").select(F.coalesce("file", F.lit("")).alias("file"), page, F.struct("line_no", "line_id", "text", "size", filled).alias("r"))
    pages = rows.groupBy("file", "page").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    pages = pages.withColumn("rows", F.filter("rows", lambda r, i: (i == 0) | ~r.eqNullSafe(F.get("rows", i - 1))))  # each row once
    pages = pages.withColumn("kept", F.filter("rows", lambda r: r["filled"])).withColumn("solid", F.filter("rows", lambda r: r["text"].rlike(r"(?U)[^\s\x1c-\x1f]")))
    end = lambda c, n: F.concat(F.slice(c, 1, n), F.slice(F.reverse(c), 1, n))
    brief = lambda c: F.transform(c, lambda r: F.struct(r["line_id"].alias("id"), r["text"].alias("text")))
    of_size = lambda x: F.filter("kept", lambda r: r["size"] == x)
    mass = lambda x: F.struct(x.alias("size"), F.aggregate(of_size(x), F.lit(0).cast("long"), lambda a, r: a + F.length(r["text"])).alias("n"))
    pages = pages.select(
        "file", "page", F.transform("rows", lambda r: r["line_id"]).alias("keys"), F.transform("rows", lambda r: r["text"]).alias("texts"),
        F.array_distinct(F.transform(end(F.col("kept"), 2), lambda r: F.struct(r["line_id"].alias("id"), r["size"].alias("size"), skeleton_column(r["text"]).alias("skeleton")))).alias("margin"),
        F.transform(F.array_distinct(F.filter(F.transform("kept", lambda r: r["size"]), lambda x: x.isNotNull())), mass).alias("mass"),
        brief(F.slice("solid", 1, 5)).alias("head"), brief(F.slice(F.reverse("solid"), 1, 5)).alias("tail"),
    )
    pages = staged(pages, "scan-pages")
    # the size of most characters of a file; a page of a large file meets it under one of several salts
    by_size = pages.select("file", F.explode("mass").alias("m")).groupBy("file", "m.size").agg(F.sum("m.n").alias("n"))
    body = by_size.groupBy("file").agg(F.max_by("size", F.struct("n", "size")).alias("body")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    edge = pages.select("file", "page", F.explode(F.array_distinct(F.transform("margin", lambda m: m["skeleton"]))).alias("skeleton")).where("length(skeleton) >= 4")
    often = edge.groupBy("file", "skeleton").agg(F.count("*").alias("n")).where("n >= 3")
    running = edge.join(often, ["file", "skeleton"]).select("file", "page", "skeleton", F.lit(None).cast("double").alias("body"))
    known = pages.select("file", "page", F.pmod("page", F.lit(salts)).alias("salt")).join(body, ["file", "salt"]).select("file", "page", F.lit(None).cast("string").alias("skeleton"), "body")
    features = running.unionByName(known).groupBy("file", "page").agg(F.collect_set("skeleton").alias("running"), F.max("body").alias("body"))
    slim = pages.select("file", "page", "margin", "head", "tail").join(features, ["file", "page"], "left")
    small = lambda m: m["size"] < 0.9 * F.col("body")
    runs = lambda m: F.array_contains(F.coalesce("running", F.array().cast("array<string>")), m["skeleton"])
    flag = lambda c, bit: F.when(c, bit).otherwise(0)
    marks = F.transform("margin", lambda m: F.struct(m["id"].alias("id"), (MARGIN + flag(small(m), SMALL) + flag(small(m).isNull(), UNKNOWN) + flag(runs(m), RUNS)).alias("flag")))
    # just the lines to which page_roles gives no role: both pages of a broken word must see the same two lines
    slim = slim.withColumn("marks", marks)
    has_role = lambda i: F.exists("marks", lambda m: (m["id"] == i) & ((m["flag"].bitwiseAND(SMALL) > 0) | ((m["flag"].bitwiseAND(UNKNOWN) > 0) & (m["flag"].bitwiseAND(RUNS) > 0))))
    first = lambda c: F.get(F.filter(c, lambda r: ~has_role(r["id"])), F.lit(0))["text"]
    page, text = F.col("page"), F.lit(None).cast("string")  # lines without a page are in -1, -2 and so on
    nothing = F.lit(None).cast("array<struct<id bigint, flag int>>")
    told = slim.select(
        "file", "page", "marks", first("head").alias("first"), first("tail").alias("last")
    ).select(
        "file",
        F.explode(
            F.array(
                F.struct(page.alias("page"), "marks", text.alias("after"), text.alias("before")),
                F.struct(F.when(page > 0, page - 1).when(page < -1, page + 1).alias("page"), nothing.alias("marks"), F.col("first").alias("after"), text.alias("before")),
                F.struct(F.when(page >= 0, page + 1).otherwise(page - 1).alias("page"), nothing.alias("marks"), text.alias("after"), F.when(F.col("last").rlike(rf"(?U)[{HYPHENS}]\s*$"), F.col("last")).alias("before")),
            )
        ).alias("x"),
    ).select("file", "x.*").where("page IS NOT NULL AND (marks IS NOT NULL OR after IS NOT NULL OR before IS NOT NULL)")
    told = told.groupBy("file", "page").agg(F.max("marks").alias("marks"), F.max("after").alias("after"), F.max("before").alias("before"))
    out = pages.select("file", "page", "keys", "texts").join(told, ["file", "page"], "left")
    flags = F.transform("keys", lambda k: F.coalesce(F.get(F.filter("marks", lambda m: m["id"] == k), F.lit(0))["flag"], F.lit(0)))
    return out.select(
        F.lit("line").alias("kind"), F.concat_ws("#", "file", F.col("page").cast("string")).alias("unit"), "file", "page", "keys", "texts",
        flags.alias("flags"), F.lit(None).cast("array<string>").alias("running"), "after", "before",
    )


def chunk_units(chunks: DataFrame) -> DataFrame:
    """The same for the chunks: a unit is a chunk, its lines those of its text; lines that run through the chunks of a file
    are found by their skeletons."""
    some = chunks.where("chunk_id IS NOT NULL AND text IS NOT NULL").select("chunk_id", "file", "text")
    # moved once, by chunk: repeated rows and the join with what runs through the file stay in their partitions
    rows = some.repartition("chunk_id").distinct()
    parts = F.split("text", "\n")
    short = F.filter(parts, lambda x: (F.length(x) <= 70) & (F.length(F.trim(x)) > 3) & ~x.rlike(r"[.!?:;,]\s*$|^\s*\p{Ll}"))
    lone = some.where(F.contains("text", F.lit("\n"))).select("chunk_id", "file", F.explode(F.array_distinct(F.transform(short, skeleton_column))).alias("skeleton")).where("length(skeleton) >= 6")
    one = F.xxhash64("chunk_id")  # two chunks at least
    often = lone.groupBy("file", "skeleton").agg(F.min(one).alias("a"), F.max(one).alias("b")).where("a <> b").select("file", "skeleton")
    running = lone.join(often, ["file", "skeleton"]).groupBy("chunk_id").agg(F.collect_set("skeleton").alias("running"))
    units = rows.join(running, "chunk_id", "left")
    return units.select(
        F.lit("chunk").alias("kind"), F.col("chunk_id").alias("unit"), "file", F.lit(None).cast("int").alias("page"), F.lit(None).cast("array<bigint>").alias("keys"),
        F.array("text").alias("texts"), F.lit(None).cast("array<int>").alias("flags"), "running", F.lit(None).cast("string").alias("after"), F.lit(None).cast("string").alias("before"),
    )


def skeleton(text: str) -> str:
    """skeleton_column in Python."""
    low = text.lower().translate(str.maketrans("0159l|!", "oisgiii"))
    return "".join(filter(str.isalpha, low))


MARGIN, SMALL, UNKNOWN, RUNS = 1, 2, 4, 8


def page_roles(texts: list[str], flags: list[int]) -> list[str | None]:
    """header, page_number or null for each line of a page: small or repeated lines in its margins."""
    roles: list[str | None] = []
    for t, f in zip(texts, flags):
        s = t.strip()
        if not s or not f & MARGIN or not (f & SMALL or f & UNKNOWN and f & RUNS):
            roles.append(None)
        else:
            roles.append("page_number" if len(s) <= 24 and PAGE_NUMBER.match(s) and any(map(str.isalnum, s)) else "header")
    return roles


def chunk_roles(texts: list[str], running: set[str]) -> list[str | None]:
    """The same for the lines of a chunk, which have no place and size: by form, repetition in the file and broken flow."""
    roles: list[str | None] = []
    filled = [i for i, t in enumerate(texts) if t.strip()]
    if len(filled) < 2:
        return [None] * len(texts)
    width = max(len(t.rstrip()) for t in texts)
    place = {i: k for k, i in enumerate(filled)}
    for i, t in enumerate(texts):
        s = t.strip()
        role = None
        number = bool(s) and len(s) <= 24 and bool(PAGE_NUMBER.match(s)) and any(c.isalnum() for c in s)
        if s:
            if number and s[-1] not in ".,;:" and not re.fullmatch(r"\d{4,}|[\d]+,\d+", s) and (s[0] in "-–[(" or len(re.sub(r"\D", "", s)) <= 3 or "/" in s):
                role = "page_number"
            elif s[-1] not in ".!?:;," and not s[0].islower() and any(c.isalpha() for c in s):
                k = place[i]
                before = texts[filled[k - 1]].rstrip() if k else None
                nxt = texts[filled[k + 1]].lstrip() if k + 1 < len(filled) else None
                # a wrapped line goes on: the next word would not have fitted
                wrapped = nxt is not None and len(t.rstrip()) + 1 + len(nxt.split()[0]) > width
                cuts = before is not None and nxt is not None and before[-1] not in ENDS and (nxt[0].islower() or before[-1] in HYPHENS or bool(re.search(r"[a-zà-ÿ,א-ת]$", before))) and not wrapped
                parted = bool(re.search(r"\s[–|·/—]\s|^©|\s{2,}\S*$", s)) and len(s.split()) <= 9
                titled = "," not in s and len(s.split()) <= 6 and sum(not w[0].islower() for w in s.split()) >= 0.6 * len(s.split())
                if not wrapped and (running and skeleton(s) in running or (k == 0 or nxt is None) and parted or cuts and (parted or titled)):
                    role = "header"
        roles.append(role)
    return roles


_MODELS: dict[str, tuple[Model, dict[int, bool]]] = {}


def kept_model(name: str, shared) -> tuple[Model, dict[int, bool]]:
    """The model of a scan, and what is known of its words: a worker keeps both from task to task, those of the last scan only."""
    if name not in _MODELS:
        _MODELS.clear()
        *counts, misreadings = shared.value
        own = Model(*counts)
        own.misreadings = misreadings  # made once, for all workers
        _MODELS[name] = (own, {})
    return _MODELS[name]


def may_be_doubtful(model: Model, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """False for words of which Model.doubtful is surely false: all at once, by hashes of their lower case and shape."""
    digit, capital = _digits_and_capitals()
    low, form, small = _lower_and_shapes()
    count = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    within = lambda sums: sums[end] - sums[start]
    lower = low[points]
    digits, capitals, smalls, letters = (within(count(x)) for x in (digit[points], capital[points], small[points], (_kinds()[points] == 1) & ~digit[points]))
    odd = within(count(lower == 0)) > 0  # what has a longer lower case is looked at by itself
    key = span_hashes(lower, start, end)
    # codes and numbers: a letter among digits in a shape that is frequent, or no letter at all
    code = (letters > 0) & ~((letters == 1) & (digits >= 2) & _among(span_hashes(form[points], start, end), model.sound_shapes))
    # words: one confusion away from a frequent one, or of one case, where two confusions count, or with I and l in odd places
    one_case = ((capitals == 0) & (smalls > 0)) | ((smalls == 0) & (capitals > 0))
    marks = count(points == ord("I"))
    known = _among(key, model.known_words)
    word = _among(key, model.misreadings) | (one_case & ~_among(key, model.safe_words)) | (marks[end] - marks[np.minimum(start + 1, end)] > 0) | ((lower[start] == ord("l")) & ~known)
    return np.where(digits > 0, code, word) | odd


def doubtful_lines(model: Model, lines: list[str], known: dict[int, bool]) -> list[bool]:
    """Whether each line has a word that may be misread; known keeps what is known of words, by their hashes."""
    out = np.zeros(len(lines), bool)
    text = "\n".join([x.replace("\n", " ") for x in lines]) + "\n"
    points, start, end, h, line = tokens_of(text)
    if not len(start):
        return out.tolist()
    code, values, first = distinct(h)
    # the distinct words, one after the other
    size = end[first] - start[first]
    at = np.cumsum(size) - size
    ask = np.flatnonzero(may_be_doubtful(model, points[np.repeat(start[first] - at, size) + np.arange(size.sum())], at, at + size))
    if len(known) > 1_000_000:
        known.clear()
    doubt = np.zeros(len(values), bool)
    for k, a, e in zip(ask.tolist(), start[first[ask]].tolist(), end[first[ask]].tolist()):
        v = values[k]
        if v not in known:
            known[v] = model.doubtful(text[a:e])
        doubt[k] = known[v]
    out[line[doubt[code]]] = True
    return out.tolist()


def scan_units(units: DataFrame, model: Model, repaired: bool = True) -> DataFrame:
    """(kind, unit, file, page, noise: array of (key, noise), paragraphs, continues) of each unit; paragraphs, and whether the last
    one goes on in the next page of the file, only where repaired is asked."""
    shared = units.sparkSession.sparkContext.broadcast((model.words, model.pairs, model.shapes, model.total, model.misreadings))
    name = uuid.uuid4().hex

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, known = kept_model(name, shared)
        for b in batches:
            units_of = []
            for kind, unit, keys, texts, flags, running in zip(*[b[c] for c in ("kind", "unit", "keys", "texts", "flags", "running")]):
                if kind == "chunk":
                    lines = texts[0].split("\n")
                    units_of.append((lines, chunk_roles(lines, set(running) if running is not None else set()), [unit] * len(lines)))
                else:
                    lines = [t or "" for t in texts]
                    units_of.append((lines, page_roles(lines, flags), keys))
            doubt = doubtful_lines(own, [x for lines, _, _ in units_of for x in lines], known)
            out, at = [], 0
            for (lines, roles, keys), kind, unit, file, page, after, before in zip(units_of, *[b[c] for c in ("kind", "unit", "file", "page", "after", "before")]):
                noises, fixed = unit_noise(own, lines, roles, after, before, doubt[at : at + len(lines)])
                at += len(lines)
                found = sorted({(str(k), n) for k, ns in zip(keys, noises) if ns for n in ns})
                out.append((kind, unit, file, page, [{"key": k, "noise": n} for k, n in found], *(open_paragraphs(fixed, roles, lines, after) if repaired else (None, None))))
            made = pd.DataFrame(out, columns=["kind", "unit", "file", "page", "noise", "paragraphs", "continues"])
            made["continues"] = pd.array(made["continues"], dtype="boolean")
            made["page"] = pd.array(pd.to_numeric(made["page"]), dtype="Int32")
            yield made

    return units.mapInPandas(scan, "kind string, unit string, file string, page int, noise array<struct<key string, noise string>>, paragraphs array<string>, continues boolean")


def scanned(lines: DataFrame, chunks: DataFrame, repaired: bool = True) -> DataFrame:
    """scan_units over all pages and chunks, under the model of all their lines."""
    texts = lines.select("text").unionByName(chunks.select("text"))
    model = corpus_model(texts)
    return scan_units(page_units(lines).unionByName(chunk_units(chunks)), model, repaired)
