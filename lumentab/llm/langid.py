"""Languages of documents and of the segments of mixed ones, by string kernels.

Method: the kernel of two texts is the share of character n-grams (of two and three characters, lower case, what is no letter
as a blank) that stand in both, K(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), presence only. The languages are learnt one
against the rest by kernel ridge regression in the Nyström space of landmark sentences. The kernel against the landmarks
times their coefficients is linear in the n-grams of x, so that the product of the landmark matrix with the coefficients is
made once, and a batch of sentences is scored by one product of its presence matrix with it.

Fitting takes a bounded sample of labelled documents (`per_language` for each label, the least by a hash of key and text),
twice: the second time without the sentences that the first model gives to another language than their label. Everything
else, sentences, segments, languages, covers all texts whole.

Sentences are cut at terminators and line breaks. A whole sentence whose best language leads clearly has that language,
wherever it stands. For the others, short, unfinished or unclear, the most probable sequence is taken under a price for every
change, so that a foreign name or phrase, or a heading, makes no segment.

Null, empty and letterless texts have no language. Repeated rows are judged alike. Labels are codes of two or three
letters, codes with a region, and English names, in any case.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookalike import code_points

# Two-letter code, three-letter codes and English name of languages a label may name.
LANGUAGES = """
ar ara arabic; bg bul bulgarian; ca cat catalan; cs ces cze czech; da dan danish; de deu ger german; el ell gre greek; en eng english; es spa spanish castilian;
et est estonian; fa fas per persian; fi fin finnish; fr fra fre french; he heb iw hebrew; hi hin hindi; hr hrv croatian; hu hun hungarian; id ind indonesian; it ita italian;
ja jpn japanese; ko kor korean; lt lit lithuanian; lv lav latvian; nl nld dut dutch flemish; no nor norwegian; nb nob; pl pol polish; pt por portuguese; ro ron rum romanian;
ru rus russian; sk slk slo slovak; sl slv slovenian; sr srp serbian; sv swe swedish; tr tur turkish; uk ukr ukrainian; vi vie vietnamese; yi yid yiddish; zh zho chi chinese
"""
SLOTS = 1 << 14
LONGEST = 3
CLEAR = 0.75  # lead of the best language's score, which is about 2 at most
SENTENCE = 12  # letters
LINE = 40  # letters from which an unfinished line is a sentence too
CLOSERS = "\"'”’»)]}›“"
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_SEED = np.array([0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)


@functools.cache
def label_codes() -> dict[str, str]:
    return {name: words[0] for row in LANGUAGES.split(";") if (words := row.split()) for name in words}


def language_code(label: Column) -> Column:
    """The two-letter code a label names, else null."""
    first = F.regexp_extract(F.lower(F.trim(label)), r"^([\p{L}]+)(?:[-_][a-z0-9]{2,8})*$", 1)
    table = F.create_map(*[F.lit(x) for kv in label_codes().items() for x in kv])
    return F.when(label.isNotNull() & (first != ""), F.try_element_at(table, first))


@functools.cache
def _letters() -> np.ndarray:
    """Each code point in lower case; what is no letter or mark becomes a blank."""
    out = np.full(0x110000, 32, np.uint32)
    for cp in range(0x20000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low[0])
    out[0x300:0x370] = np.arange(0x300, 0x370)
    out[0x591:0x5C8] = np.arange(0x591, 0x5C8)
    out[0x20000:0x32000] = np.arange(0x20000, 0x32000)
    return out


@functools.cache
def _breaks() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terminators, blanks and line breaks by code point (basic plane)."""
    term, blank, line = (np.zeros(0x110000, bool) for _ in range(3))
    term[[ord(c) for c in ".!?…。؟！？"]] = True
    blank[[cp for cp in range(0x3001) if chr(cp).isspace()]] = True
    line[[0x0A, 0x0D, 0x85, 0x2028, 0x2029]] = True
    return term, blank, line


def sentence_spans(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of the sentences of all rows; together they cover every text."""
    term, blank, line = _breaks()
    if not len(points):
        z = np.zeros(0, np.int64)
        return z, z, z
    follows = np.append(points[1:], 32)
    cut = line[points] | (term[points] & blank[follows])
    ends = np.flatnonzero(cut) + 1
    ends = np.union1d(ends, at[1:])
    ends = ends[ends > 0]
    begins = np.concatenate([[0], ends[:-1]])
    row = np.searchsorted(at, begins, side="right") - 1
    return row, begins, ends


def presence(points: np.ndarray, begin: np.ndarray, end: np.ndarray, block: int = 128) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, sentence within the block, slot): the distinct n-gram slots of sentences, block by block."""
    low = _letters()[points]
    stamp = np.zeros(block * SLOTS, np.int32)
    shift = np.uint32(32 - SLOTS.bit_length() + 1)
    for first in range(0, len(begin), block):
        last = min(first + block, len(begin))
        a, e = begin[first], end[last - 1]
        text = low[a:e]
        base = np.repeat(np.arange(0, (last - first) * SLOTS, SLOTS, dtype=np.uint32), (end - begin)[first:last])
        keys, h = [], np.zeros(len(text), np.uint32)
        for n in range(min(LONGEST, len(text))):
            h = h[: len(text) - n] + text[n:] * _MIX[n]
            if n == 0:
                continue
            slot = ((h ^ (h >> np.uint32(15))) * _SEED[n]) >> shift
            keys.append((base[: len(text) - n] + slot)[base[: len(text) - n] == base[n:]])
        if not keys:
            continue
        key = np.concatenate(keys)
        order = np.arange(len(key), dtype=np.int32)
        stamp[key] = order  # the last of equal keys stays
        key = key[stamp[key] == order]
        yield first, last, key >> np.uint32(SLOTS.bit_length() - 1), key & np.uint32(SLOTS - 1)


def scores(points: np.ndarray, begin: np.ndarray, end: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """sentences x languages: presence matrix times weights, over the root of the number of n-grams."""
    out = np.zeros((len(begin), weights.shape[1]), np.float32)
    for first, last, sent, slot in presence(points, begin, end):
        # the n-grams of each length stand in order of their sentences: the product is a sum over runs
        runs = np.flatnonzero(np.concatenate([[True], sent[1:] != sent[:-1]])) if len(sent) else np.zeros(0, np.int64)
        if len(runs):
            np.add.at(out, first + sent[runs].astype(np.int64), np.add.reduceat(weights.take(slot, axis=0), runs, axis=0))
        n = np.bincount(sent, minlength=last - first)
        out[first:last] /= np.sqrt(np.maximum(n, 1))[:, None]
    return out


def _dense(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    for first, last, sent, slot in presence(points, begin, end):
        x = np.zeros((last - first, SLOTS), np.float32)
        x[sent, slot] = 1
        x /= np.sqrt(np.maximum(x.sum(1), 1))[:, None]
        yield first, last, x


def fit(texts: list[str], labels: list[str], landmarks: int = 320, sentences: int = 4000, ridge: float = 0.03, seed: int = 7) -> tuple[list[str], np.ndarray]:
    """(languages, slots x languages weights) from labelled texts."""
    rng = np.random.default_rng(seed)
    points, at = code_points(pa.array(texts, pa.string()))
    row, a, e = sentence_spans(points, at)
    long = np.flatnonzero(e - a >= 25)
    names = sorted(set(labels))
    y = np.array([names.index(x) for x in labels], np.int64)[row[long]] if len(long) else np.zeros(0, np.int64)
    pick = np.concatenate([rng.permutation(np.flatnonzero(y == k))[: sentences // len(names)] for k in range(len(names))]) if len(long) else np.zeros(0, np.int64)
    pick = np.sort(pick)
    if not len(pick):
        return names, np.zeros((SLOTS, len(names)), np.float32)
    at_pick, y = long[pick], y[pick]
    # the sentences picked, put one after another
    begin, end = a[at_pick], e[at_pick]
    size = end - begin
    flat = np.concatenate([points[i:j] for i, j in zip(begin, end)])
    end = np.cumsum(size)
    begin = end - size
    mark = np.sort(np.concatenate([rng.permutation(np.flatnonzero(y == k))[: max(1, landmarks // len(names))] for k in range(len(names))]))
    pts = np.concatenate([flat[begin[i] : end[i]] for i in mark])
    g = np.concatenate([x for _, _, x in _dense(pts, np.cumsum(size[mark]) - size[mark], np.cumsum(size[mark]))])
    used = np.flatnonzero(g.any(0))  # n-grams of no landmark are in no product
    k_mm = g @ g.T
    k_nm = np.concatenate([x[:, used] @ g[:, used].T for _, _, x in _dense(flat, begin, end)])
    keep = np.ones(len(y), bool)
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    for _ in range(2):
        k = k_nm[keep].astype(np.float64)
        w = np.linalg.solve(k.T @ k + ridge * len(k) / len(mark) * k_mm + 1e-3 * np.eye(len(mark)), k.T @ target[keep])
        keep = (k_nm @ w).argmax(1) == y  # sentences of wrong labels and of mixed documents
    return names, (g.T @ w).astype(np.float32)


def confidence(s: np.ndarray) -> np.ndarray:
    """Shares of the languages from scores around 1 for the right and -1 for the wrong ones."""
    x = np.exp(5.0 * (s - s.max(-1, keepdims=True)))
    return x / x.sum(-1, keepdims=True)


def clear_sentences(points: np.ndarray, begin: np.ndarray, end: np.ndarray, letters: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Whether each is a whole sentence, finished or long, whose best language leads clearly."""
    if s.shape[1] < 2:
        return np.zeros(len(s), bool)
    term, blank, line = _breaks()
    skip = blank | line
    skip[[ord(c) for c in CLOSERS]] = True
    last = np.maximum.accumulate(np.where(skip[points], -1, np.arange(len(points))))[end - 1]
    finished = (last >= begin) & term[points[last]]
    top = np.partition(s, -2, axis=1)
    return (top[:, -1] - top[:, -2] >= CLEAR) & (letters >= SENTENCE) & (finished | (letters >= LINE))


def smooth(s: np.ndarray, letters: np.ndarray, price: float = 2.2, clear: np.ndarray | None = None) -> np.ndarray:
    """The best language of each sentence of one document, every change at a price; short sentences weigh less, and those that
    are clear keep their own best."""
    weight = np.clip(letters / 40.0, 0.02, 1.0)[:, None]
    gain = s * weight
    if clear is not None:
        gain = np.where(clear[:, None] & (np.arange(s.shape[1]) != s.argmax(1)[:, None]), -1e4, gain)
    best, back = gain[0].copy(), []
    for row in gain[1:]:
        stay, jump = best, best.max() - price
        back.append(np.where(stay >= jump, np.arange(len(best)), best.argmax()))
        best = np.maximum(stay, jump) + row
    out = [int(best.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return np.array(out[::-1])


def segments_of(texts: pa.Array, names: list[str], weights: np.ndarray) -> Iterator[tuple[int, int, int, int, int, str, float]]:
    """(row, segment_no, begin, end, sentences, lang, confidence); positions are code points of the row's text."""
    points, at = code_points(texts)
    row, a, e = sentence_spans(points, at)
    if not len(row):
        return
    s = scores(points, a, e, weights)
    letters = np.add.reduceat((_letters()[points] != 32).astype(np.int64), a)
    full = letters > 0
    clear = clear_sentences(points, a, e, letters, s)
    # a foreign phrase is no sentence: only those of some length count as such
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    best = s.argmax(1)
    for i, j in zip(starts, np.append(starts[1:], len(row))):
        use = np.flatnonzero(full[i:j]) + i
        if not len(use):
            continue
        own = best[use]
        some = own[(letters[use] >= 20) | clear[use]]
        if len(some) and (some == some[0]).all():
            own = np.full(len(own), some[0])  # only headings and scraps differ
        elif (own != own[0]).any():
            own = smooth(s[use], letters[use], clear=clear[use])
        r, base = row[i], at[row[i]]
        cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        for n, (p, q) in enumerate(zip(cuts, np.append(cuts[1:], len(use))), 1):
            w = letters[use[p:q]].astype(np.float64)
            mean = (s[use[p:q]] * w[:, None]).sum(0) / w.sum()
            begin = a[use[p]] if n > 1 else at[r]
            end = a[use[q]] if q < len(use) else at[r + 1]
            yield r, n, int(begin - base), int(end - base), int((w >= SENTENCE).sum()), names[own[p]], round(float(confidence(mean)[own[p]]), 4)


def language_model(documents: DataFrame, key: str, text: str, lang: str, per_language: int = 250, at_least: int = 20) -> tuple[list[str], np.ndarray]:
    """Fitted on the per_language labelled documents of each language with the least hashes; labels of fewer than at_least
    documents (in small corpora, than a twentieth of the most frequent one's) are no languages of this corpus."""
    from pyspark.sql import Window

    labelled = documents.select(language_code(F.col(lang)).alias("l"), F.col(text).alias("t"), F.xxhash64(key, text).alias("h")).where("l IS NOT NULL AND t IS NOT NULL AND length(t) >= 40")
    nth = F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))
    rows = labelled.withColumn("n", nth).where(F.col("n") <= per_language).select("l", "t").orderBy("l", "t").toPandas()
    n = rows.groupby("l")["t"].transform("size") if len(rows) else pd.Series(dtype=int)
    rows = rows[n >= min(at_least, max(2.0, 0.05 * n.max()))] if len(rows) else rows
    if not len(rows):
        return ["und"], np.zeros((SLOTS, 1), np.float32)
    return fit(rows["t"].tolist(), rows["l"].tolist())


def language_segments(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 250) -> DataFrame:
    """(key, label, segment_no, begin, end, sentences, seg_lang, confidence) for each segment of each document."""
    model = language_model(documents, key, text, lang, per_language)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), language_code(F.col(lang)).alias("label"), F.col(text).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = shared.value
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                found = list(segments_of(part.column("text"), names, weights))
                r = pa.array([x[0] for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(r), part.column("label").take(r), *[pa.array([x[k] for x in found], t) for k, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.int32()), (4, pa.int32()), (5, pa.string()), (6, pa.float64()))]],
                    names=["key", "label", "segment_no", "begin", "end", "sentences", "seg_lang", "confidence"],
                )

    made = rows.mapInArrow(find, "key long, label string, segment_no int, begin int, end int, sentences int, seg_lang string, confidence double")
    return made.withColumnRenamed("key", key)


def document_languages(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, label, seg_lang, sentences, share, confidence, languages): the languages of each document, those with at least two
    sentences, or the one with the most letters where none has."""
    size = F.col("end") - F.col("begin")
    one = segments.groupBy(key, "label", "seg_lang").agg(F.sum("sentences").alias("sentences"), F.sum(size).alias("size"), (F.sum(F.col("confidence") * size) / F.sum(size)).alias("confidence"))
    all_of = one.groupBy(key, "label").agg(F.collect_list(F.struct("size", "seg_lang", "sentences", "confidence")).alias("l"))
    kept = F.filter("l", lambda x: x["sentences"] >= 2)
    kept = F.when(F.size(kept) > 0, kept).otherwise(F.array(F.array_max("l")))
    total = F.aggregate("l", F.lit(0).cast("long"), lambda s, x: s + x["size"])
    out = all_of.select(key, "label", total.alias("_total"), F.explode(kept).alias("x"), F.size(kept).alias("languages"))
    return out.select(key, "label", F.col("x.seg_lang").alias("seg_lang"), F.col("x.sentences").alias("sentences"), (F.col("x.size") / F.col("_total")).alias("share"), F.col("x.confidence").alias("confidence"), "languages")


def mislabelled(languages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, seg_lang) of the documents whose label is missing, names no language, or isn't the only language of the text."""
    return languages.where("label IS NULL OR languages > 1 OR label <> seg_lang").select(key, "seg_lang").distinct()
