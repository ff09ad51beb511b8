import unicodedata

import pandas as pd
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lumentab.llm import langid, lookalike, pairs, scannoise


def test_folding():
    f = lookalike.fold_text
    assert f("рауѕ ７３​７５ ﬁle") == "pays 7375 file"
    assert f("été") == "été" == f("е́té")
    assert f("ạ̇") == f("ạ̇")
    assert f("Café") != f("Cafe") and f("ABC") != f("abc") and f("10") != f("l0") and f("x²") == "x²"
    assert f("װ") == "וו" and f("sʼil") == "s'il" and f("a‑b") == "a-b"
    assert lookalike.fold_arrow(pa.array([None, "", "​", "x"])).to_pylist() == [None, "", "", "x"]


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_folding_is_stable(text):
    once = lookalike.fold_text(text)
    assert lookalike.fold_text(once) == once
    assert lookalike.fold_text(unicodedata.normalize("NFD", text)) == lookalike.fold_text(unicodedata.normalize("NFC", text))


def test_quotes(spark):
    chunks = spark.createDataFrame([("c1", "The fund pays 20 units, always."), ("c1", "The fund pays 20 units, always."), ("c2", None), ("c3", "Тhе fund")], "chunk_id string, text string")
    rows = [(1, "c1", "fund pays"), (2, "c1", "fund pays"), (3, "c1", "Fund pays"), (4, "c9", "fund"), (5, None, "fund"), (6, "c1", None), (7, "c1", "​"), (8, "c3", "The fund"), (1, "c1", "fund pays"), (9, "c1", "fund pays 21")]
    quotes = spark.createDataFrame(rows, "quote_id long, source_id string, quote string")
    assert sorted(r[0] for r in lookalike.lookalike_quotes(quotes, chunks).collect()) == [1, 8]
    assert lookalike.lookalike_quotes(quotes.limit(0), chunks).count() == 0


def model():
    words = {w: 2000 for w in "the payroll desk may approve leave request for every employee in cabinet follow-up report section office".split()}
    import numpy as np

    return scannoise.Model(words | {"modern": 100}, np.zeros(scannoise.BUCKETS, np.int64), {"9999": 900, "AA-9999": 500, "A999.99": 400}, 40_000)


def test_misread_words():
    m = model()
    assert scannoise.misread(m, "the payro11 clesk rnay approvc leave".split()) == [None, "payroll", "desk", "may", "approve", None]
    assert scannoise.misread(m, "cabinet 7O84 QM-7242 E205.37 l543 Zuvetorax modern".split()) == [None, "7084", None, None, "1543", None, None]


def test_broken_words_and_roles():
    m = model()
    lines = ["the payroll desk may appro-", "ve every follow-", "up report in Kegi¬", "tol office.", "", "The desk –"]
    noises, fixed = scannoise.unit_noise(m, lines, [None] * 6, None)
    assert [sorted(n) for n in noises] == [["hyphen"], [], ["hyphen"], [], [], []]
    assert scannoise.paragraphs(fixed, [None] * 6, lines)[0] == "the payroll desk may approve every follow-up report in Kegitol office."
    m, small = scannoise.MARGIN, scannoise.MARGIN + scannoise.SMALL
    assert scannoise.page_roles(["Main Binder", "- 2l -", "6163", "text goes on", "iv", "last line"], [small, small, 0, 0, small, m]) == ["header", "page_number", None, None, "page_number", None]
    chunk = ["Kafofona – Common questions", "- 3 -", "the payroll desk may approve leave", "for every employee in the office"]
    assert scannoise.chunk_roles(chunk, {scannoise.skeleton(chunk[0])}) == ["header", "page_number", None, None]


def test_channel_and_coarse_key():
    for read, meant in (("joumey", "journey"), ("clepartment", "department"), ("biireau", "bureau"), ("C011ected".lower(), "collected"), ("vvater", "water")):
        assert scannoise.channel(read, meant) > -1e9
        assert scannoise.coarse(read) == scannoise.coarse(meant)
    assert scannoise.channel("house", "mouse") == float("-inf")


@given(st.lists(st.text(alphabet="clarkIiLl1O0rnmE7.-ß", min_size=1, max_size=9), min_size=1, max_size=9))
@settings(max_examples=400, deadline=None)
def test_no_doubt_is_lost(words):
    m = model()
    lines = [" ".join(words), "the clesk of marn, C205.37"]
    assert scannoise.doubtful_lines(m, lines, {}) == [any(m.doubtful(w) for w in scannoise.WORD.findall(x)) for x in lines]


@given(st.lists(st.text(alphabet="aB9é-'’.,| \n\tא", max_size=40), max_size=8))
@settings(max_examples=300, deadline=None)
def test_words_in_arrays(lines):
    import re

    text = "".join(x + "\n" for x in lines)
    points, start, end, h, line = scannoise.tokens_of(text)
    assert [text[a:b] for a, b in zip(start, end)] == scannoise.WORD.findall(text)
    assert [text[:a].count("\n") for a in start] == line.tolist()
    assert len({*h.tolist()}) == len({*scannoise.WORD.findall(text)})
    got = pd.concat(scannoise.count_lines(iter([pd.DataFrame({"text": lines[:3]}), pd.DataFrame({"text": lines[3:]})])))
    want: dict = {}
    for row in [y for x in lines for y in x.split("\n")]:
        found = scannoise.WORD.findall(row)
        if found and not row[-1].isalnum() and scannoise.broken_end(row):
            found.pop()
        kinds = [scannoise.word_class(w) for w in found]
        adds = [("w", w.lower()) for w in found] + [("s", scannoise.shape(w)) for w in found if re.search(r"\d", w)] + [("p", str(scannoise.pair_bucket(a, b))) for a, b in zip(kinds, kinds[1:])]
        for k in adds:
            want[k] = want.get(k, 0) + 1
    assert got.groupby(["tag", "key"])["n"].sum().to_dict() == want


def test_scanned_table(spark):
    lines = [(i, "f.pdf", p, n, t, 9.0 if n == 1 else 11.0, False) for p in (1, 2, 3) for n, (i, t) in enumerate([(p * 10, "Binder Rules"), (p * 10 + 1, "the payroll desk may approve"), (p * 10 + 2, "leave for every employee."), (p * 10 + 3, None if p == 3 else "")], 1)]
    df = spark.createDataFrame(lines + lines[:2] + [(99, None, None, None, "the desk", None, None)], "line_id long, file string, page int, line_no int, text string, size double, bold boolean")
    chunks = spark.createDataFrame([("c#1", "c", "the payroll desk"), ("c#2", "c", None)], "chunk_id string, file string, text string")
    got = scannoise.scanned(df, chunks).collect()
    noise = {(n["key"], n["noise"]) for r in got for n in r["noise"]}
    assert noise == {("10", "header"), ("20", "header"), ("30", "header")}
    assert scannoise.scanned(df.limit(0), chunks.limit(0)).count() == 0


def test_languages(spark):
    en = ["The payroll desk approves every request before the end of the month.", "Please note that the office is closed on the first day of the year."]
    de = ["Das Lohnbüro genehmigt jeden Antrag vor dem Ende des Monats.", "Bitte beachten Sie, dass das Amt am ersten Tag des Jahres geschlossen ist."]
    he = ["המשרד סגור ביום הראשון של השנה.", "מדור השכר מאשר כל בקשה לפני סוף החודש."]
    rows = [(3 * i + k, f"{t[i % 2]} {t[(i + 1) % 2]}", lang) for i in range(12) for k, (t, lang) in enumerate(((en, "en-US"), (de, "German"), (he, "heb")))]
    rows += [(100, " ".join(en + de), "en"), (101, de[0], None), (102, he[0], "xx"), (103, None, "en"), (104, "", "en"), (105, "123 !!", None), (106, en[0] + " " + en[1], "de"), (106, en[0] + " " + en[1], "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seg = langid.language_segments(df)
    found = {tuple(r) for r in langid.mislabelled(langid.document_languages(seg)).collect()}
    assert found == {(100, "en"), (100, "de"), (101, "de"), (102, "he"), (106, "en")}
    text = " ".join(en + de)
    parts = sorted((r["begin"], r["end"]) for r in seg.where("doc_id = 100").collect())
    assert parts[0][0] == 0 and parts[-1][1] == len(text) and parts[0][1] == parts[1][0]
    assert langid.language_segments(df.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    """Fitted on the documents of even ids, held against the others whose label their function words confirm."""
    from lumentab.session import table

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    names, weights = langid.language_model(train, "doc_id", "text", "lang")
    rows = test.where("text IS NOT NULL AND lang IN ('en', 'he', 'de', 'fr', 'es')").select("text", "lang").toPandas()
    rows = rows[[pairs.language_of(t)[0] == x for t, x in zip(rows["text"], rows["lang"])]].reset_index(drop=True)
    got = {}
    for r, _, a, b, _, lang, _ in langid.segments_of(pa.array(rows["text"]), names, weights):
        got.setdefault(r, {}).setdefault(lang, 0)
        got[r][lang] += b - a
    right = sum(max(v, key=v.get) == rows["lang"][r] for r, v in got.items())
    assert len(got) > 250 and right / len(got) > 0.97


def test_planted_mixtures(spark):
    """Sentences of held-out documents, alternating, and two of one language at any places among eighteen of another."""
    import random
    import re

    from lumentab.session import table

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    names, weights = langid.language_model(docs.where("doc_id % 2 = 0"), "doc_id", "text", "lang")
    rows = docs.where("doc_id % 2 = 1 AND text IS NOT NULL AND lang IN ('en', 'he', 'de', 'fr', 'es')").select("text", "lang").toPandas()
    pool: dict = {}
    for t, lang in zip(rows["text"], rows["lang"]):
        said = [x for x in re.split(r"(?<=[.!?])\s+", t) if len(x) >= 45 and x[-1] in ".!?"]
        if pairs.language_of(t)[0] == lang:
            pool.setdefault(lang, []).extend(x for x in said if pairs.language_of(x)[0] == lang)
    rng = random.Random(9)
    texts, want = [], []
    for k in range(240):
        a, b = rng.sample(sorted(pool), 2)
        if k % 2:
            said = [rng.choice(pool[x]) for x in (a, b, a, b)]
        else:
            said = [rng.choice(pool[a]) for _ in range(18)]
            for _ in range(2):
                said.insert(rng.randrange(len(said) + 1), rng.choice(pool[b]))
        texts.append(" ".join(said))
        want.append({a, b})
    count: dict = {}
    for r, _, _, _, n, lang, _ in langid.segments_of(pa.array(texts), names, weights):
        count[r, lang] = count.get((r, lang), 0) + n
    found = {k for k, n in count.items() if n >= 2}
    true = {(r, x) for r, w in enumerate(want) for x in w}
    assert len(found & true) / len(true) >= 0.95 and len(found & true) / len(found) >= 0.98


def test_two_clear_sentences_anywhere():
    en = ["The payroll desk approves every request before the end of the month.", "Please note that the office is closed on the first day of the year."]
    de = ["Das Lohnbüro genehmigt jeden Antrag vor dem Ende des Monats.", "Bitte beachten Sie, dass das Amt am ersten Tag des Jahres geschlossen ist."]
    names, weights = langid.fit([" ".join(en), " ".join(de)] * 12, ["en", "de"] * 12)
    found = lambda text: [x[5] for x in langid.segments_of(pa.array([text]), names, weights)]
    assert found(" ".join(en * 2 + de + en * 2)) == ["en", "de", "en"]
    assert found(" ".join([*en, de[0], *en, de[1], *en])) == ["en", "de", "en", "de", "en"]
    assert found(" ".join([de[0], *en, *en, de[1]])) == ["de", "en", "de"]
    # a phrase is no sentence
    assert found(f"{en[0]} (das Lohnbüro)\n{en[1]}") == ["en"]


def test_words_and_paragraphs_over_page_ends(spark):
    pages = [["Binder Rules", "the payroll desk may approve leave request for every em-"], ["Binder Rules", "ployee, in the follow-"], ["Binder Rules", "up report of the section office.", "The desk."]]
    lines = [(10 * p + n, "f.pdf", p, n, t, 9.0 if n == 0 else 11.0, False) for p, page in enumerate(pages, 1) for n, t in enumerate(page)]
    lines += [(100 + n, "g.pdf", 1, n, t, 11.0, False) for n, t in enumerate(["every employee has a follow-up report"] * 9)]
    df = spark.createDataFrame(lines, "line_id long, file string, page int, line_no int, text string, size double, bold boolean")
    chunks = spark.createDataFrame([("c#1", "c", "the payroll desk")], "chunk_id string, file string, text string")
    got = {r["page"]: r for r in scannoise.scanned(df, chunks).where("file = 'f.pdf'").collect()}
    assert [got[p]["paragraphs"] for p in (1, 2)] == [["the payroll desk may approve leave request for every employee,"], ["in the follow-up"]]
    assert " ".join(got[3]["paragraphs"]) == "report of the section office. The desk."
    assert [got[p]["continues"] for p in (1, 2, 3)] == [True, True, False]
    assert {(n["key"], n["noise"]) for r in got.values() for n in r["noise"]} == {("10", "header"), ("20", "header"), ("30", "header"), ("11", "hyphen")}
