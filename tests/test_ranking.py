"""BM25 over many queries: the ranks of the plain sums, without moving pairs of queries and documents."""

import random

import pytest
from pyspark.sql import functions as F
from test_pairing import moved

from lumentab.functions.text import document_terms
from lumentab.operators import retrieval
from lumentab.plans import text_queries


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["leave", "office", "permit", "desk"]) if rng.random() < 0.3 else f"w{rng.randrange(900)}"
    rows = [(i, " ".join(word() for _ in range(rng.randrange(1, 30)))) for i in range(1500)]
    return spark.createDataFrame([*rows, *((i + 1500, t) for i, t in rows[:40]), (3, "leave desk"), (9000, ""), (9001, None)], "k long, t string").repartition(4).cache()


def test_ranks_of_many_queries(spark, texts):
    asked = texts.where("k % 2 = 0 AND k <> 3")
    got = []
    assert moved(spark, lambda: got.extend(retrieval.bm25_top_k(texts, "k", "t", asked, "k", "t", 3).collect())) < 3_000_000  # 770 queries, 1,540 documents
    terms = asked.where("t IS NOT NULL").select(F.col("k").alias("query"), F.explode(F.array_distinct(retrieval.question_terms(retrieval.plain_words("t")))).alias("term"))
    rows = retrieval.document_rows(texts.where("k <> 3"), "k", "t")
    want = retrieval.top_k(retrieval.bm25_scores(retrieval.postings(texts.where("k <> 3"), "k", "t"), terms, rows.where("length > 0").agg(F.count("*").cast("double").alias("n"), F.avg("length").alias("average"))), 3)
    small = retrieval.top_k(retrieval.bm25_best(rows, terms, 3, block=100, cells=5000), 3)
    plain = lambda df: sorted((r["query"], r["rank"], r["doc"], r["score"]) for r in df.collect())
    assert plain(small) == plain(want) and {r["rank"] for r in got} == {1, 2, 3}
    assert retrieval.bm25_top_k(texts, "k", "t", asked.limit(0), "k", "t", 3).count() == 0


def test_deep_ranks(spark, texts):
    """rrf_fusion_all: ranks deeper than a batch or a block holds are whole, and only they are moved."""
    rows = retrieval.document_rows(texts.where("k <> 3"), "k", "t")
    terms = texts.where("k % 20 = 0 AND t IS NOT NULL").select(F.col("k").alias("query"), F.explode(F.array_distinct(retrieval.question_terms(retrieval.plain_words("t")))).alias("term"))
    size = rows.where("length > 0").agg(F.count("*").cast("double").alias("n"), F.avg("length").alias("average"))
    want = retrieval.bm25_scores(retrieval.postings(texts.where("k <> 3"), "k", "t"), terms, size).select("query", "doc", F.round("score", 6).alias("score"))
    for k in (1000, 5000):
        got = retrieval.bm25_best(rows, terms, k, cells=1000).select("query", "doc", F.round("score", 6).alias("score"))
        plain = lambda df, k=k: sorted((r["query"], r["rank"], r["doc"]) for r in retrieval.top_k(df, k).collect())
        assert plain(got) == plain(want)


def test_fused_ranks_are_those_of_deep_lists(spark):
    """rrf_fusion_all: a query without a vector moves its ten best of a task and no list of a thousand; the fused ranks stay."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(f"w{int(rng.paretovariate(0.4)) % 300}" for _ in range(12))) for i in range(3000)], "doc_id long, text string").repartition(4).cache()
    e = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(0, 60, 2)], "vec_id long, embedding array<double>")
    got = []
    assert moved(spark, lambda: got.extend(tuple(r) for r in text_queries.fused(docs, e).collect())) < 1_500_000  # 150 queries, three with vectors
    lexical = retrieval.bm25_top_k(docs, "doc_id", "text", docs.where("doc_id % 20 = 0"), "doc_id", "text", 1000)
    dense = retrieval.dense_top_k(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 1000)
    assert sorted(got) == sorted(tuple(r) for r in retrieval.fuse([lexical, dense], 10).collect()) and len(got) == 1500


def test_terms_of_whole_texts(spark):
    """rrf_fusion_all: terms found in the whole text are those found word by word."""
    texts = ["", "והבית הבית בבית ובבית וה ווה וווה ווווה והבלכ", "״וכשהגיע״ לבית-הספר ה־7 מהמהמה", "plain words, הדוח; ~הדוח ומהדוחות x_והבית", "מֶלֶךְ והַמֶּלֶךְ ﬁ Straße"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    r = df.select(retrieval.text_terms("t").alias("a"), document_terms(retrieval.plain_words("t")).alias("b")).collect()
    assert all(sorted(x["a"]) == sorted(x["b"]) for x in r) and sum(len(x["a"]) for x in r) > 40
