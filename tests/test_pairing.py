"""Similar sets: results against brute force, and how much is moved for them."""

import random

import pytest
from pyspark.sql import functions as F

from lumentab.operators import pairing, retrieval


def moved(spark, run):
    """Bytes written to shuffles by run."""
    sc = spark.sparkContext._jsc.sc()

    def store():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = store()
    run()
    return store() - before


@pytest.fixture(scope="module")
def answers(spark):
    rng = random.Random(5)
    stock = [" ".join(f"s{rng.randrange(300)}" for _ in range(6)) for _ in range(120)]  # sentences that many texts have
    rows = [(i, " ".join(rng.choice(stock) if rng.random() < 0.5 else " ".join(f"w{rng.randrange(10**6)}" for _ in range(6)) for _ in range(10))) for i in range(6000)]
    rows += [(6000 + i, rows[i][1] + " more") for i in range(0, 300, 3)] + [(7000 + i, rows[i][1]) for i in range(0, 300, 5)] + [(8000, None), (8001, "")]
    return spark.createDataFrame(rows, "k long, t string").repartition(4).cache()


def test_similar_sets_against_all_pairs(spark):
    rng = random.Random(3)
    base = [sorted(rng.sample(range(-400, 400), rng.randrange(1, 40))) for _ in range(60)]
    sets = [*base, *(sorted({*s, rng.randrange(500)}) for s in base), *(s[:-1] for s in base[:30]), [], base[0]]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, set array<long>")
    share = lambda a, b: len({*a} & {*b}) / max(1, len({*a} | {*b}))
    for t in (0.3, 0.8, 1.0):
        want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if share(sets[a], sets[b]) >= t - 1e-9 and sets[a]}
        assert {(r["a"], r["b"]) for r in pairing.similar_sets(df, t).collect()} == want


def test_bucket_counts(spark):
    df = spark.createDataFrame([([1, 2, 2],), ([],), (None,), ([-5],)], "v array<long>")
    counts = pairing.bucket_counts(df, 20)
    assert counts.sum() == 4 and len(counts) == 2**20 and sorted(counts[counts > 0]) == [1, 1, 2]
    assert {r["id"] for r in pairing.among(spark.range(1000), "id", spark.createDataFrame([(3,), (77,)], "x long")).collect()} >= {3, 77}


def test_dedup_moves_few_sets(spark, answers):
    """greedy_dedup: the shingle sets, 8 bytes for each of about sixty words, aren't shuffled whole again and again."""
    held = []

    def run():
        firsts = retrieval.first_copies(retrieval.shingle_sets(answers, "k", "t"))
        pairs = retrieval.near_pairs(answers, "k", "t", firsts).select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
        held.extend(r["k"] for r in retrieval.greedy_kept(firsts.select(F.col("id").alias("k")), pairs, "k").collect())

    assert moved(spark, run) < 3 * 6000 * 56 * 8
    assert sorted(held) == list(range(6000))


def test_near_duplicates_keep_no_shingles(spark, answers):
    """near_duplicates: what is shuffled and kept as tables is less than the shingles, 8 bytes for each word, once moved and once kept."""
    from pathlib import Path

    size = lambda: sum(p.stat().st_size for p in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).parent.rglob("*.parquet"))
    long = answers.where("k < 2000").select("k", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.regexp_replace("t", "([ws])", F.concat(i.cast("string"), F.lit("$1"))))).alias("t"))
    got, kept = [], size()
    shuffled = moved(spark, lambda: got.extend(retrieval.near_duplicates(long, "k", "t").collect()))
    assert got == [] and shuffled + size() - kept < 2 * 2000 * 476 * 8


def test_near_duplicate_answers_move_few_sets(spark, answers, tmp_path):
    """near_duplicate_answers: the shingle sets, 8 bytes for each of about sixty words, are neither shuffled nor kept."""
    from pathlib import Path

    from lumentab.plans import text_queries

    answers.toDF("result_no", "expected_answer").write.parquet(str(tmp_path / "results.parquet"))
    size = lambda: sum(p.stat().st_size for p in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).parent.rglob("*") if p.is_file())
    got, kept = [], size()
    shuffled = moved(spark, lambda: got.extend(text_queries.near_duplicate_answers(spark, str(tmp_path)).collect()))
    runs = {k: {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for k, t in answers.where("k < 7000").collect() for w in [t.split()]}
    want = [(i, j, round(len(runs[i] & runs[j]) / len(runs[i] | runs[j]), 6)) for i in range(0, 300, 3) for j in [6000 + i]]
    assert sorted((r["key_a"], r["key_b"], r["similarity"]) for r in got) == want
    assert shuffled + size() - kept < 3 * 6000 * 56 * 8, (shuffled, size() - kept)


def test_verified_moves_each_set_once(spark, tmp_path):
    """near_duplicate_answers: of sets that are all alike, each is moved once, not once for each of its pairs."""
    from lumentab.plans import text_queries

    rng = random.Random(11)
    base = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(1000)]
    rows = [(c * 1000 + i, f"{t} v{c}") for i, t in enumerate(base) for c in range(8)]
    spark.createDataFrame(rows, "result_no long, expected_answer string").repartition(4).write.parquet(str(tmp_path / "results.parquet"))
    got = []
    large = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "12"}  # as with large tables
    before = {k: spark.conf.get(k) for k in large}
    try:
        for k, v in large.items():
            spark.conf.set(k, v)
        shuffled = moved(spark, lambda: got.extend(text_queries.near_duplicate_answers(spark, str(tmp_path)).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r["key_a"], r["key_b"], r["similarity"]) for r in got) == sorted((c * 1000 + i, d * 1000 + i, round(56 / 58, 6)) for i in range(1000) for d in range(8) for c in range(d))
    assert shuffled < 5 * 8000 * 57 * 8, shuffled


def test_verified_in_parts(spark):
    """Places that are split, stars and chains, and an id with two sets give the same as each pair by itself."""
    rng = random.Random(4)
    sets = [(i, sorted(rng.sample(range(40), rng.randrange(20, 38)))) for i in range(60)] + [(7, [1, 2, 3])]
    near = [(0, b) for b in range(1, 60)] + [(i, i + 1) for i in range(1, 59)] + [(a, b) for a in range(20, 40) for b in range(a + 2, 40)]
    kept = {i: [set(s) for k, s in sets if k == i] for i in range(60)}
    want = {(a, b, len(x & y), len(x), len(y)) for a, b in near for x in kept[a] for y in kept[b] if len(x & y) >= 0.5 * len(x | y) - 1e-9}
    df, pairs = spark.createDataFrame(sets, "id long, set array<long>"), spark.createDataFrame(near, "a long, b long")
    for block in (1, 5, 64):
        got = [tuple(r) for r in pairing.verified(pairs, df, 0.5, block).collect()]
        assert set(got) == want and len(got) == len(want)
