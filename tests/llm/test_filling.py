import numpy as np
from pyspark.sql import functions as F

from lumentab.llm import mixing, packing


def test_pack():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 500, 3000)
    prompts = np.minimum(sizes, rng.integers(1, 60, 3000))
    losses = sizes - prompts
    for share in (0.95, 0.8):
        where = packing.pack(sizes, losses, 512, 8, int(share * 512))
        n = np.bincount(where)
        load, loss = np.bincount(where, sizes), np.bincount(where, losses)
        assert load.max() <= 512 and n.max() <= 8 and n.min() > 0
        assert loss[n > 1].max() <= int(share * 512)
    # at 0.8 of the capacity the limit on loss-bearing tokens is what fills the containers
    assert (loss[n > 1] >= 0.97 * int(0.8 * 512)).mean() > 0.5
    where = packing.pack(sizes, losses, 512, 8, int(0.95 * 512))
    assert 1 - sizes.sum() / (512 * (where.max() + 1)) < 0.05
    assert packing.pack(np.full(7, 512), np.full(7, 511), 512, 8, 400).max() == 6


def test_containers(spark):
    sizes = spark.createDataFrame([(i, (i * 37) % 300) for i in range(400)] + [(1000, 5000), (1, 37)], "doc_id long, n_tokens int")
    limits = spark.createDataFrame([("small", 128), ("big", 2048), ("small", 128), (None, 5), ("bad", 0)], "container string, capacity_tokens int")
    got = packing.fill_containers(sizes, limits, group=150).cache()
    per = got.groupBy("container", "doc_id").agg(F.sum(F.expr("token_end - token_begin")).alias("t"), F.count("*").alias("n"))
    want = sizes.groupBy("doc_id").agg(F.sum("n_tokens").alias("w"), F.max("n_tokens").alias("m"))
    assert per.join(want, "doc_id").where("t <> w").count() == 0
    assert per.count() == 2 * sizes.where("n_tokens > 0").select("doc_id").distinct().count()
    assert got.where("loss_tokens > token_end - token_begin or loss_tokens < 0").count() == 0
    prompted = sizes.withColumn("prompt_tokens", F.col("n_tokens") % 40)
    many = limits.select("capacity_tokens").union(spark.range(64, 1264).selectExpr("cast(id as int)")).selectExpr("concat('c', capacity_tokens) container", "capacity_tokens")
    assert packing.fill_containers(prompted.limit(3), many).select("container").distinct().count() == 1202  # every kind of container
    over = got.groupBy("container", "container_id").agg(F.sum(F.expr("token_end - token_begin")).alias("t"), F.max("capacity").alias("c")).where("t > c")
    assert over.count() == 0
    assert packing.fill_containers(sizes.limit(0), limits).count() == 0


def test_sizes(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "x " * 5000)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in packing.sized(docs).collect()}
    assert set(got) == {1, 4} and 1 < got[1] < 5 and got[4] >= 5000
    heads = spark.createDataFrame([(1, "What is it? It is a lamp."), (2, "Title\nBody of the text"), (3, "One sentence only."), (4, " \n x")], "doc_id long, text string")
    parts = {r["doc_id"]: (r["prompt_tokens"], r["n_tokens"]) for r in packing.sized(heads).collect()}
    assert parts[3][0] == parts[4][0] == 1 and 1 < parts[1][0] < parts[1][1] and 1 <= parts[2][0] < parts[2][1]


def test_mixture(spark):
    docs = [(i, f"text {i} " + "word " * (i % 50 + 5), "big" if i % 10 else "small") for i in range(3000)]
    docs += [(5000, docs[0][1], "big"), (5001, None, "big"), (5002, "", "big"), (5003, "alone", None), (5004, "other", "unlisted")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("none", 0.0, 1), (None, 0.5, 2), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    targets_of = targets.where("source in ('big', 'small')")
    pool = mixing.text_pool(df, targets_of)
    assert pool.count() == 3000
    m = mixing.mix_sources(pool, targets_of, tolerance=0.0).cache()
    report = {r["source"]: r for r in mixing.mix_report(m, pool, targets_of).collect()}
    assert abs(report["big"]["actual_share"] - 0.6) < 0.02 and abs(report["small"]["actual_share"] - 0.4) < 0.02
    assert report["small"]["most_uses"] <= 3 and report["big"]["most_uses"] <= 1
    # any stretch of the mixture has the shares
    half = m.where(F.col("slot") < m.agg(F.max("slot")).first()[0] / 2).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()
    t = {r["source"]: r["t"] for r in half}
    assert abs(t["big"] / sum(t.values()) - 0.6) < 0.05
    assert mixing.mix_sources(pool.limit(0), targets_of).count() == 0
    much = mixing.mix_sources(pool, targets_of, total_tokens=10_000_000)
    assert much.groupBy("source", "key").count().where("(source = 'big' AND count > 1) OR count > 3").count() == 0
    assert mixing.mix_sources(mixing.text_pool(df, targets), targets).count() > 0


def test_each_source_of_a_mixture_has_its_share(spark):
    pool = spark.createDataFrame([("big", i, 20 + i % 50) for i in range(3000)] + [("tiny", 10_000 + i, 20 + i % 5) for i in range(20)], "source string, key long, n_tokens int")
    targets = spark.createDataFrame([("big", 0.99, 1), ("tiny", 0.01, 2)], "source string, target_share double, max_repeats int")
    report = {r["source"]: r for r in mixing.mix_report(mixing.mix_sources(pool, targets), pool, targets).collect()}
    assert abs(report["tiny"]["actual_share"] / 0.01 - 1) < 0.1 and abs(report["big"]["actual_share"] / 0.99 - 1) < 0.01
    assert report["tiny"]["most_uses"] == 2 and report["big"]["most_uses"] == 1
