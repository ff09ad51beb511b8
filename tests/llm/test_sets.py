import random

from lumentab.llm import neardup, setsim


def brute(sets, threshold):
    out = set()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if a != b and len(x & y) >= threshold * len(x | y) - 1e-9:
                out.add((min(a, b), max(a, b)))
    return out


def test_occurrences():
    rng = random.Random(2)
    for _ in range(300):
        lists = [sorted(rng.sample(range(30), rng.randrange(0, 25))) for _ in range(rng.randrange(1, 9))]
        least = rng.randrange(1, 6)
        want = {x: n for x in range(30) if (n := sum(x in y for y in lists)) >= least}
        assert dict(setsim.occurrences(lists, least)) == want


def test_similar_sets(spark):
    rng = random.Random(5)
    base = [[f"v{rng.randrange(60)}" for _ in range(rng.randrange(4, 10))] for _ in range(60)]
    rows = [(i, ["hot", " HOT ", *b, None, " "]) for i, b in enumerate(base)]
    rows += [(100 + i, [x for x in base[i] if rng.random() > 0.15] + ["Hot"]) for i in range(40)] + [(5, ["hot", *base[5]])] + [(200 + i, ["hot", "a", "b", "c", "d"]) for i in range(12)] + [(300, None), (301, []), (None, ["hot", "a", "b", "c", "d"])]
    df = spark.createDataFrame(rows, "k long, vals array<string>")
    rec = setsim.set_records(df, "k", "vals", 5)
    sets = sorted({(k, frozenset(x.strip().lower() for x in v if x and x.strip())) for k, v in rows if v and k is not None}, key=lambda x: (x[0], sorted(x[1])))
    want = brute([(k, s) for k, s in sets if len(s) >= 5], 0.6)
    assert {(r["key_a"], r["key_b"]) for r in setsim.similar_pairs(rec, 0.6).collect()} == want
    # the same with every prefix token split into blocks
    classes = setsim.class_table(rec)
    a = {(r["class_a"], r["class_b"]) for r in setsim.similar_classes(classes, 0.6).collect()}
    b = {(r["class_a"], r["class_b"]) for r in setsim.similar_classes(classes, 0.6, block=3, per_partition=10).collect()}
    flat = lambda x: {tuple(sorted(p)) for p in x}
    assert flat(a) == flat(b) and len(a) == len(flat(a))
    assert setsim.similar_pairs(rec.limit(0), 0.6).count() == 0
    # by representatives and their members, every link is there
    rep = {(r["key"], r["rep"]) for r in setsim.class_members(rec).collect()}
    links = {(r["rep_a"], r["rep_b"]) for r in setsim.similar_representatives(rec, 0.6).collect()}
    back = {(min(x, y), max(x, y)) for p, q in links for x, a in rep for y, b in rep if (a, b) == (p, q) and x != y} | {(x, y) for x, a in rep for y, b in rep if a == b and x < y}
    assert back == want
    left, right = rec.where("key < 60"), rec.where("key >= 100")
    across = {(r["rep_a"], r["rep_b"]) for r in setsim.similar_between(left, right).collect()}
    small = lambda df: {r["key"]: r["rep"] for r in setsim.class_members(df).collect()}
    lr = {(x, y) for x, y in want if x < 60 and y >= 100}
    of_left, of_right = small(left.where("key <> 5")), small(right)
    assert {(of_left[x], of_right[y]) for x, y in lr if x != 5} == {p for p in across if p[0] != 5} and len(across) > 0
    assert setsim.similar_between(left.limit(0), right).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 30))) for _ in range(80)]
    rows = [(i, t, "Yes. It is") for i, t in enumerate(texts)]
    for i in range(60):
        w = texts[i].split()
        w[rng.randrange(len(w))] = "new"
        rows.append((100 + i, " ".join(w).upper(), "yes it IS"))
    rows += [(3, texts[3], "Yes. It is"), (500, "long " + " ".join(f"z{i}" for i in range(300)), "a"), (501, "long " + " ".join(f"z{i}" for i in range(295)), "a"), (600, None, "x"), (601, "", "x"), (602, "...", "!!"), (603, "one", "one"), (604, "ONE", "one")]
    df = spark.createDataFrame(rows, "result_no long, question string, expected_answer string")
    import re

    sets = sorted({(i, frozenset(re.findall(r"[^\W_]+", f"{q} {e}".lower()))) for i, q, e in rows if q and e}, key=lambda x: x[0])
    want = brute([s for s in sets if s[1]], 0.8)
    got = neardup.near_duplicate_pairs(df)
    assert {tuple(r) for r in got.collect()} == want
    # frequent words as keys of pairs, and every key split into blocks
    classes = neardup.class_table(neardup.record_classes(df, "result_no", ["question", "expected_answer"]))
    plain = {tuple(sorted(r)) for r in neardup.similar_records(classes).collect()}
    for heavy, block in ((2, 4000), (5, 3), (1000, 2)):
        assert {tuple(sorted(r)) for r in neardup.similar_records(classes, heavy=heavy, block=block).collect()} == plain
    groups = {r["result_no"]: (r["class_key"], r["copies"], r["links"]) for r in neardup.near_duplicate_groups(df).collect()}
    assert groups[603] == groups[604] == (603, 2, 0) and 600 not in groups and 602 not in groups
    assert neardup.near_duplicate_pairs(df.limit(0)).count() == 0
