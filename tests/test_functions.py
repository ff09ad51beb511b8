import datetime

import pytest
from pyspark.sql import functions as F

from lumentab.functions import dates, text
from lumentab.functions.headers import resolve_headers
from lumentab.operators import chunking, generation, graph, pages, personas, planning, rules
from lumentab.options import load_options


def one(spark, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols))


def test_claims_do_not_split_beside_digits(spark):
    df = one(spark, t="Pays 3.5 units. Needs form B! is 100. Next\n- a line")
    got = df.select(text.derived_claims(F.col("t")).alias("c")).first()["c"]
    assert got == ["Pays 3.5 units", "Needs form B", "is 100. Next", "a line"]
    df = one(spark, t="·one  two\n(א.שלוש\n2)four\nא.חמש\n– six")
    assert df.select(text.derived_claims(F.col("t")).alias("c")).first()["c"] == ["one two", "(א", "שלוש", "four", "א", "חמש", "– six"]
    assert one(spark, t=" ... ").select(text.derived_claims(F.col("t")).alias("c")).first()["c"] == ["..."]


def test_hebrew_words(spark):
    forms = lambda w: one(spark, w=w).select(text.bare_forms(F.col("w")).alias("f")).first()["f"]
    assert forms("והכלב") == ["הכלב", "כלב"] and forms("שלו") == [] and forms("abcd") == []
    like = lambda a, b: one(spark, a=a, b=b).select(text.word_similarity(F.col("a"), F.col("b")).alias("s")).first()["s"]
    assert like(["בבית"], ["בית"]) == 1.0 and like(["בבית", "x"], ["ובית", "x"]) < 1.0  # only the remainder is shared
    names = spark.createDataFrame([("  It's  “Fine” ",), ("ｃａｆé ﬁle",), ("Straße",), (None,)], "n string").select(text.plain_name("n").alias("p")).collect()
    assert [r["p"] for r in names] == ["its fine", "café file", "strasse", None]
    keys = lambda n: one(spark, n=n).select(text.name_keys("n").alias("k")).first()["k"]
    assert keys('ולמע"מ') == ["ולמעמ", "מעמ"] and keys("שכר") == ["שכר"] and keys("ולשכר הוגן") == ["ולשכר הוגן", "שכר הוגן"]


def test_words_that_share_only_a_remainder_do_not_meet(spark):
    from lumentab.operators import retrieval

    docs = spark.createDataFrame([(1, "המורה לימד"), (2, "הורה אחד"), (3, "לעובד"), (4, "other words")], "id long, t string")
    ask = lambda q: {r["doc"] for r in retrieval.bm25_top_k(docs, "id", "t", spark.createDataFrame([(9, q)], "q long, t string"), "q", "t").collect()}
    assert ask("הורה") == {2} and ask("עובד") == {3} and ask("מורה") == {1} and ask("nothing") == set()


def test_locate_quote():
    t = "The fund pays 20 units. It ends in May."
    a, b = text.locate_quote(t, "fund pays ... ends in may")
    assert t[a:b] == "fund pays 20 units. It ends in May"
    assert text.locate_quote(t, "ends ... fund") is None


def test_windows_and_cuts(spark):
    df = one(spark, t="abcdefghij" * 30, q="ghij")
    row = df.select(text.middle_cut(F.col("t"), 50).alias("m"), text.quote_window(F.col("t"), F.col("q"), 20).alias("w")).first()
    assert len(row["m"]) == 50 and " [...] " in row["m"]
    assert "ghij" in row["w"]


@pytest.mark.parametrize("start,end,months", [("2024-01-31", "2024-02-29", 0), ("2024-01-15", "2024-03-15", 2), ("2024-03-15", "2024-01-15", -2), ("2024-01-15", "2025-01-14", 11)])
def test_completed_months(spark, start, end, months):
    df = one(spark, s=datetime.date.fromisoformat(start), e=datetime.date.fromisoformat(end))
    assert df.select(dates.completed_months(F.col("s"), F.col("e"))).first()[0] == months


def test_leap_years(spark):
    df = one(spark, d=datetime.date(2024, 2, 29))
    assert df.select(dates.add_years(F.col("d"), 1)).first()[0] == datetime.date(2025, 2, 28)
    assert dates.date_pattern("%d/%m/%Y") == "dd/MM/yyyy"


def test_blocks_and_packing():
    t = "# Title\nfirst line\nsecond  line\n\nNotes:\nthird"
    assert chunking.blocks(t) == ["# Title", "first line second line", "Notes:", "third"]
    packed = chunking.packed([f"block {i} " + "x" * 40 for i in range(9)] + ["y" * 250], 120, 60)
    assert all(len(x) <= 120 for *_, x in packed)
    assert [a for a, *_ in packed] == sorted(a for a, *_ in packed)
    assert {n for a, b, _ in packed for n in range(a, b + 1)} == set(range(1, 9 + len(range(0, 250, 60)) + 1))  # pieces, each in a chunk
    assert chunking.blocks("a\x0bb\n\n c:\n") == ["a b", "c:"]
    # where going back would begin at the chunk itself, the next begins behind it
    assert [x[:2] for x in chunking.packed(["a" * 10, "b" * 10, "c" * 90], 100, 30)] == [(1, 2), (3, 3)]
    assert [x[:2] for x in chunking.packed(["a" * 60, "b" * 10, "c" * 90], 100, 30)] == [(1, 2), (2, 2), (3, 3)]
    assert [x[:2] for x in chunking.packed(["a" * 60, "b" * 10, "c" * 60], 100, 30)] == [(1, 2), (2, 3)]
    assert chunking.page_sections("lead <!-- page: 1 --> one <!-- page: 2 --> two") == [("page 1", "lead\n\none"), ("page 2", "two")]


def test_kleene(spark):
    rows = [("a", True), ("a", None), ("b", False), ("b", None), ("c", True), ("c", True)]
    got = spark.createDataFrame(rows, "k string, r boolean").groupBy("k").agg(rules.conjunction(F.col("r")).alias("x")).collect()
    assert {r["k"]: r["x"] for r in got} == {"a": None, "b": False, "c": True}


def test_consequences(spark):
    like = lambda a, b: one(spark, a=a, b=b).select(rules.consequence_similarity(F.col("a"), F.col("b")).alias("s")).first()["s"]
    assert like("pays 20 units", "pays 30 units") == 0 and like("pays 20 units", "pay 20 unit") == 1.0 and like("", "") == 0


def test_merged_rules(spark):
    rows = [
        ("a", "c", "pays 20 units", True, ["s1"], 1), ("b", "c", "pay 20 unit", False, ["s2", "s1"], 2), ("d", "c", "pays 30 units", True, ["s3"], 3), ("e", "x", "pays 20 units", True, ["s4"], 4),
        ("f", "c", "!!", True, ["s5"], 5), ("g", "c", "!!", None, ["s6"], 6), ("h", "c", "one two three four", True, ["s7"], 7), ("i", "c", "one two three four five six", True, ["s8"], 8), ("j", "c", "three four five six", True, ["s9"], 9),
    ]
    df = spark.createDataFrame(rows, "rule_id string, condition string, consequence string, exclusive boolean, source_ids array<string>, pos int")
    got = {r["rule_id"]: (r["exclusive"], r["source_ids"]) for r in rules.merge_rules(df).collect()}
    # i is like h and goes with it; j is like i only, which doesn't stay
    assert got == {"a": (False, ["s1", "s2"]), "d": (True, ["s3"]), "e": (True, ["s4"]), "f": (False, ["s5", "s6"]), "h": (True, ["s7", "s8"]), "j": (True, ["s9"])}
    assert rules.merge_rules(df.limit(0)).count() == 0


def test_covering_and_repair():
    dims = {"a": [1, 2, 3], "b": ["x", "y"], "c": [True, False]}
    rows = personas.covering_rows(dims)
    pairs = {(p, r[p], q, r[q]) for r in rows for p in dims for q in dims if p < q}
    assert len(pairs) == 6 + 6 + 4
    assert personas.repair({"n": 3, "l": ["a"]}, counts=[("n", "l")])["n"] == 1
    assert len(personas.repair({"n": 3, "l": ["a"]}, counts=[("n", "l")], pinned={"n"})["l"]) == 3
    assert personas.repair({"s": "2024-01-01", "e": "2024-01-02"}, gaps=[("s", "e", 10)])["e"] == "2024-01-11"


def test_planning_rules(spark):
    assert planning.precision_floor(0.2) == 25 and planning.precision_floor(0) == 0
    w = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 1.0)], "name string, weight double")
    zero = w.withColumn("weight", F.lit(0.0))
    assert {r["name"]: r["quota"] for r in planning.largest_remainder(zero, 5, minimum=1).collect()} == {"a": 2, "b": 2, "c": 1}
    assert {r["name"]: r["quota"] for r in planning.divisor_quota(w, 9, 2, minimum=5).collect()} == {"a": 2, "b": 2, "c": 2}
    rows = spark.createDataFrame([("f", i) for i in range(7)], "f string, i long")
    assert planning.balanced_windows(rows, "f", ["i"], 5, wanted=30).select("window_no").distinct().count() == 4
    assert planning.balanced_windows(rows, "f", ["i"], 5, wanted=900).select("window_no").distinct().count() == 7
    goals = planning.window_goals(spark.createDataFrame([("f", 1, 1.0, 5), ("f", 2, 1.0, 5), ("g", 1, 0.0, 5)], "f string, window_no long, w double, n int"), "f", "w", "n")
    assert sorted(map(tuple, goals.collect())) == [("f", 1, 3), ("f", 2, 2), ("g", 1, 0)]
    assert sum(r["quota"] for r in planning.largest_remainder(w, 10).collect()) == 10
    got = {r["name"]: r["quota"] for r in planning.divisor_quota(w, 9, 9).collect()}
    q = {"a": 1, "b": 1, "c": 1}
    for _ in range(6):
        k = max(q, key=lambda n: ({"a": 5, "b": 3, "c": 1}[n] / (q[n] + 1), -ord(n)))
        q[k] += 1
    assert got == q


def cut_rule(nodes, edges, limit):
    """One cluster after the other, as the rule says: along its components, then without its lightest edges, until it parts."""
    if len(nodes) <= limit:
        return [sorted(nodes)]

    def parts(own):
        left, out = set(nodes), []
        while left:
            todo, seen = [left.pop()], []
            while todo:
                x = todo.pop()
                seen.append(x)
                for a, b, _ in own:
                    y = b if a == x else a if b == x else None
                    if y in left:
                        left.discard(y)
                        todo.append(y)
            out.append(seen)
        return out

    inner = [e for e in edges if e[0] in nodes and e[1] in nodes]
    for bar in [0, *sorted({w for *_, w in inner})] if inner else []:
        if len(p := parts([e for e in inner if e[2] > bar])) > 1:
            return [y for x in p for y in cut_rule(set(x), edges, limit)]
    return [sorted(nodes)]


def test_split_clusters(spark):
    import random

    rng = random.Random(8)
    edges = [(a, b, float(rng.randrange(2, 6))) for a in range(60) for b in range(a + 1, 60) if a // 20 == b // 20 and rng.random() < 0.2]
    edges += [(100 + i, 101 + i, 3.0) for i in range(6)]  # of one weight: all fall apart
    members = [(i, f"c{i // 20}") for i in range(60)] + [(100 + i, "line") for i in range(7)] + [(200 + i, "none") for i in range(9)] + [(300, "small")]
    got = graph.split_oversized(spark.createDataFrame(members, "id long, origin string"), spark.createDataFrame(edges, "src long, dst long, weight double"), 5).collect()
    mine = {}
    for r in got:
        mine.setdefault((r["origin"], r["part"]), []).append(r["id"])
    want = [p for o in {o for _, o in members} for p in cut_rule({i for i, x in members if x == o}, edges, 5)]
    assert sorted(map(sorted, mine.values())) == sorted(want)


def test_capped_topics(spark):
    sizes = [9, 5, 3, 3, 2, 2, 2, 1, 1, 1]
    rows = [(1000 * k + i, f"k{k}") for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, origin string").withColumn("part", F.lit(None).cast("string"))

    def rule(most, limit):
        out, bucket, held = [[k] for k in range(most - 1)], [], 0
        for k in range(most - 1, len(sizes)):
            if bucket and held + sizes[k] > limit:
                out.append(bucket)
                bucket, held = [], 0
            bucket.append(k)
            held += sizes[k]
        return out + [bucket]

    for most, limit in ((3, 5), (4, 4), (2, 100), (5, 2)):
        got: dict = {}
        for r in graph.capped_topics(df, most, limit).collect():
            got.setdefault(r["topic"], set()).add(r["id"] // 1000)
        assert [sorted(got[k]) for k in sorted(got)] == rule(most, limit)
    assert graph.capped_topics(df, 20, 5).select("topic").distinct().count() == len(sizes)
    assert graph.capped_topics(df.limit(0), 3, 5).count() == 0


def test_weak_hubs_and_dense_graphs(spark):
    nodes = spark.createDataFrame([(i,) for i in range(26)], "id long")
    weak = spark.createDataFrame([(0, i, "shared_entity", 1.0) for i in range(1, 26)] + [(i, i + 1, "same_document", 1.0) for i in range(25)], "src long, dst long, type string, weight double")
    assert graph.entity_clusters(nodes, weak, 50).select("topic").distinct().count() == 26
    dense = spark.createDataFrame([(a, b, "shared_entity", 2.0 + (a * b) % 4) for a in range(26) for b in range(a + 1, 26)], "src long, dst long, type string, weight double")
    rows = graph.entity_clusters(nodes, dense, 6, 8).collect()
    sizes = {t: sum(r["topic"] == t for r in rows) for t in {r["topic"] for r in rows}}
    assert len(rows) == 26 and max(sizes.values()) <= 8
    themed = nodes.withColumn("theme", F.when(F.col("id") < 17, " Pay ").when(F.col("id") < 20, "leave").otherwise(F.lit("אחר")))
    rows = graph.theme_clusters(themed, dense, 40, 8).collect()
    of = {r["id"]: r["topic"] for r in rows}
    sizes = {t: sum(r["topic"] == t for r in rows) for t in set(of.values())}
    assert len(rows) == 26 and max(sizes.values()) <= 8 and len({of[i] for i in range(17, 20)}) == 1 and len({of[i] for i in range(17)}) == 3
    assert not {of[i] for i in range(17)} & {of[i] for i in range(17, 26)}


def test_walk_from_all_seeds(spark):
    import random

    rng = random.Random(5)
    edges = sorted({(a, b): float(rng.randrange(1, 9)) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.3}.items())
    near: dict = {}
    for (a, b), w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    near = {k: sorted(v, key=lambda x: (-x[1], x[0])) for k, v in near.items()}
    seeds = [("t", 1, 4), ("t", 2, 9), ("u", 1, 11), ("v", 1, 99)]
    got: dict = {}
    for r in graph.evidence_walk(spark.createDataFrame(seeds, "topic string, pos int, id long"), spark.createDataFrame([(a, b, w) for (a, b), w in edges], "src long, dst long, weight double")).orderBy("topic", "place").collect():
        got.setdefault(r["topic"], []).append(r["id"])
    assert got["v"] == [99] and got["t"][:2] == [4, 9] and len(got["t"]) == 8
    for t, s in (("t", [4, 9]), ("u", [11])):
        taken = list(s)
        while len(taken) < 8:
            taken.append(min(((-w, i, y) for i, x in enumerate(taken) for y, w in near[x] if y not in taken))[2])
        assert got[t] == taken


def test_names_and_matches(spark):
    sig = spark.createDataFrame([(1, 1, "Pay"), (1, 2, "Leave"), (2, 1, "Pay"), (2, 2, "Leave"), (2, 3, "Form"), (3, 1, "Pay"), (3, 2, "Leave"), (3, 3, "Form")], "topic long, place long, display string")
    assert {r["topic"]: r["name"] for r in graph.topic_names(sig).collect()} == {1: "Pay / Leave", 2: "Pay / Leave – Form", 3: "Pay / Leave – Form (2)"}
    nodes = spark.createDataFrame([("a", ["Sick Leave"], ["x"], "s", "about leave"), ("b", [], [], "", "leave of sick staff"), ("c", None, None, None, "other")], "chunk_id string, entities array<string>, keyphrases array<string>, summary string, text string")
    assert [(r["chunk_id"], r["score"]) for r in graph.topic_matches(nodes, "sick leave").collect()] == [("a", 4), ("b", 2)]


def test_components(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    ids = sorted({x for e in edges for x in e} | {999})
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = graph.components(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "src long, dst long"))
    assert {r["id"]: r["component"] for r in got.collect()} == {i: root(i) for i in ids}


def test_headers_and_options():
    assert resolve_headers(["Prompt", "תשובה צפויה", "bot_response", "x"]) == {"question": "Prompt", "expected_answer": "תשובה צפויה", "answer": "bot_response"}
    for bad in (["answer", "response", "question", "expected"], ["question", ""], ["question", "Question"], ["question"]):
        with pytest.raises(ValueError):
            resolve_headers(bad)
    with pytest.raises(ValueError, match="top_k.*overlap"):
        load_options(top_k=0, overlap_chars=5000)


def test_pages():
    assert pages.visual_to_logical("abc") == "abc"
    assert pages.visual_to_logical("25 רפס"[::1]) == "ספר 25"
    assert pages.table_markdown([["a", "b"], ["c|d"]]) == "| a | b |\n| --- | --- |\n| c\\|d |  |"
    assert pages.page_markdown([("Big", 18, False), ("one", 11, False), ("two", 11, False), ("• x", 11, False)], 11).startswith("# Big\n\none two\n\n- x")


def test_grounding(spark):
    from lumentab.operators import evidence

    chunks = spark.createDataFrame([("f#1", "f", "The fund **pays** 20 units."), ("f#2", "f", "It ends in May."), ("g#1", "g", "It begins in June.")], "chunk_id string, file string, text string")
    q1, q2, q3 = ("f#1", "pays  20 units"), ("f#2", "ends in may"), ("g#1", "It begins")
    good = ("q", "a", True, "basic_knowledge", ["f#1"], ["c"], [q1])
    cases = {
        None: good, "blank_question": (" ", *good[1:]), "blank_expected_answer": ("q", None, *good[2:]), "duplicate_source_ids": (*good[:4], ["f#1", "f#1"], ["c"], [q1]), "unknown_source_id": (*good[:4], ["z"], ["c"], [q1]),
        "invalid_unanswerable_type": ("q", "a", False, *good[3:]), "missing_source_ids": ("q", "a", False, "unanswerable", [], [], []), "unanswerable_has_reference_claims": ("q", "a", False, "unanswerable", ["f#1"], ["c"], []),
        "unanswerable_has_supporting_quotes": ("q", "a", False, "unanswerable", ["f#1"], None, [q1]), "unsupported_question_type": ("q", "a", True, "personal_basic", *good[4:]), "missing_evidence": (*good[:6], None), "missing_reference_claims": (*good[:5], [" "], [q1]),
        "duplicate_reference_claims": (*good[:5], ["c", "c "], [q1]), "quote_source_mismatch": (*good[:6], [q2]), "quote_not_verbatim": (*good[:6], [("f#1", "pays 21 units")]), "source_without_quote": (*good[:4], ["f#1", "f#2"], ["c"], [q1]),
        "invalid_document_wide_evidence": (*good[:3], "document_wide", ["f#1"], ["c"], [q1]), "invalid_cross_document_evidence": (*good[:3], "cross_document", ["f#1", "f#2"], ["c"], [q1, q2]),
    }
    fine = [(*good[:3], "document_wide", ["f#1", "f#2"], ["c"], [q1, q2]), (*good[:3], "cross_document", ["f#1", "g#1"], ["c"], [q1, q3]), ("q", "a", False, "unanswerable", ["f#1"], None, None)]
    rows = [(i, *c) for i, c in enumerate([*cases.values(), *fine])]
    df = spark.createDataFrame(rows, "candidate_id long, question string, expected_answer string, answerable boolean, question_type string, source_ids array<string>, claims array<string>, quotes array<struct<source_id: string, quote: string>>")
    got = {r["candidate_id"]: r["reason"] for r in evidence.candidate_grounding(df, chunks).collect()}
    assert [got[i] for i in range(len(rows))] == [*cases, None, None, None]
    assert {r["n"] for r in evidence.rejection_counts(evidence.candidate_grounding(df, chunks)).collect()} == {1}


def test_dedup_in_order(spark):
    rows = [("t", 1, "the old red house stands here today"), ("t", 2, "the old red house stands here now today"), ("t", 3, "something else"), ("u", 1, "the old red house stands here today"), ("t", 4, ""), ("t", 5, "something else")]
    got = generation.dedup_in_order(spark.createDataFrame(rows, "topic string, pos long, question string"))
    assert sorted((r["topic"], r["pos"]) for r in got.collect()) == [("t", 1), ("t", 3), ("t", 4), ("u", 1)]


def test_import_errors(spark):
    from lumentab.operators import validation

    rows = [("fine", None), ("fine", " quota  gone "), ("", None), (validation.PLACEHOLDER.replace(" ", "  "), ""), ("got a Spike Arrest Violation", None), ("[{'fault': 1}]", None), ('{"x": "errorCode"}', None), ('{"x": 1}', None), ("x", "e" * 300)]
    df = spark.createDataFrame(rows, "answer string, error string")
    got = [r[0] for r in df.select(validation.import_error(F.col("answer"), F.col("error"))).collect()]
    assert got[:8] == ["", "stored_error: quota gone", validation.EMPTY_ERROR, validation.PLACEHOLDER_ERROR, validation.THROTTLED_ERROR, validation.FAULT_ERROR, validation.FAULT_ERROR, ""]
    assert got[8] == "stored_error: " + "e" * 240 + "…"


def test_retry_delays():
    from lumentab.models import retry_delay, with_required

    most = lambda: 1.0
    assert retry_delay(10, None, jitter=most) == 60.0 and retry_delay(0, None, jitter=most) == 1.25
    assert retry_delay(0, "7") == 7.0 and retry_delay(0, "700") == 60.0
    for bad in ("nan", "-3", "inf", "soon", "Wed, 01 Jan 2020 00:00:00 GMT"):
        assert retry_delay(1, bad, jitter=lambda: 0.0) == 2.0
    schema = {"properties": {"a": {"type": "array"}, "b": {"type": "string"}}, "required": ["b"]}
    assert with_required(schema, {"a": 2, "z": 1}) == {"properties": {"a": {"type": "array", "minItems": 2}, "b": {"type": "string"}}, "required": ["b", "a"]}
    assert schema["required"] == ["b"]


def test_fusion_ranks_documents_without_a_vector(spark, tmp_path):
    import __spark_entry__ as entry

    docs = [(20, "leave request of the desk"), (21, "leave request of the desk, signed"), (22, "another text"), (40, "cabinet of the office"), (41, "office cabinet")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(20, [1.0, 0.0]), (22, [0.9, 0.1])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["query"], r["doc"]): r["score"] for r in entry.queries()["rrf_fusion_all"](spark, str(tmp_path)).collect()}
    assert got[20, 20] == round(2 / 61, 9) and got[20, 22] == round(1 / 62, 9)
    assert got[20, 21] == round(1 / 62, 9)  # in the lexical list only
    assert {(40, 40), (40, 41)} <= set(got)  # a query without a vector


def test_greedy_dedup_tells_when_rounds_are_too_few(spark):
    from lumentab.operators import retrieval

    n = 8  # as many rounds
    items, pairs = spark.createDataFrame([(i,) for i in range(n)], "k long"), spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long")
    assert sorted(r[0] for r in retrieval.greedy_kept(items, pairs, "k").collect()) == list(range(0, n, 2))
    with pytest.raises(RuntimeError):
        retrieval.greedy_kept(items, pairs, "k", rounds=2)


def test_components_tell_when_rounds_are_too_few(spark):
    nodes, edges = spark.createDataFrame([(i,) for i in range(40)], "id long"), spark.createDataFrame([(i, i + 1) for i in range(39)], "src long, dst long")
    assert {r["component"] for r in graph.components(nodes, edges).collect()} == {0}
    with pytest.raises(RuntimeError):
        graph.components(nodes, edges, rounds=1)


def test_wilson(spark):
    from lumentab.functions.stats import rate, wilson

    df = spark.createDataFrame([(0, 0), (5, 10)], "k long, n long")
    low, high = wilson(F.col("k"), F.col("n"))
    assert df.select(rate(F.col("k"), F.col("n")), low, high).collect() == [(None, None, None), (0.5, 0.236590, 0.763410)]


def test_severity_and_states(spark):
    from lumentab.operators import compare, outcomes

    rows = [("unrelated_answer", "incorrect_abstention"), ("partial_too_little", "misleading_hallucination"), ("correct_answer", "correct_clarification"), ("partial_too_much", "correct_answer"), ("correct_abstention", "unrelated_answer"), ("judge_error", "correct_answer"), ("correct_answer", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(outcomes.second_vote(F.col("a"), F.col("b")).alias("h"), outcomes.second_vote(F.col("a"), F.col("b"), False).alias("l"), compare.state_of(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r["h"] for r in got] == ["incorrect_abstention", "misleading_hallucination", "correct_answer", "partial_too_much", "unrelated_answer", "judge_error", "correct_answer"]
    assert [r["l"] for r in got][:5] == ["unrelated_answer", "partial_too_little", "correct_answer", "correct_answer", "correct_abstention"]
    assert [r["s"] for r in got][:6] == ["unchanged_failure", "unchanged_failure", "unchanged_success", "improved", "regressed", "not_comparable"]


def test_recount_of_many_claims_and_its_faults(spark):
    from lumentab.operators import outcomes

    claim = lambda i: (f"C{i:03d}", True, i % 2 == 0)
    rows = [(1, "answer", 1001, 3, [claim(i) for i in range(1001, 0, -1)]), (2, "answer", 2, 3, [claim(1), claim(2)]), (3, "answer", 2, 0, [claim(1), claim(1)]), (4, "abstain", 0, 0, [claim(1)]), (5, "abstain", 7, 4, [])]
    df = spark.createDataFrame(rows, "question_id long, expected_behavior string, required int, retrieval_found int, assessments array<struct<id string, addressed boolean, correct boolean>>")
    got = {r["question_id"]: (r["fault"], r["required"], r["addressed"], r["correct"], r["retrieval_found"]) for r in outcomes.recount_claims(df).collect()}
    assert got == {1: (None, 1001, 1001, 500, 3), 2: ("found_above_claims", None, None, None, None), 3: ("claim_ids", None, None, None, None), 4: ("claims_of_non_answer", None, None, None, None), 5: (None, 0, 0, 0, 0)}


def test_a_chain_of_five_thousand(spark):
    from lumentab.operators import retrieval

    n = 5000
    items, links = spark.range(n).withColumnRenamed("id", "k"), spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b")
    assert sorted(r["k"] for r in retrieval.greedy_kept(items, links, "k").collect()) == list(range(0, n, 2))
    found = graph.components(items.withColumnRenamed("k", "id"), links.toDF("src", "dst"))
    assert found.count() == n and found.where("component <> 0").count() == 0


def test_greedy_dedup_against_the_loop(spark):
    import random

    from lumentab.operators import retrieval

    rng = random.Random(12)
    links = {(a, b) for a in range(150) for b in range(a + 1, 150) if rng.random() < 0.04}
    kept: set = set()
    for b in range(150):
        if not any((a, b) in links for a in kept):
            kept.add(b)
    items, df = spark.range(150).withColumnRenamed("id", "k"), spark.createDataFrame(sorted(links), "a long, b long")
    for apart, local in ((1, 500_000), (2, 500_000), (1, 3)):
        assert {r["k"] for r in retrieval.greedy_kept(items, df, "k", apart=apart, local=local).collect()} == kept
