import random

from pyspark.sql import functions as F

from lumentab.operators import drafts


def test_values_and_claims(spark):
    df = spark.createDataFrame([('{"a.b": 1, "a": {"b": 2, "c": {"code": "x", "description": "full"}}, "e": {"f": 1}}', ["x", "y", "z"])], "p string, c array<string>")
    got = df.select(*[drafts.profile_value(F.col("p"), k).alias(k.replace(".", "_")) for k in ("a.b", "a.c", "e", "q", "a.q")]).first()
    assert tuple(got) == ("1", "full", '{"f":1}', None, None)
    keep = lambda *ids: df.select(drafts.kept_claims(F.col("c"), F.array(*map(F.lit, ids)).cast("array<int>")).alias("k")).first()["k"]
    assert keep(3, 1, 3) == ["x", "z"] and keep() == ["x", "y", "z"] and keep(4) is None and keep(0) is None


def test_fields_and_anchors(spark):
    p = spark.createDataFrame([("r", 2, "age"), ("r", 1, " unit "), ("r", 3, "born"), ("s", 1, "age")], "rule_id string, pos int, key string")
    got = {r["rule_id"]: r["fields"] for r in drafts.decisive_fields(p, spark.createDataFrame([("age", "born")], "key string, source string")).collect()}
    assert got == {"r": ["unit", "born"], "s": ["born"]}
    q = spark.createDataFrame([(1, "canonical", None), (2, "natural_user", 1), (3, "canonical", None), (4, None, None)], "question_id int, question_form string, parent_question_id int")
    assert {r["question_id"] for r in drafts.marked_anchors(q).where("anchor").collect()} == {1} and drafts.marked_anchors(q, False).where("anchor").count() == 0
    assert drafts.next_number(spark.createDataFrame([("Q0007",), ("X9",), (None,)], "id string")) == 8 and drafts.next_number(spark.createDataFrame([], "id string")) == 1
    assert drafts.basic_samples(spark.createDataFrame([("a", "k", "v"), ("a", "k", "v"), ("b", "k", None)], "person string, key string, value string"), 3, 5).count() == 1


def test_drafts(spark):
    good = ("How much?", "20", "10", ["c"], ["d"], "g")
    rows = [(1, "r", True, *good), (2, "r", True, " ", *good[1:]), (3, "r", True, "How much?", "20", None, ["c"], ["d"], "g"), (4, "r", False, "How much?", "20", None, ["c"], None, "g"), (5, "r", True, *good[:4], [" "], "g")]
    rows += [(6, "r", True, *good[:5], ""), (7, "r", True, "What of 25 years?", *good[1:]), (8, "r", True, "What of 250 years?", *good[1:]), (9, "r", True, "What of the  OLD staff?", *good[1:]), (10, None, True, *good)]
    d = spark.createDataFrame(rows, "draft_id int, rule_id string, exclusive boolean, question string, answer_if_applies string, answer_if_not string, claims_if_applies array<string>, claims_if_not array<string>, general_rule_claim string")
    p = spark.createDataFrame([("r", "number", ["25"]), ("r", "enum", ["old staff", "x"]), ("r", "bool", ["true"])], "rule_id string, kind string, values array<string>")
    got = {r["draft_id"]: r["reason"] for r in drafts.draft_faults(d, p).collect()}
    again = "question_restates_condition"
    assert got == {1: None, 2: "blank_question", 3: "blank_answer", 4: None, 5: "missing_claims", 6: "missing_general_claim", 7: again, 8: None, 9: again, 10: None}


def test_stated_conditions(spark):
    rows = [
        (1, "number", "gte", ["25"], ["age"], "above 24 years", True), (2, "number", "eq", ["25"], ["age"], "above 24 years", False), (3, "number", "gte", ["1"], ["children"], "for each child of childrens", True),
        (4, "date", "eq", ["2024-03-01"], ["start"], "from 2024 on", True), (5, "enum", "eq", ["married"], ["family status"], "who is married", True), (6, "enum", "eq", ["married"], ["family status"], "whoever comes", False),
        (7, "bool", "eq", ["true"], ["parent"], "parents only", True), (8, "enum", "eq", ["נשוי"], ["מצב"], "לנשואים בלבד", True), (9, "text", "eq", ["x"], ["unit"], None, False),
    ]
    df = spark.createDataFrame(rows, "id int, kind string, op string, values array<string>, names array<string>, quote string, want boolean")
    assert [(r["id"], r["stated"]) for r in drafts.stated_conditions(df).where("stated <> want").collect()] == []
    assert df.select(drafts.predicate_text(F.lit("Age"), F.lit("age"), F.col("op"), F.col("values")).alias("t")).first()["t"] == "Age (age) >= 25"


def test_carry(spark):
    rows = [("t", 1, 3, 1), ("t", 2, 2, 5), ("t", 3, 0, 0), ("t", 4, 4, 4), ("u", 1, 1, 1)]
    got = {(r["topic"], r["window_no"]): r["target"] for r in drafts.carried_targets(spark.createDataFrame(rows, "topic string, window_no int, goal int, made int")).collect()}
    carry, want = 0, {}
    for t, w, goal, made in rows[:4]:
        want[t, w] = goal + carry
        carry = goal + carry - made if goal + carry > 0 else carry
    assert got == want | {("u", 1): 1}


def test_fitting_rows(spark):
    rng = random.Random(6)
    for budget in (5, 60, 10_000):
        rows = [(i, rng.randrange(1, 30)) for i in range(60)]
        room, want = budget, []
        for i, n in rows:
            if n <= room:
                want.append(i)
                room -= n
        got = drafts.fitting_rows(spark.createDataFrame(rows, "i int, n int"), ["i"], "n", budget)
        assert sorted(r["i"] for r in got.collect()) == want
    assert drafts.fitting_rows(spark.createDataFrame([], "i int, n int"), ["i"], "n", 5).count() == 0
