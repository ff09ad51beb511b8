"""Merging of rules: many copies of few consequences."""

from lumentab.operators import pairing, rules


def test_copies_of_a_rule_are_compared_once(spark, monkeypatch):
    rows = [(f"r{i:04}", ["c", "d", None][i % 3], ["pays 20 units", "pay 20 unit", "pays 30 units", "!!", None][i % 5], i % 7 > 0, [f"s{i % 4}", f"s{i % 3}"], i) for i in range(900)]
    df = spark.createDataFrame(rows, "rule_id string, condition string, consequence string, exclusive boolean, source_ids array<string>, pos int")
    met, real = [], pairing.meetings

    def counted(posts, *a, **k):
        out = real(posts, *a, **k)
        met.append(out.count())
        return out

    monkeypatch.setattr(pairing, "meetings", counted)
    got = {r["rule_id"]: (r["condition"], r["exclusive"], r["source_ids"]) for r in rules.merge_rules(df).collect()}
    # the rule itself, one after the other
    want: dict = {}
    text = {"pays 20 units": "20", "pay 20 unit": "20", "pays 30 units": "30", "!!": "!!", None: ""}
    for i, c, t, x, s, _ in rows:
        k = (c, text[t]) if c else i
        first, flags, ids = want.setdefault(k, (i, [], []))
        flags.append(x)
        ids.extend(y for y in dict.fromkeys(s) if y not in ids)
    assert got == {first: (dict((r[0], r[1]) for r in rows)[first], all(flags), ids) for first, flags, ids in want.values()}
    assert met[0] < 1000  # of 300 rules of a condition each sixty say the same
