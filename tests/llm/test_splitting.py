from hypothesis import given, settings
from hypothesis import strategies as st

from lumentab.llm import splitting as S


@given(st.text(alphabet="ab. \n#", max_size=200), st.integers(1, 40), st.integers(0, 60))
@settings(max_examples=400, deadline=None)
def test_pieces(text, limit, overlap):
    p = S.pieces(text, limit, overlap)
    assert "".join(text[a:e] for _, a, e in p) == text
    assert all(e - a0 <= limit and a < e for a0, a, e in p)
    lap = max(0, min(overlap, limit - 1))
    if len(text) > limit:
        assert all(a - a0 == min(lap, a) for a0, a, e in p)


def test_natural_cuts():
    text = "# One\n" + "Alpha beta. " * 6 + "\n\n" + "Gamma delta. " * 6
    cuts = [text[a:e] for _, a, e in S.pieces(text, 90, 10)]
    assert cuts[0].endswith("\n\n") and all(c.rstrip().endswith(".") for c in cuts)


def test_nested_structure():
    part = "Some words of the part. " * 3
    text = f"# One\n{part}\n## One a\n{part}\n## One b\n{part}\n# Two\n{part}\n"
    one = text.index("# Two")
    cuts = [(a, e) for _, a, e in S.pieces(text, one, 0)]
    assert cuts == [(0, one), (one, len(text))]  # a section stays with its subsections
    cuts = [text[a:e] for _, a, e in S.pieces(text, len(part) + 20, 0)]
    assert [c.split("\n")[0] for c in cuts] == ["# One", "## One a", "## One b", "# Two"]
    items = "- first thing\n  - of the first\n  - more of it\n- second thing\n  - of the second\n"
    cuts = [items[a:e] for _, a, e in S.pieces(items, items.index("- second") + 1, 0)]
    assert cuts == [items[: items.index("- second")], items[items.index("- second") :]]


def test_boundary():
    assert S.boundary("a" * 5 + "\n \n" + "b" * 5, 5) == "paragraph"
    assert S.boundary("aaaa. bbbb.", 6) == "sentence"
    assert S.boundary("aaaa bbbb", 6) == "word"
    assert S.boundary("a" * 9, 6) == "none"


def test_table(spark):
    limits = spark.createDataFrame([("md", 50, 10), ("TXT", 20, 30)], "suffix string, max_chars int, overlap_chars int")
    rows = [("a#1", "x/a.MD", None, "word " * 30, "k"), ("a#1", "x/a.MD", None, "word " * 30, "k"), ("b#1", "b.txt", "p", "y" * 100, "k"), ("c#1", "c.md", "p", None, "k"), ("d#1", "d.md", "p", "", "k"), ("e#1", "e.foo", "p", "z" * 900, "k"), ("f#1", None, "p", "z", "k")]
    df = spark.createDataFrame(rows, "chunk_id string, file string, location string, text string, boundary string")
    got = S.split_oversized(df, limits)
    assert {(r["chunk_id"], r["boundary"]) for r in got.collect()} == {("a#1", "word"), ("b#1", "none")}
    assert got.where("length(text) > 50").count() == 0
    assert S.split_oversized(df, limits, only_oversized=False).where("chunk_id = 'e#1'").first()["text"] == "z" * 900
    assert S.split_oversized(df.limit(0), limits).count() == 0
