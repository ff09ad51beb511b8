import csv
import io

from hypothesis import given, settings
from hypothesis import strategies as st

from lumentab.operators import row_parse as R


@given(st.lists(st.text(alphabet='ab",;\n| ', max_size=6), min_size=1, max_size=6), st.sampled_from(",;|"))
@settings(max_examples=300, deadline=None)
def test_round_trip(fields, delimiter):
    out = io.StringIO()
    csv.writer(out, delimiter=delimiter, lineterminator="").writerow(fields)
    text = out.getvalue()
    assert R.sound_fields(text, delimiter) == fields
    assert R.cheapest_edits(text, delimiter, len(fields))[0] == 0


@given(st.text(alphabet='a",', max_size=9), st.integers(1, 3))
@settings(max_examples=300, deadline=None)
def test_cost_zero_means_sound(text, columns):
    cost, _ = R.cheapest_edits(text, ",", columns)
    fields = R.sound_fields(text, ",")
    assert (cost == 0) == (fields is not None and len(fields) == columns)


def test_reasons():
    head = "question,expected_answer,answerable,reference_claims"
    reason = lambda t, h=head: R.parse_record(t, ",", h)[0]
    assert reason('q,a,yes,"[""c""]"') is None
    assert reason("q,a,yes,,,") is None  # surplus empty fields
    assert reason('q,"a') == "broken_quoting" == reason('q,a"b,,') == reason('q,"a"b,,') == reason('q, "a",,')
    assert reason("q,a,yes") == "column_count" == reason("q,a,yes,,x") == reason("") == reason(None)
    assert reason(" ,a,yes,") == reason("q,a,maybe,") == reason('q,a,1,"{}"') == reason('q,a,1,"[1]"') == "invalid_value"
    assert R.parse_record("q,a", None, None)[0] == "no_header"
    assert R.parse_record('q,"a,1,', ",", head)[2] >= 1


def test_table(spark):
    files = spark.createDataFrame([("f", ",", "question,expected_answer"), ("f", ",", "question,expected_answer")], "file_name string, delimiter string, header_text string")
    rows = [(1, "f", 2, "q,a", "x"), (1, "f", 2, "q,a", "x"), (2, "f", 3, None, "y"), (3, "g", 2, "q,a", None), (4, None, 2, "q," + "a" * 100_000, "z")]
    raw = spark.createDataFrame(rows, "raw_id long, file_name string, row_no int, raw_text string, reason string")  # an extra column of a clashing name
    got = {r["raw_id"]: r["reason"] for r in R.parse_rows(raw, files).collect()}
    assert got == {1: None, 2: "column_count", 3: "no_header", 4: "no_header"}
    errors = R.import_errors(R.parse_rows(raw, files)).where("file_name = 'f'").first()
    assert (errors["total"], errors["accepted"], errors["skipped"]) == (3, 2, 1) and errors["errors"][0]["row"] == 3
    assert R.parse_rows(raw.limit(0), files).count() == 0


def test_edits_give_the_reason():
    """Delimiters alone mend a record whose quotes are sound, whatever is quoted; nothing but a quote mends the others."""
    import random

    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice('ab"",;') for _ in range(rng.randrange(1, 14)))
        n = rng.randrange(1, 6)
        cost, edits = R.cheapest_edits(text, ",", n)
        fields = R.sound_fields(text, ",")
        assert (cost >= R.QUOTING) == (fields is None)
        assert (cost == 0) == (fields is not None and len(fields) == n)
        if fields is not None:
            assert cost == abs(len(fields) - n) == len(edits)
