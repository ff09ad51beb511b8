import pytest

from lumentab.llm import pairs as P

Q = "How does the night guard review the visitor register under rule 12?"


@pytest.mark.parametrize(
    "answer,behavior,defect",
    [
        (None, None, "empty"), ("", None, "empty"), (" ​ \n", None, "empty"), ("N/A", None, "empty"), ("<p></p>", None, "empty"), ("...", None, "empty"), ("{}", None, "empty"),
        ('{"error": "quota", "code": 429}', None, "error"), ("HTTP 502: upstream did not respond", None, "error"), ("Traceback (most recent call last):\n  x", None, "error"), ("<html><head><title>504 Gateway Time-out</title></head></html>", None, "error"),
        (Q, None, "copy"), ("Question: " + Q.upper(), None, "copy"), (f"{Q} {Q}", None, "copy"), ("  How does   the night guard review the visitor register under rule 12.", None, "copy"),
        ("I'm sorry, but I can't help with that request.", "answer", "refusal"), ("I'm sorry, but I can't help with that request.", "abstain", ""), ("Leider kann ich dazu nichts sagen.", None, "refusal"), ("אין בידי מידע בנושא.", None, "refusal"),
        ("Der Nachtwächter prüft das Buch nach der Regel, wenn der Antrag gestellt ist.", None, "other_language"), ("הוא בודק את היומן לפי הכלל בכל ערב.", None, "other_language"),
        ("The guard signs it (every", None, "truncated"), ("The guard signs it every evening, and then", None, "?and then"), ("The guard signs it.", None, ""), ("Unfortunately this takes a while: the guard signs it every evening.", None, ""),
    ],
)
def test_types(answer, behavior, defect):
    assert P.first_defect(Q, answer, behavior, None) == defect


def test_lengths_decide_nothing():
    """Each text is beyond a length at which earlier versions stopped looking."""
    import json

    assert P.first_defect(Q, json.dumps({"error": "x" * 5000}), None, None) == "error"
    assert P.first_defect(Q, "An internal server error kept the answer service, " + "which we run for you, " * 40 + "from answering.", None, None) == "error"
    assert P.first_defect(Q, "I'm sorry, but for a number of reasons, " + "which we would name if we could, " * 30 + "I can't help with that request.", None, None) == "refusal"
    assert P.first_defect(Q, "I can't help with that. " + "The guard signs it every evening. " * 40, None, None) == ""
    assert P.first_defect(Q, "<p>" * 100 + " " * 300 + "</p>" * 100, None, None) == "empty"
    assert P.ending("The guard " + "w" * 500 + " goes") == "w" * 500 + " goes"


def test_copies():
    assert P.is_copy(Q, "You wanted to know: " + Q)  # a label by its form
    assert P.is_copy(Q, Q + " " + Q[:-4])  # nearly all of it, again
    assert not P.is_copy(Q, Q + " Yes.") and not P.is_copy(Q, Q + " Every evening: he signs it.")
    assert not P.is_copy(Q, "The night guard reviews the visitor register under rule 12.")
    assert not P.is_copy("", "x") and not P.is_copy("?", "?")
    assert P.uncovered("abcd", "xabcdyabcabcd", 4) == [(0, 1), (5, 9)]


def test_asked_language_and_reference():
    german = "Der Wächter prüft das Buch nach der Regel, wenn der Antrag gestellt ist."
    assert P.first_defect("Please answer in German: " + Q, german, None, None) == ""
    assert P.first_defect(Q, "The guard signs the long list", None, "The guard signs the long list of names.") == "truncated"
    assert P.first_defect(Q, "The guard signs the long list", None, "First. The guard signs the long list. Then he goes.") == ""
    assert P.first_defect(None, "The guard signs it.", None, None) == ""


def test_suffix_automaton_against_brute_force():
    import random

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(2))
        got = list(P.SuffixAutomaton(a).matches(b))
        want = [max((n for n in range(i + 2) if b[i + 1 - n : i + 1] in a), default=0) for i in range(len(b))]
        assert got == want


def test_table(spark):
    rows = [(1, Q, "The guard signs the book every evening.", None, None, "old"), (1, Q, "The guard signs the book every evening.", None, None, "old"), (2, None, None, None, None, "x"), (3, Q, "x" * 100_000 + " ends.", None, None, None)]
    rows += [(10 + i, Q, f"Clause {i} of it holds until the end of every evening.", None, None, None) for i in range(8)] + [(30, Q, "The guard goes home every evening", None, None, None), (31, Q, "The guard goes home and then he", None, None, None)]
    df = spark.createDataFrame(rows, "result_no long, question string, answer string, expected_behavior string, expected_answer string, defect string")
    got = P.flag_pairs(df)
    found = {r["result_no"]: r["defect"] for r in got.collect()}
    assert got.count() == len(rows)
    assert found == {1: None, 2: "empty", 3: None, **{10 + i: None for i in range(8)}, 30: None, 31: "truncated"}
    assert P.flag_pairs(df.limit(0)).count() == 0
