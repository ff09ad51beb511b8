import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lumentab import cli, models
from lumentab.operators import incremental, retrieval, review
from lumentab.plans.fixtures import eval_records
from lumentab.sources import corpus, manifest, records

SF = "/root/testdata/sf0.001"


def docx(*paragraphs: str) -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}{table}</w:body></w:document>')
    return out.getvalue()


def test_corpus_and_cli(spark, tmp_path):
    root = tmp_path / "docs"
    (root / ".hidden").mkdir(parents=True)
    (root / "a.md").write_text("lead <!-- page: 1 -->\n# One\ntext <!-- page: 2 -->\nmore", encoding="utf-8")
    (root / "b.docx").write_bytes(docx("first", "second"))
    (root / "c.docx").write_bytes(b"broken")
    (root / "d.json").write_text('{"k": "ערך"}', encoding="utf-8")
    (root / ".hidden" / "e.txt").write_text("x")
    (root / "f.exe").write_text("x")
    rows = {(r["file"], r["section_no"]): r for r in corpus.corpus_sections(corpus.corpus_files(spark, str(root))).collect()}
    assert {k[0] for k in rows} == {"a.md", "b.docx", "c.docx", "d.json"}
    assert rows[("a.md", 2)]["location"] == "page 2" and rows[("b.docx", 1)]["text"] == "first\n\nsecond\n\na | b"
    assert rows[("c.docx", 0)]["error"] and "ערך" in rows[("d.json", 1)]["text"]
    got = cli.main(["chunk", str(root), str(tmp_path / "out")], spark)
    assert got["unreadable"] == 1 and got["chunks"] >= 4
    assert json.loads((tmp_path / "out" / "manifest.json").read_text())["status"] == "completed"


def test_report(spark, tmp_path):
    eval_records(spark, SF, "A").write.parquet(str(tmp_path / "a"))
    eval_records(spark, SF, "B").write.parquet(str(tmp_path / "b"))
    cli.main(["report", str(tmp_path / "b"), str(tmp_path / "r"), "--previous", str(tmp_path / "a")], spark)
    summary = json.loads((tmp_path / "r" / "summary.json").read_text())
    assert {"summary", "topics", "comparison", "transitions"} <= set(summary)
    assert "<table>" in (tmp_path / "r" / "report.html").read_text()


def test_formulas_round_trip(spark, tmp_path):
    rows = [("1", "=SUM(A1)", "approved"), ("2", "'=x", "draft"), ("3", 'a "b", c\nd', " Approved "), ("4", "-5", None)]
    df = spark.createDataFrame(rows, "id string, question string, review_status string")
    records.write_pair(df, str(tmp_path), "set")
    back = records.read_set(spark, str(tmp_path / "set.csv"))
    assert sorted(tuple(r)[:2] for r in back.collect()) == sorted(r[:2] for r in rows)
    assert records.read_set(spark, str(tmp_path / "set.jsonl"), approved_only=True).count() == 2


def test_saved_answers(spark, tmp_path):
    p = tmp_path / "answers.csv"
    p.write_text("שאלה,Gold Answer,bot_response\nq1,a1,hello\n,a2,x\nq3,a3,\n", encoding="utf-8")
    got = {r["question"]: (r["reason"], r["import_error"]) for r in records.saved_answers(spark, str(p)).collect()}
    assert got["q1"] == (None, "") and got[None][0] and got["q3"][1].startswith("Premade result contains")
    with pytest.raises(ValueError):
        records.saved_answers(spark, str(tmp_path / "x.pdf"))
    lines = [f'{{"question": "q{i}", "expected": "a", "answer": "b", "id": "{i % 700}"}}' for i in range(900)]
    (tmp_path / "many.jsonl").write_text("\n".join(lines), encoding="utf-8")
    many = {r["question"]: (r["row_no"], r["reason"]) for r in records.saved_answers(spark, str(tmp_path / "many.jsonl")).collect()}
    assert many["q0"] == (1, None) and many["q699"] == (700, None) and many["q700"] == (701, "duplicate external question ID") and len(many) == 900
    with pytest.raises(ValueError, match="701: duplicate.*and 190 more"):
        records.saved_answers(spark, str(tmp_path / "many.jsonl"), strict=True)


def test_sources_column(spark):
    full = '[{"source_id":"a","file":"f","location":"p 1","excerpt":"x"},{"source_id":"b","file":"g"}]'
    rows = [(full, "a | b", "f | g", "p 1 | ", "x | "), (None, "a | b", "f | g", "", None), (full, "a | z", "f | g", "p 1 | ", "x | "), ("{}", "", "", "", ""), ("", "", "", "", "")]
    df = spark.createDataFrame(rows, "sources_json string, source_ids string, source_files string, source_locations string, source_excerpts string")
    got = records.decode_sources(df).collect()
    assert [r["conflict"] for r in got] == [False, False, True, True, False]
    assert [tuple(x) for x in got[1]["sources"]] == [("a", "f", "", ""), ("b", "g", "", "")] and got[4]["sources"] == []
    assert records.decode_sources(df.select("sources_json", "source_ids")).first()["conflict"] is False


def test_evaluation_table(spark, tmp_path):
    from lumentab.operators.outcomes import classified

    rows = classified(eval_records(spark, SF, "A")).where("question_id < 80").withColumn("answer", F.lit("=1+1")).withColumn("vote_outcomes", F.array(F.lit("a"), F.lit("b")))
    records.write_evaluations(rows, str(tmp_path))
    table = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "evaluation_details.csv"))
    assert len(table.columns) == 36 and table.count() == rows.count() == spark.read.json(str(tmp_path / "evaluation_details.jsonl")).count()
    assert {r[0] for r in table.select("`תשובת הצ׳אטבוט`").distinct().collect()} == {"'=1+1"}
    bad = table.where("`קוד סיווג` = 'chatbot_error'").first()
    assert bad["סיווג"] == "שגיאת מערכת בצ׳אטבוט" and bad["פרטים נדרשים"] is None and bad["פירוט טענות הייחוס"] == "[]"
    assert records.evaluation_rows(rows.limit(0)).count() == 0


def test_models(spark):
    assert models.retry_delay(3, jitter=lambda: 0) == 8 and models.retry_delay(9, "7") == 7
    assert models.status_category(429) == "rate_limited" and models.may_retry(503) and not models.may_retry(404)

    class Merging:
        calls = 0

        def embed(self, texts):
            self.calls += 1
            return [[1.0]] if len(texts) > 1 else [[float(len(texts[0]))]]

    assert models.embed_in_batches(Merging(), ["a", "bb", "ccc"], 2) == [[1.0], [2.0], [3.0]]
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id long, p string")
    schema = {"properties": {"a": {"type": "integer"}}}
    cache = spark.createDataFrame([], "digest string, response string")
    rows, new = models.cached_calls(df, "id", "p", schema, cache)
    assert new.count() == 2 and rows.where("response IS NULL").count() == 0
    again, more = models.cached_calls(df, "id", "p", schema, spark.createDataFrame(new.collect(), new.schema))
    assert more.count() == 0 and again.count() == 3


def test_manifest_hides_secrets(tmp_path):
    with pytest.raises(RuntimeError), manifest.RunManifest(str(tmp_path / "r" / "manifest.json"), "x", {"api_key": "s", "n": {"token": 1, "k": 2}}):
        raise RuntimeError("no")
    data = json.loads((tmp_path / "r" / "manifest.json").read_text())
    assert data["status"] == "failed" and data["settings"] == {"api_key": "***", "n": {"token": "***", "k": 2}}


def test_journals(spark):
    lines = spark.createDataFrame([(1, '{"a":1}'), (2, '{"a":')], "line_no int, text string")
    assert incremental.torn_tail(lines).count() == 1
    bad = spark.createDataFrame([(1, "{"), (2, '{"a":1}')], "line_no int, text string")
    with pytest.raises(Exception, match="bad journal line"):
        incremental.torn_tail(bad).collect()


def test_greedy_dedup(spark):
    import random

    rng = random.Random(4)
    pairs = sorted({(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(60)) if a < b})
    kept: list[int] = []
    for x in range(40):
        if not any((a, x) in pairs for a in kept):
            kept.append(x)
    got = retrieval.greedy_kept(spark.createDataFrame([(i,) for i in range(40)], "k long"), spark.createDataFrame(pairs, "a long, b long"), "k")
    assert sorted(r[0] for r in got.collect()) == kept


def test_stream_resumes(spark, tmp_path):
    from lumentab.streaming.events import judged_stream

    src = str(tmp_path / "in")
    spark.range(5).write.parquet(src)
    run = lambda: judged_stream(spark, src, "id long", lambda df: df.selectExpr("id", "id * 2 AS twice"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    spark.range(5, 8).write.mode("append").parquet(src)
    run()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(8))


def test_review_helpers(spark):
    q = spark.createDataFrame([("a", None, "approved"), ("b", "c", " APPROVED"), ("c", None, "draft"), ("d", None, "draft")], "id string, parent_question_id string, review_status string")
    assert sorted(r["id"] for r in review.approved_with_parents(q).collect()) == ["a", "b", "c"]
