"""Set upkeep, incremental and event queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import incremental, review
from ..session import table
from ..streaming import events as streams
from .catalog import core



def _canonical(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_orderpriority AS question", "cast(o_custkey as string) AS expected_answer", "CASE WHEN o_orderkey % 3 = 0 THEN 'approved' ELSE 'draft' END AS review_status")


def _edited(spark, d):
    rows = _canonical(spark, d).where("id % 11 <> 0")
    edits = rows.withColumn("question", F.when(F.col("id") % 7 == 0, F.concat("question", F.lit(" (edited)"))).otherwise(F.col("question"))).withColumn("id", F.when(F.col("id") % 23 == 0, F.col("id") + 100_000_000).otherwise(F.col("id")))
    return edits.unionByName(rows.where("id % 29 = 0")).unionByName(rows.where("id % 31 = 0").withColumn("id", F.lit(None).cast("bigint")))


@core.query(
    """WITH c AS (SELECT o_orderkey AS id, o_orderpriority AS question, o_custkey::varchar AS expected_answer, CASE WHEN o_orderkey % 3 = 0 THEN 'approved' ELSE 'draft' END AS review_status FROM orders), r AS (SELECT * FROM c WHERE id % 11 <> 0),
    e AS (SELECT CASE WHEN id % 23 = 0 THEN id + 100000000 ELSE id END AS id, CASE WHEN id % 7 = 0 THEN question || ' (edited)' ELSE question END AS question, expected_answer, review_status FROM r UNION ALL SELECT * FROM r WHERE id % 29 = 0 UNION ALL SELECT NULL, question, expected_answer, review_status FROM r WHERE id % 31 = 0),
    n AS (SELECT *, count(*) OVER (PARTITION BY id) AS t, row_number() OVER (PARTITION BY id ORDER BY question, expected_answer, review_status) AS k FROM e WHERE id IS NOT NULL),
    j AS (SELECT coalesce(c.id, n.id) AS id, c.question AS cq, c.expected_answer AS ca, c.review_status AS cs, n.question AS nq, n.expected_answer AS na, n.review_status AS ns,
    CASE WHEN c.id IS NULL THEN 'unknown_id' WHEN n.t > 1 THEN 'duplicate_id' WHEN n.id IS NULL THEN 'deleted' WHEN c.question IS DISTINCT FROM n.question OR c.expected_answer IS DISTINCT FROM n.expected_answer OR c.review_status IS DISTINCT FROM n.review_status THEN 'edited' ELSE 'unchanged' END AS status
    FROM c FULL JOIN (SELECT * FROM n WHERE k = 1) n ON c.id = n.id)
    SELECT id, CASE WHEN status IN ('edited', 'unknown_id') THEN nq ELSE cq END AS question, CASE WHEN status IN ('edited', 'unknown_id') THEN na ELSE ca END AS expected_answer,
    CASE WHEN status = 'edited' AND ns = 'approved' AND (cq IS DISTINCT FROM nq OR ca IS DISTINCT FROM na) THEN 'needs_reground' WHEN status IN ('edited', 'unknown_id') THEN ns ELSE cs END AS review_status, status FROM j
    UNION ALL SELECT id, question, expected_answer, review_status, 'added' FROM e WHERE id IS NULL"""
)
def review_merge(spark, d):
    return review.merge_review(_canonical(spark, d), _edited(spark, d))


@core.query(
    """WITH a AS (SELECT o_orderkey AS id, 'first' AS origin FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS id, 'second' AS origin FROM orders WHERE o_orderkey % 5 <> 0) SELECT coalesce(a.id, b.id) AS id, coalesce(a.origin, b.origin) AS origin FROM a FULL JOIN b ON a.id = b.id"""
)
def set_append(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return review.append_sets(o.where("id % 3 <> 0").withColumn("origin", F.lit("first")), o.where("id % 5 <> 0").withColumn("origin", F.lit("second")), "id")


@core.query("SELECT l_orderkey, l_linenumber, coalesce('C' || o.o_custkey, l_orderkey::varchar) AS owner FROM lineitem l LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 4 <> 0) o ON l.l_orderkey = o.o_orderkey")
def id_remap(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").cast("string").alias("owner"))
    mapping = table(spark, d, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").cast("string").alias("old"), F.concat(F.lit("C"), "o_custkey").alias("new"))
    return review.remap(lines, "owner", mapping, "old", "new").select("l_orderkey", "l_linenumber", "owner")


@core.query("SELECT doc_id, 'Q' || substr(sha256(coalesce(text, '')), 1, 16) || CASE WHEN row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) > 1 THEN '-' || row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) ELSE '' END AS stable_id FROM documents")
def content_ids(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return review.stable_ids(docs, "Q", F.coalesce("text", F.lit(""))).select("doc_id", "stable_id")


@core.query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'pending' WHEN o_orderkey % 7 = 0 THEN 'changed' WHEN o_orderkey % 11 = 0 THEN 'retry' ELSE 'done' END AS state FROM orders"""
)
def journal_resume(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), incremental.fingerprint(F.col("o_orderkey"), F.col("o_totalprice")).alias("digest"))
    journal = o.where("id % 5 <> 0").select("id", F.when(F.col("id") % 7 == 0, F.lit("another")).otherwise(F.col("digest")).alias("digest"), F.when(F.col("id") % 11 == 0, "judge_error").otherwise("correct_answer").alias("outcome"))
    return incremental.resume(o, journal, "id", retry=("judge_error",))


@core.query("SELECT file FROM (SELECT DISTINCT file FROM chunks) WHERE sha256(file) >= '8'")
def incremental_pending(spark, d):
    files = table(spark, d, "chunks").select("file").distinct()
    return incremental.pending(files, files.where("sha2(file, 256) < '8'"), "file")


@core.query("SELECT l_shipmode AS kind, l_orderkey AS key FROM (SELECT l_returnflag AS l_shipmode, l_orderkey FROM lineitem GROUP BY 1, 2) WHERE l_shipmode = 'N' OR l_orderkey % 3 = 0")
def cache_prune(spark, d):
    cache = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("key")).distinct()
    return incremental.pruned(cache, cache.where("kind <> 'N' AND key % 3 = 0"), "key")


@core.query(
    """WITH e AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth FROM events WHERE event_id % 2 = 0), s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth FROM events WHERE event_id % 2 = 1)
    SELECT e.event_id, e.event_type, e.nth, s.value AS response FROM e LEFT JOIN s ON e.event_type = s.event_type AND e.nth = s.nth"""
)
def call_replay(spark, d):
    e = table(spark, d, "events")
    calls, stored = e.where("event_id % 2 = 0").select("event_id", "event_type"), e.where("event_id % 2 = 1").select("event_id", "event_type", F.col("value").alias("response"))
    return incremental.replay(calls, stored, "event_type", "event_id").select("event_id", "event_type", F.col("nth").cast("bigint").alias("nth"), "response")


@core.query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    return streams.tumbling_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@core.query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k"""
)
def events_session(spark, d):
    out = streams.session_counts(table(spark, d, "events"), "6 hours")
    return out.withColumn("session_start", F.col("session_start").cast("timestamp_ntz")).withColumn("session_end", F.col("session_end").cast("timestamp_ntz"))


@core.query(
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY result_no, question NULLS FIRST, answer NULLS FIRST, answered_at NULLS FIRST, loaded_at NULLS FIRST) AS n FROM results), f AS (SELECT id AS old, min(n) AS n FROM r WHERE id IS NOT NULL GROUP BY 1)
    SELECT r.result_no, format('Q{:04d}', r.n) AS id, coalesce(format('Q{:04d}', f.n), r.parent_question_id) AS parent_question_id FROM r LEFT JOIN f ON r.parent_question_id = f.old"""
)
def sequential_ids(spark, d):
    """The results numbered anew, with the parents that stand among them."""
    from ..operators import drafts

    rows = table(spark, d, "results").select("result_no", "question", "answer", "answered_at", "loaded_at", "id", "parent_question_id")
    return drafts.sequential_ids(rows, ["result_no", "question", "answer", "answered_at", "loaded_at"]).select("result_no", "id", "parent_question_id")


@core.query(
    r"""WITH h AS (SELECT file, min_by(text, {'n': chunk_no, 'c': chunk_id}) AS text FROM chunks WHERE file IS NOT NULL GROUP BY 1), t AS (SELECT *, trim(regexp_extract(coalesce(text, ''), '(?m)^title:[ \t]*(.*)$', 1), ' ') AS title FROM h)
    SELECT format('D{:02d}', row_number() OVER (ORDER BY file)) AS document_id, file, CASE WHEN title <> '' THEN title ELSE replace(regexp_replace(regexp_extract(file, '([^/]*)$', 1), '(.)\.[^.]*$', '\1'), '-', ' ') END AS title FROM t"""
)
def document_map(spark, d):
    """Documents by number, with their titles."""
    from ..operators import drafts

    return drafts.document_map(table(spark, d, "chunks"))


@core.query(
    """WITH m AS (SELECT DISTINCT source AS topic, doc_id AS id FROM documents WHERE source IS NOT NULL), g AS (SELECT topic, count(*) AS n, sum(('0x' || substr(sha256(id::varchar), 1, 15))::bigint) AS s FROM m GROUP BY 1),
    r AS (SELECT sha256(topic || ':' || n || ':' || s) AS h FROM g) SELECT sha256(count(*) || ':' || sum(('0x' || substr(h, 1, 15))::bigint)) AS fingerprint FROM r"""
)
def topics_fingerprint(spark, d):
    """The identity of the documents' partition into sources."""
    from ..operators import drafts

    return drafts.partition_fingerprint(table(spark, d, "documents").where("source IS NOT NULL").select(F.col("source").alias("topic"), F.col("doc_id").alias("id")))
