"""Graph and planning queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph, planning
from ..session import table
from .catalog import core

KEYS = r"SELECT DISTINCT node_id AS id, trim(regexp_replace(lower(v), '\s+', ' ', 'g')) AS k FROM (SELECT node_id, unnest({0}) AS v FROM graph_nodes WHERE node_id IS NOT NULL) WHERE v IS NOT NULL AND trim(regexp_replace(v, '\s+', ' ', 'g')) <> ''"
EDGES = f"k AS ({KEYS.format('entities')}), ed AS (SELECT a.id AS src, b.id AS dst, count(*) AS weight FROM k a JOIN k b ON a.k = b.k AND a.id < b.id GROUP BY 1, 2 HAVING count(*) >= 2)"


def _edges(spark, d):
    return graph.shared_key_edges(graph.nodes_with_keys(table(spark, d, "graph_nodes"), "entities"))


@core.query(f"WITH {EDGES} SELECT * FROM ed")
def shared_key_edges(spark, d):
    return _edges(spark, d)


@core.query(
    f"""WITH k AS ({KEYS.format('keyphrases')}), n AS (SELECT id, count(*) AS n FROM k GROUP BY 1), p AS (SELECT a.id AS src, b.id AS dst, count(*) AS c FROM k a JOIN k b ON a.k = b.k AND a.id < b.id GROUP BY 1, 2)
    SELECT src, dst, round_even(c::double / (x.n + y.n - c), 4) AS weight FROM p JOIN n x ON x.id = src JOIN n y ON y.id = dst WHERE c::double / (x.n + y.n - c) >= 0.5 - 1e-9"""
)
def keyphrase_jaccard_edges(spark, d):
    return graph.jaccard_edges(graph.nodes_with_keys(table(spark, d, "graph_nodes"), "keyphrases"), 0.5)


@core.query("SELECT * FROM (SELECT lag(chunk_id) OVER (PARTITION BY file ORDER BY chunk_no, chunk_id) AS src, chunk_id AS dst, 1.0::double AS weight FROM (SELECT DISTINCT file, chunk_no, chunk_id FROM chunks WHERE chunk_id IS NOT NULL)) WHERE src IS NOT NULL")
def spine_edges(spark, d):
    return graph.spine_edges(table(spark, d, "chunks"))


@core.query(
    f"""WITH RECURSIVE {EDGES}, eb AS (SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed), n AS (SELECT DISTINCT node_id AS id FROM graph_nodes WHERE node_id IS NOT NULL),
    r AS (SELECT id, id AS root FROM n UNION SELECT b, root FROM r JOIN eb ON r.id = a) SELECT id, min(root) AS component FROM r GROUP BY 1"""
)
def components(spark, d):
    """Connected components under edges of at least two shared entities."""
    nodes = table(spark, d, "graph_nodes").where("node_id IS NOT NULL").select(F.col("node_id").alias("id"))
    return graph.components(nodes, _edges(spark, d))


CHUNK_KEYS = KEYS.replace("node_id", "chunk_id")


@core.query(
    f"""WITH e AS ({CHUNK_KEYS.format('entities')}), p AS ({CHUNK_KEYS.format('keyphrases')}), n AS (SELECT id, count(*) AS n FROM p GROUP BY 1), c AS (SELECT a.id AS src, b.id AS dst, count(*) AS c FROM p a JOIN p b ON a.k = b.k AND a.id < b.id GROUP BY 1, 2)
    SELECT a.id AS src, b.id AS dst, 'shared_entity' AS type, count(*)::double AS weight FROM e a JOIN e b ON a.k = b.k AND a.id < b.id GROUP BY 1, 2 HAVING count(*) >= 2
    UNION ALL SELECT src, dst, 'keyphrase_overlap', round_even(c::double / (x.n + y.n - c), 4) FROM c JOIN n x ON x.id = src JOIN n y ON y.id = dst WHERE c::double / (x.n + y.n - c) >= 0.3 - 1e-9
    UNION ALL SELECT * FROM (SELECT lag(chunk_id) OVER (PARTITION BY file ORDER BY chunk_no, chunk_id) AS src, chunk_id AS dst, 'same_document', 1.0::double FROM (SELECT DISTINCT file, chunk_no, chunk_id FROM chunks WHERE chunk_id IS NOT NULL)) WHERE src IS NOT NULL"""
)
def built_edges(spark, d):
    """The three kinds of edges together."""
    return graph.built_edges(table(spark, d, "graph_nodes"), table(spark, d, "chunks"))


def _strong(spark, d):
    """The edges of built_edges that have the weight of two which clustering asks for."""
    return graph.built_edges(table(spark, d, "graph_nodes"), table(spark, d, "chunks"), least=2.0)


@core.query()
def entity_clusters(spark, d):
    """Topics of at most eighty nodes by shared entities; checked on fixtures against the rule for one graph."""
    nodes = table(spark, d, "graph_nodes").where("chunk_id IS NOT NULL").select(F.col("chunk_id").alias("id"))
    return graph.entity_clusters(nodes, _strong(spark, d), 40, 80)


@core.query()
def theme_clusters(spark, d):
    """Topics by theme, at most eighty nodes each; checked on fixtures."""
    nodes = table(spark, d, "graph_nodes").where("chunk_id IS NOT NULL").select(F.col("chunk_id").alias("id"), "theme")
    return graph.theme_clusters(nodes, _strong(spark, d), 40, 80)


@core.query(
    r"""WITH t AS (SELECT CASE WHEN trim(coalesce(theme, '')) <> '' THEN lower(trim(regexp_replace(theme, '\s+', ' ', 'g'))) END AS theme, chunk_id FROM graph_nodes WHERE chunk_id IS NOT NULL),
    m AS (SELECT chunk_id, min(theme) AS theme FROM t GROUP BY 1), s AS (SELECT theme, count(*) AS size, min(chunk_id) AS f FROM m WHERE theme IS NOT NULL GROUP BY 1), n AS (SELECT theme, size, row_number() OVER (ORDER BY size DESC, f) AS topic FROM s)
    SELECT chunk_id AS id, topic FROM m JOIN n USING (theme)"""
)
def cap_topics(spark, d):
    """Themes numbered by size, as many as there are."""
    name = F.lower(F.trim(F.regexp_replace("theme", r"\s+", " ")))
    rows = table(spark, d, "graph_nodes").where("chunk_id IS NOT NULL").groupBy(F.col("chunk_id").alias("id")).agg(F.min(F.when(F.trim(F.coalesce("theme", F.lit(""))) != "", name)).alias("origin"))
    return graph.capped_topics(rows.where("origin IS NOT NULL").withColumn("part", F.lit(None).cast("string")), 1000)


@core.query(
    """WITH m AS (SELECT file AS topic, theme, min(node_id) AS pos, count(*) AS n FROM (SELECT DISTINCT node_id, file, theme FROM graph_nodes WHERE node_id IS NOT NULL AND file IS NOT NULL) WHERE trim(coalesce(theme, '')) <> '' GROUP BY 1, 2)
    SELECT topic, theme FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, pos) AS r FROM m) WHERE r = 1"""
)
def dominant_themes(spark, d):
    """The most frequent theme of each file, the first one on a tie."""
    rows = table(spark, d, "graph_nodes").where("node_id IS NOT NULL AND file IS NOT NULL").select(F.col("file").alias("topic"), F.col("node_id").alias("pos"), "theme").distinct()
    return graph.dominant_theme(rows)


def _themes(spark, d):
    rows = table(spark, d, "graph_nodes").where("node_id IS NOT NULL")
    theme = F.trim("theme")
    return rows.withColumn("cluster", F.when(F.coalesce(theme, F.lit("")) == "", "other").otherwise(theme)).dropDuplicates(["node_id", "cluster"])


@core.query(
    """WITH m AS (SELECT CASE WHEN coalesce(trim(theme), '') = '' THEN 'other' ELSE trim(theme) END AS cluster, node_id FROM graph_nodes WHERE node_id IS NOT NULL), n AS (SELECT cluster, count(DISTINCT node_id) AS size FROM m GROUP BY 1)
    SELECT cluster, size, CASE WHEN size / t >= 0.30 THEN 5 WHEN size / t >= 0.18 THEN 4 WHEN size / t >= 0.09 THEN 3 WHEN size / t >= 0.03 THEN 2 ELSE 1 END AS importance FROM n, (SELECT sum(size)::double AS t FROM n)"""
)
def cluster_importance(spark, d):
    return graph.cluster_sizes(_themes(spark, d).select("cluster", F.col("node_id").alias("id")))


@core.query(
    r"""WITH m AS (SELECT DISTINCT CASE WHEN coalesce(trim(theme), '') = '' THEN 'other' ELSE trim(theme) END AS cluster, node_id AS id, entities FROM graph_nodes WHERE node_id IS NOT NULL),
    v AS (SELECT cluster, id, generate_subscripts(entities, 1) - 1 AS pos, unnest(entities) AS name FROM m), c AS (SELECT *, trim(regexp_replace(lower(name), '\s+', ' ', 'g')) AS canonical FROM v WHERE name IS NOT NULL),
    g AS (SELECT cluster, canonical, count(*) AS n, min({'i': id, 'p': pos, 'x': name}) AS f FROM c WHERE canonical <> '' GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, f.i, f.p, canonical) AS place FROM g) SELECT cluster, place, canonical, f.x AS display, n FROM r WHERE place <= 8"""
)
def cluster_signature(spark, d):
    rows = _themes(spark, d).select("cluster", F.col("node_id").alias("id"), F.posexplode("entities").alias("pos", "name"))
    return graph.cluster_signature(rows)


@core.query()
def evidence_walk(spark, d):
    """Up to eight nodes of each theme from its first three nodes along the heaviest edges; checked against the walk on fixtures."""
    nth = F.row_number().over(Window.partitionBy("cluster").orderBy("node_id"))
    seeds = _themes(spark, d).withColumn("pos", nth).where("pos <= 3").select(F.col("cluster").alias("topic"), "pos", F.col("node_id").alias("id"))
    return graph.evidence_walk(seeds, _edges(spark, d))


@core.query(
    """WITH w AS (SELECT source AS name, count(*)::double AS w FROM documents WHERE source IS NOT NULL GROUP BY 1), s AS (SELECT sum(w) AS a, count(*) AS n FROM w), r AS (SELECT name, w / a * (500 - n) AS raw FROM w, s),
    b AS (SELECT name, floor(raw + 1e-9) AS base, round(raw - floor(raw + 1e-9), 9) AS part FROM r), l AS (SELECT 500 - (SELECT n FROM s) - sum(base) AS left_over FROM b)
    SELECT name, (1 + base + (row_number() OVER (ORDER BY part DESC, name) <= left_over)::int)::bigint AS quota FROM b, l"""
)
def largest_remainder(spark, d):
    """500 questions over the sources, at least one each."""
    w = table(spark, d, "documents").where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("weight"))
    return planning.largest_remainder(w, 500, "source", minimum=1)


@core.query(
    """WITH w AS (SELECT source AS name, count(*)::double AS w, row_number() OVER (ORDER BY count(*) DESC, source) AS place FROM documents WHERE source IS NOT NULL GROUP BY 1),
    q AS (SELECT name, place, k, w / (k + 1) AS q FROM w, generate_series(1, 39) g(k)), r AS (SELECT *, row_number() OVER (ORDER BY q DESC, place, k) AS r FROM q), t AS (SELECT count(*) AS n FROM w)
    SELECT w.name, (1 + coalesce(m.c, 0))::bigint AS quota FROM w LEFT JOIN (SELECT name, count(*) AS c FROM r, t WHERE r <= 300 - n GROUP BY 1) m ON w.name = m.name"""
)
def dhondt_quota(spark, d):
    """300 seats by divisors, at least one and at most forty each."""
    w = table(spark, d, "documents").where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("weight"))
    return planning.divisor_quota(w, 300, 40, "source")


@core.query(
    """WITH c AS (SELECT DISTINCT file, chunk_no, chunk_id FROM chunks), n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY chunk_no, chunk_id) - 1 AS i, count(*) OVER (PARTITION BY file) AS n FROM c),
    k AS (SELECT *, greatest(1, ceil(n / 4.0))::bigint AS k FROM n), b AS (SELECT *, n // k AS s, n % k AS e FROM k)
    SELECT chunk_id, CASE WHEN i < e * (s + 1) THEN i // (s + 1) ELSE e + (i - e * (s + 1)) // greatest(s, 1) END + 1 AS window_no FROM b"""
)
def window_split(spark, d):
    rows = table(spark, d, "chunks").select("file", "chunk_no", "chunk_id").distinct()
    return planning.balanced_windows(rows, "file", ["chunk_no", "chunk_id"], 4).select("chunk_id", "window_no")


_WINDOWS = """c AS (SELECT DISTINCT file, chunk_no, chunk_id FROM chunks), n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY chunk_no, chunk_id) - 1 AS i, count(*) OVER (PARTITION BY file) AS n FROM c),
    k AS (SELECT *, least(n, greatest(1, ceil(n / 4.0), ceil((2 * n + 3) / 8.0)))::bigint AS k FROM n), b AS (SELECT *, n // k AS s, n % k AS e FROM k), w AS (SELECT file, n, chunk_id, CASE WHEN i < e * (s + 1) THEN i // (s + 1) ELSE e + (i - e * (s + 1)) // greatest(s, 1) END + 1 AS window_no FROM b)"""


@core.query(
    f"""WITH {_WINDOWS}, t AS (SELECT chunk_id, max(length(text)) AS size FROM chunks GROUP BY 1), g AS (SELECT w.file, window_no, sum(coalesce(size, 0))::double AS weight, any_value(2 * n + 3) AS wanted FROM w JOIN t ON w.chunk_id IS NOT DISTINCT FROM t.chunk_id GROUP BY 1, 2),
    r AS (SELECT *, CASE WHEN sum(weight) OVER (PARTITION BY file) > 0 THEN wanted * weight / sum(weight) OVER (PARTITION BY file) ELSE 0 END AS raw FROM g), f AS (SELECT *, floor(raw + 1e-9) AS base FROM r),
    l AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY round(raw - base, 9) DESC, window_no) AS place, CASE WHEN sum(raw) OVER (PARTITION BY file) > 0 THEN wanted - sum(base) OVER (PARTITION BY file) ELSE 0 END AS left_over FROM f)
    SELECT file, window_no, (base + (place <= left_over)::int)::bigint AS goal FROM l"""
)
def window_goals(spark, d):
    """Two questions for each chunk of a file and three more, over its windows by the length of their texts."""
    rows = table(spark, d, "chunks").groupBy("file", "chunk_no", "chunk_id").agg(F.max(F.length("text")).alias("size"))
    n = rows.groupBy("file").agg((2 * F.count("*") + 3).alias("wanted"))
    windows = planning.balanced_windows(rows.join(n, rows["file"].eqNullSafe(n["file"])).drop(n["file"]), "file", ["chunk_no", "chunk_id"], 4, "wanted")
    g = windows.groupBy("file", "window_no").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("weight"), F.max("wanted").alias("wanted"))
    return planning.window_goals(g, "file", "weight", "wanted")


@core.query(
    """WITH w AS (SELECT question_type AS name, count(*) AS weight, (SELECT count(DISTINCT file) FROM chunks) AS files FROM results WHERE question_type IN ('basic_knowledge', 'topic_integration', 'document_wide', 'cross_document') GROUP BY 1),
    f AS (SELECT name, weight::double AS w FROM w WHERE name <> 'cross_document' OR files >= 2), s AS (SELECT sum(w) AS a FROM f), r AS (SELECT name, w / a * 40 AS raw FROM f, s),
    b AS (SELECT name, floor(raw + 1e-9) AS base, round(raw - floor(raw + 1e-9), 9) AS part FROM r), l AS (SELECT 40 - sum(base) AS left_over FROM b)
    SELECT name, (base + (row_number() OVER (ORDER BY part DESC, name) <= left_over)::int)::bigint AS quota FROM b, l"""
)
def type_targets(spark, d):
    """40 questions over the feasible types; a question across documents needs two files."""
    files = table(spark, d, "chunks").agg(F.countDistinct("file").alias("files"))
    w = table(spark, d, "results").where("question_type IN ('basic_knowledge', 'topic_integration', 'document_wide', 'cross_document')").groupBy("question_type").agg(F.count("*").alias("weight"))
    feasible = w.crossJoin(F.broadcast(files)).where("question_type <> 'cross_document' OR files >= 2")
    return planning.largest_remainder(feasible, 40, "question_type")


def _units_sql():
    from .text_queries import FLAT, RESTORE, W, units_sql

    return rf"""u AS (SELECT source AS topic, doc_id, text, unnest({units_sql()}) AS x FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
    ww AS (SELECT topic, doc_id, text, regexp_extract_all(replace(lower({RESTORE.format('x')}), 'ß', 'ss'), '{W}') AS w FROM u), un AS (SELECT topic, doc_id, CASE WHEN {FLAT.format('any_value(text)')} = '' THEN 0 ELSE greatest(1, count(DISTINCT CASE WHEN len(w) >= 4 THEN array_to_string(w, ' ') END)) END AS units FROM ww GROUP BY 1, 2)"""


@core.query(
    f"""WITH {_units_sql()}, g AS (SELECT topic, count(*) AS chunks, sum(units)::bigint AS units, coalesce(sum(greatest(1, round_even(units * 0.35::double / 3.2::double, 0)::bigint)) FILTER (units > 0), 0)::bigint AS content FROM un GROUP BY 1),
    c AS (SELECT *, greatest(1, floor(units * 0.8::double / 3.2::double)::bigint) AS ceiling FROM g) SELECT *, greatest(content, least(25, ceiling)) AS canonical,
    CASE WHEN content >= greatest(content, least(25, ceiling)) THEN 'content' WHEN ceiling < 25 THEN 'precision_capped' ELSE 'precision' END AS reason FROM c"""
)
def plan_topics(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL AND source IS NOT NULL")
    return planning.plan_topics(docs.select(F.col("source").alias("topic"), X.information_units(F.col("text")).cast("bigint").alias("units")))


@core.query(f"WITH {_units_sql()}, r AS (SELECT units, row_number() OVER (ORDER BY units) - 1 AS i, count(*) OVER () AS n FROM un) SELECT units AS median FROM r WHERE i = n // 2")
def median_units(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL AND source IS NOT NULL")
    return planning.upper_median(docs.select(X.information_units(F.col("text")).cast("bigint").alias("units")), "units")


@core.query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (ORDER BY turn, source) AS n FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('7:' || doc_id), doc_id) AS turn FROM documents WHERE source IS NOT NULL)) WHERE n <= 100")
def seeded_order(spark, d):
    """The first hundred documents when the sources take turns."""
    from .text_queries import round_robin

    return round_robin(spark, d).orderBy("turn", "source").limit(100).select("source", "doc_id")
