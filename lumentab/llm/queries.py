"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.catalog import Catalog
from ..session import table
from . import langid, lookalike, mixing, neardup, oracles, packing, pairs, scannoise, setsim, splitting

llm = Catalog()


@llm.query()
def p1_found(spark, d):
    return pairs.flag_pairs(table(spark, d, "results")).where("defect is not null").select("result_no", "defect").distinct()


@llm.query(oracles.oversized())
def p2_found(spark, d):
    made = splitting.split_oversized(table(spark, d, "chunks"), table(spark, d, "split_limits"))
    return made.where("piece_no = 1").select("chunk_id", "boundary").distinct()


@llm.query()
def p2_pieces(spark, d):
    """All pieces of all chunks, those within their limit whole."""
    return splitting.split_oversized(table(spark, d, "chunks"), table(spark, d, "split_limits"), only_oversized=False)


def _sets(spark, d):
    nodes, edges = table(spark, d, "graph_nodes"), table(spark, d, "graph_edges")
    parts = [setsim.set_records(nodes, "node_id", "entities", 5), setsim.set_records(nodes, "node_id", "keyphrases", 5), setsim.set_records(edges, "edge_id", "shared", 5)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@llm.query(oracles.similar_sets())
def p3_found(spark, d):
    return setsim.similar_pairs(_sets(spark, d), 0.6)


@llm.query(oracles.set_classes())
def p3_classes(spark, d):
    """Pairs of distinct sets by the least keys of their records, copies not expanded; p3_members has the records of each."""
    return setsim.similar_representatives(_sets(spark, d), 0.6)


@llm.query(oracles.set_members())
def p3_members(spark, d):
    """Every record with the least key of those that have its set."""
    return setsim.class_members(_sets(spark, d))


@llm.query(oracles.sets_between())
def p3_between(spark, d):
    """Between two tables: the entities of nodes and the values shared by edges."""
    nodes, edges = table(spark, d, "graph_nodes"), table(spark, d, "graph_edges")
    return setsim.similar_between(setsim.set_records(nodes, "node_id", "entities", 5, "terms"), setsim.set_records(edges, "edge_id", "shared", 5, "terms"), 0.6)


@llm.query(oracles.near_duplicates())
def p4_found(spark, d):
    return neardup.near_duplicate_pairs(table(spark, d, "results")).toDF("result_a", "result_b")


@llm.query(oracles.near_duplicate_groups())
def p4_groups(spark, d):
    """Each record with its class and the number of other classes linked to it."""
    return neardup.near_duplicate_groups(table(spark, d, "results"))


def _scanned(spark, d, repaired):
    return scannoise.scanned(table(spark, d, "text_lines"), table(spark, d, "chunks"), repaired)


@llm.query()
def p5_found(spark, d):
    rows = _scanned(spark, d, False).select(F.col("kind").alias("record_kind"), F.explode("noise").alias("n"))
    return rows.select("record_kind", F.col("n.key").alias("record_key"), "n.noise").distinct()


@llm.query()
def p5_paragraphs(spark, d):
    """The repaired text of every page and chunk, paragraph by paragraph; one that continues goes on in the first of the next page."""
    rows = _scanned(spark, d, True).select("kind", "unit", "file", "page", F.size("paragraphs").alias("n"), "continues", F.posexplode("paragraphs").alias("paragraph_no", "text"))
    rows = rows.withColumn("paragraph_no", F.col("paragraph_no") + 1)
    return rows.select("kind", "unit", "file", "page", "paragraph_no", "text", (F.col("continues") & (F.col("paragraph_no") == F.col("n"))).alias("continues"))


@llm.query(oracles.lookalike_quotes())
def p6_found(spark, d):
    return lookalike.lookalike_quotes(table(spark, d, "evidence_quotes"), table(spark, d, "chunks"))


@llm.query()
def p6_folded(spark, d):
    """Chunks and quotes in one form."""
    chunks = lookalike.folded(table(spark, d, "chunks").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("key"), "text"), "text")
    quotes = lookalike.folded(table(spark, d, "evidence_quotes").select(F.lit("quote").alias("kind"), F.col("quote_id").cast("string").alias("key"), F.col("quote").alias("text")), "text")
    return chunks.unionByName(quotes).distinct()


@llm.query()
def p8_containers(spark, d):
    """Every text's place: container, piece and tokens, for each capacity."""
    return packing.fill_containers(packing.sized(table(spark, d, "documents")), table(spark, d, "pack_limits"))


@llm.query()
def p8_fill(spark, d):
    """Containers and unused share for each capacity."""
    return packing.fill_report(p8_containers(spark, d))


def _mix(spark, d):
    targets = table(spark, d, "mix_targets")
    pool = mixing.text_pool(table(spark, d, "documents"), targets)
    return mixing.mix_sources(pool, targets), pool, targets


@llm.query()
def p9_mixture(spark, d):
    return _mix(spark, d)[0].withColumnRenamed("key", "doc_id")


@llm.query()
def p9_shares(spark, d):
    """The share of each source in the mixture beside its target."""
    return mixing.mix_report(*_mix(spark, d))


@llm.query()
def p10_found(spark, d):
    return langid.mislabelled(langid.document_languages(langid.language_segments(table(spark, d, "documents"))))


@llm.query()
def p10_segments(spark, d):
    """Every segment of every text with its language and a confidence."""
    return langid.language_segments(table(spark, d, "documents"))
