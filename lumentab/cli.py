"""Command line: python -m lumentab.cli COMMAND … runs the operators on files."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import statements
from .operators import chunking, graph, planning
from .options import load_options
from .session import get_spark, ship_package
from .sources import corpus, manifest, records, report


def chunk(spark: SparkSession, a: argparse.Namespace) -> dict:
    """A folder of documents to chunks, with the files that couldn't be read."""
    o = load_options(a.config)
    sections = corpus.corpus_sections(corpus.corpus_files(spark, a.source))
    bad = sections.where("error IS NOT NULL").select("file", "error")
    made = chunking.chunk_documents(sections.where("error IS NULL"), size=o.chunk_chars, overlap=o.overlap_chars)
    made.write.mode("overwrite").parquet(f"{a.out}/chunks")
    bad.write.mode("overwrite").json(f"{a.out}/unreadable")
    return {"chunks": spark.read.parquet(f"{a.out}/chunks").count(), "unreadable": bad.count()}


def build_graph(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Nodes (node_id, entities, keyphrases) to edges and components."""
    o = load_options(a.config)
    nodes = spark.read.parquet(a.source)
    edges = graph.shared_key_edges(graph.nodes_with_keys(nodes, "entities")).where(F.col("weight") >= o.min_shared_entities)
    edges.write.mode("overwrite").parquet(f"{a.out}/edges")
    graph.jaccard_edges(graph.nodes_with_keys(nodes, "keyphrases"), o.keyphrase_threshold).write.mode("overwrite").parquet(f"{a.out}/keyphrase_edges")
    graph.components(nodes.select(F.col("node_id").alias("id")).where("id IS NOT NULL"), spark.read.parquet(f"{a.out}/edges")).write.mode("overwrite").parquet(f"{a.out}/components")
    return {"edges": spark.read.parquet(f"{a.out}/edges").count(), "components": spark.read.parquet(f"{a.out}/components").select("component").distinct().count()}


def plan(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Chunks with a topic column to a plan by topic."""
    o = load_options(a.config)
    content = spark.read.parquet(a.source).where("text IS NOT NULL").select("topic", F.size(statements(F.col("text"))).cast("bigint").alias("units"))
    planning.plan_topics(content, o.coverage, o.max_coverage, o.claims_per_question, o.margin).write.mode("overwrite").json(f"{a.out}/plan")
    return planning.set_sizes(int(spark.read.json(f"{a.out}/plan").agg(F.sum("canonical")).first()[0] or 0))


def import_answers(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Saved answers to valid rows and diagnostics."""
    rows = records.saved_answers(spark, a.source)
    rows.where("reason IS NULL").write.mode("overwrite").json(f"{a.out}/answers")
    rows.where("reason IS NOT NULL").select("row_no", "reason").write.mode("overwrite").json(f"{a.out}/skipped")
    return {"accepted": rows.where("reason IS NULL").count(), "skipped": rows.where("reason IS NOT NULL").count()}


def make_report(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Evaluation records, and those of an earlier run, to summary.json and report.html."""
    previous = spark.read.parquet(a.previous) if a.previous else None
    made = report.write_report(a.out, spark.read.parquet(a.source), previous, direction="rtl" if a.rtl else "ltr")
    return {"entries": len(made["summary"])}


COMMANDS = {"chunk": chunk, "graph": build_graph, "plan": plan, "import": import_answers, "report": make_report}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumentab")
    sub = p.add_subparsers(dest="command", required=True)
    for name, f in COMMANDS.items():
        c = sub.add_parser(name, help=f.__doc__)
        c.add_argument("source")
        c.add_argument("out")
        c.add_argument("--config")
        if name == "report":
            c.add_argument("--previous")
            c.add_argument("--rtl", action="store_true")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(args)
    spark = spark or get_spark("lumentab-cli")
    ship_package(spark)
    with manifest.RunManifest(f"{a.out}/manifest.json", a.command, vars(a)):
        result = COMMANDS[a.command](spark, a)
    print(json.dumps(result))
    return result


if __name__ == "__main__":
    main()
