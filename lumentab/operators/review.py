"""Upkeep of question sets: review merge with edit overlay, appending, remapping, stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FACTUAL = ("question", "expected_answer", "expected_behavior")


def merge_review(canonical: DataFrame, edited: DataFrame, key: str = "id", fields: tuple[str, ...] = ("question", "expected_answer", "review_status")) -> DataFrame:
    """(key, fields…, status): canonical rows under a review file's edits.

    status: unchanged, edited, deleted (in the canonical set only), added (no key), unknown_id, duplicate_id (the key is twice in
    the file: the canonical row stays as it is). A factual edit of an approved row needs grounding again.
    """
    w = Window.partitionBy(key)
    e = edited.where(F.col(key).isNotNull()).withColumn("_times", F.count("*").over(w)).withColumn("_nth", F.row_number().over(w.orderBy(*fields))).where("_nth = 1").drop("_nth")
    e = e.select(key, "_times", F.lit(True).alias("_e"), *[F.col(f).alias(f"_{f}") for f in fields])
    both = canonical.withColumn("_c", F.lit(True)).join(e, key, "full_outer")
    twice = F.coalesce(F.col("_times") > 1, F.lit(False))
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f).eqNullSafe(F.col(f"_{f}"))
    factual = F.lit(False)
    for f in fields:
        if f in FACTUAL:
            factual = factual | ~F.col(f).eqNullSafe(F.col(f"_{f}"))
    status = F.when(F.col("_c").isNull(), "unknown_id").when(twice, "duplicate_id").when(F.col("_e").isNull(), "deleted").when(differs, "edited").otherwise("unchanged")
    out = both.withColumn("status", status)
    take = F.col("status").isin("edited", "unknown_id")
    new = []
    for f in fields:
        value = F.when(take, F.col(f"_{f}")).otherwise(F.col(f))
        if f == "review_status":
            value = F.when((F.col("status") == "edited") & factual & (F.lower(F.col("_review_status")) == "approved"), "needs_reground").otherwise(value)
        new.append(value.alias(f))
    added = edited.where(F.col(key).isNull()).select(F.lit(None).cast(dict(canonical.dtypes)[key]).alias(key), *fields, F.lit("added").alias("status"))
    return out.select(key, *new, "status").unionByName(added)


def append_sets(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Both sets, the first one's row where a key is in both."""
    rows = first.withColumn("_from", F.lit(0)).unionByName(second.withColumn("_from", F.lit(1)))
    w = Window.partitionBy(key).orderBy("_from")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_from")


def replace_variants(questions: DataFrame, new: DataFrame, parent: str, form: str, forms: list[str]) -> DataFrame:
    """The set without the variants of the given forms whose parents have new ones, and the new ones."""
    gone = new.select(parent).distinct().withColumn("_hit", F.lit(True))
    kept = questions.join(gone, parent, "left").where(F.col("_hit").isNull() | ~F.col(form).isin(*forms)).drop("_hit")
    return kept.unionByName(new)


def remap(df: DataFrame, column: str, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """column through mapping (old, new), itself where there is none."""
    m = mapping.select(F.col(old).alias("_old"), F.col(new).alias("_new")).dropDuplicates(["_old"])
    return df.join(m, df[column] == m["_old"], "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def stable_ids(df: DataFrame, prefix: str, content: Column, into: str = "stable_id") -> DataFrame:
    """Ids from content; equal contents get -2, -3, … in order of all columns."""
    base = F.concat(F.lit(prefix), F.substring(F.sha2(content, 256), 1, 16))
    rows = df.withColumn("_base", base)
    n = F.row_number().over(Window.partitionBy("_base").orderBy(*df.columns))
    return rows.withColumn(into, F.concat("_base", F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise(""))).drop("_base")


def parents_without(questions: DataFrame, form: str, key: str = "question_id", parent: str = "parent_question_id") -> DataFrame:
    """Canonical questions without a variant of a form."""
    have = questions.where(F.col("question_form") == form).select(F.col(parent).alias(key)).distinct()
    return questions.where("question_form = 'canonical'").join(have, key, "left_anti").select(key)


def approved_with_parents(questions: DataFrame, key: str = "id", parent: str = "parent_question_id", status: str = "review_status") -> DataFrame:
    """Approved questions and the parents of approved variants."""
    good = questions.where(F.lower(F.trim(status)) == "approved")
    wanted = good.select(F.col(key).alias("_k")).union(good.where(F.col(parent).isNotNull()).select(parent)).distinct()
    return questions.join(wanted, questions[key] == wanted["_k"], "left_semi")
