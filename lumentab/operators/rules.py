"""Profile rules: predicates over typed profile fields with three-valued logic."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_quote, seeded, words
from ..session import staged

# Operators and the field kinds they suit.
OPERATORS = {"eq": None, "ne": None, "in": ("enum", "text"), "not_in": ("enum", "text"), "lt": ("number", "date"), "lte": ("number", "date"), "gt": ("number", "date"), "gte": ("number", "date")}


def predicate_value(kind: Column, op: Column, actual: Column, values: Column) -> Column:
    """True, false, or null where the profile has no readable value.

    kind is enum, text, bool, number or date; actual the profile's value as text; values the predicate's, as texts.
    """
    first = F.try_element_at(values, F.lit(1))
    low = lambda c: F.lower(F.trim(c))
    listed = F.array_contains(F.transform(values, lambda x: F.lower(F.trim(x))), low(actual))
    flag = lambda c: F.when(low(c).isin("true", "1", "yes", "y"), True).when(low(c).isin("false", "0", "no", "n"), False)

    def ordered(a: Column, b: Column) -> Column:
        return F.when(op == "eq", a == b).when(op == "ne", a != b).when(op == "lt", a < b).when(op == "lte", a <= b).when(op == "gt", a > b).when(op == "gte", a >= b)

    equal = F.when(op == "eq", low(actual) == low(first)).when(op == "ne", low(actual) != low(first)).when(op == "in", listed).when(op == "not_in", ~listed)
    number = ordered(actual.try_cast("double"), first.try_cast("double"))
    date = ordered(F.try_to_date(actual, "yyyy-MM-dd"), F.try_to_date(first, "yyyy-MM-dd"))
    return F.when(actual.isNull() | (F.trim(actual) == ""), F.lit(None).cast("boolean")).when(kind == "number", number).when(kind == "date", date).when(kind == "bool", ordered(flag(actual).cast("int"), flag(first).cast("int"))).otherwise(equal)


def conjunction(r: Column) -> Column:
    """An aggregate: false if any is false, else null if any is null, else true."""
    return F.when(F.count_if(r == F.lit(False)) > 0, False).when(F.count_if(r.isNull()) > 0, F.lit(None).cast("boolean")).otherwise(True)


def all_of(results: Column) -> Column:
    """The same of an array."""
    return F.when(F.exists(results, lambda r: F.coalesce(~r, F.lit(False))), False).when(F.exists(results, lambda r: r.isNull()), F.lit(None).cast("boolean")).otherwise(True)


def evaluate_rules(predicates: DataFrame, facts: DataFrame, small: int = 10_000) -> DataFrame:
    """(rule_id, person, applies): every rule against every profile.

    predicates: (rule_id, pos, key, kind, op, values); facts: (person, key, value) in long form. The facts that some rule names are
    put together into one map for each person, and a rule is one row with its predicates; the result has a row for each person
    and rule, and that join makes just these. The rules go to all executors only where there are at most `small` predicates. A
    person without any fact that a rule names is still a person; of two values of one key the least counts.
    """
    named = predicates.select("key").distinct()
    few = predicates.count() <= small
    kept = facts.join(F.broadcast(named) if few else named, "key", "left_semi")
    one = kept.where("value IS NOT NULL").groupBy("person", "key").agg(F.min("value").alias("value"))
    maps = one.groupBy("person").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("profile"))
    people = facts.select("person").distinct().join(maps, "person", "left").withColumn("profile", F.coalesce("profile", F.create_map().cast("map<string,string>")))
    whole = predicates.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "kind", "op", "values"))).alias("predicates"))
    both = people.crossJoin(F.broadcast(whole) if few else whole)
    results = F.transform("predicates", lambda p: predicate_value(p["kind"], p["op"], F.try_element_at("profile", p["key"]), p["values"]))
    return both.select("rule_id", "person", all_of(results).alias("applies"))


def predicate_faults(predicates: DataFrame, fields: DataFrame) -> DataFrame:
    """(rule_id, pos, reason): the first fault of a predicate against the schema (key, kind, use, values), null for none."""
    both = predicates.join(fields.select("key", F.col("kind").alias("fk"), "use", F.col("values").alias("domain")), "key", "left")
    op_fits = F.lit(False)
    for op, kinds in OPERATORS.items():
        op_fits = op_fits | ((F.col("op") == op) & (F.lit(True) if kinds is None else F.col("fk").isin(*kinds)))
    readable = (
        F.when(F.col("fk") == "number", F.forall("values", lambda x: x.try_cast("double").isNotNull()))
        .when(F.col("fk") == "date", F.forall("values", lambda x: F.try_to_date(x, "yyyy-MM-dd").isNotNull()))
        .when(F.col("fk") == "bool", F.forall("values", lambda x: F.lower(x).isin("true", "false"))).otherwise(True)
    )
    outside = (F.col("fk") == "enum") & F.col("domain").isNotNull() & (F.size(F.array_except("values", "domain")) > 0)
    reason = (
        F.when(F.col("fk").isNull(), "unknown_key").when(F.col("use") == "identifier", "identifier_field").when(F.col("use") != "condition", "field_not_condition")
        .when(~op_fits, "invalid_operator").when((F.size("values") == 0) | ~readable, "invalid_value").when(outside, "value_outside_domain")
    )
    return both.select("rule_id", "pos", reason.alias("reason"))


def mentions(chunks: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """Chunks that name a profile term of at least two characters; filtered in the JVM, before any call."""
    wanted = sorted({t.strip().lower() for t in terms if len(t.strip()) >= 2})
    return chunks.where(F.exists(F.array(*[F.lit(t) for t in wanted]), lambda t: F.contains(F.lower(F.col(text)), t))) if wanted else chunks.limit(0)


def over_limit(candidates: DataFrame, chunk: str, order: str, most: int = 6) -> DataFrame:
    w = Window.partitionBy(chunk).orderBy(order)
    return candidates.withColumn("reason", F.when(F.row_number().over(w) > most, F.lit("over_chunk_limit")).otherwise(F.col("reason")))


def spread_over_files(chunks: DataFrame, seed: int, limit: int) -> DataFrame:
    """Chunks in turns of their files, the files in a seeded order."""
    w = Window.partitionBy("file").orderBy("chunk_no", "chunk_id")
    return chunks.withColumn("_turn", F.row_number().over(w)).orderBy("_turn", seeded(seed, F.col("file")), "file").limit(limit).drop("_turn")


# Endings that a rough stem goes without.
ENDINGS = "(?:ות|ים|ית|ה|ת|ing|ed|es|s)"


def consequence_parts(c: Column) -> tuple[Column, Column, Column]:
    """(numbers, words, rough stems) of a consequence, each distinct."""
    numbers = F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"([0-9]+(?:[.,][0-9]+)*)"), F.lit(1))))
    told = F.array_distinct(words(c))
    return numbers, told, F.array_distinct(F.transform(told, lambda w: F.regexp_replace(w, f"^(.{{3,}}?){ENDINGS}$", "$1")))


def _jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def consequence_similarity(a: Column, b: Column) -> Column:
    """0 where the numbers differ, else the better Jaccard of the words as they are and as stems."""
    (n, w, s), (m, v, t) = consequence_parts(a), consequence_parts(b)
    return F.when(n == m, F.greatest(_jaccard(w, v), _jaccard(s, t))).otherwise(0.0)


def merge_rules(rules: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Rules of the same condition and a like consequence are one: the first stays, source ids are added, exclusive is AND-ed.

    rules: (rule_id, condition, consequence, exclusive, source_ids, pos). A rule joins the first one of its condition that stays and
    is like it. Like consequences share a word or stem beside their numbers, or are the same text; only such pairs are compared,
    however many rules a condition has, and which ones stay is resolved in rounds. Rules that repeat both condition and consequence
    are one class, compared as its first rule: that one is like the others and whatever they are like.
    """
    from .pairing import meetings
    from .retrieval import greedy_kept

    told = F.coalesce("consequence", F.lit(""))
    every = staged(rules.withColumn("_id", F.struct("condition", "pos", "rule_id")).withColumn("_told", told).withColumn("_own", F.when(F.col("condition").isNull(), F.col("_id"))), "rules")  # without a condition each is its own
    n, w, s = consequence_parts(F.col("_told"))
    firsts = every.groupBy("condition", "_told", "_own").agg(F.min("_id").alias("_id"))
    rows = staged(firsts.withColumn("_plain", plain_quote(F.col("_told"))).withColumn("_n", n).withColumn("_w", w).withColumn("_s", s), "rule-classes")
    keys = F.concat(F.transform(F.array_distinct(F.concat("_w", "_s")), lambda x: F.xxhash64("condition", F.array_join("_n", " "), x)), F.array(F.xxhash64("condition", F.lit("="), "_plain")))
    met = meetings(rows.where("condition IS NOT NULL").select(F.explode(keys).alias("token"), F.col("_id").alias("id"), "_plain", "_n", "_w", "_s"))
    like = (F.col("_plain") == F.col("o__plain")) | ((F.col("_n") == F.col("o__n")) & (F.greatest(_jaccard(F.col("_w"), F.col("o__w")), _jaccard(F.col("_s"), F.col("o__s"))) >= threshold))
    pairs = staged(met.where((F.col("id.condition") == F.col("o_id.condition")) & like).select(F.col("id").alias("a"), F.col("o_id").alias("b")).distinct(), "rule-pairs")
    kept = staged(greedy_kept(rows.select("_id"), pairs, "_id"), "rules-kept")
    first = pairs.join(kept.select(F.col("_id").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("_id")).agg(F.min("a").alias("_to"))
    into = rows.join(first, "_id", "left").join(kept.withColumn("_stays", F.lit(True)), "_id", "left").select("condition", "_told", "_own", F.when(F.col("_stays"), F.col("_id")).otherwise(F.col("_to")).alias("_to"))
    same = [every[c].eqNullSafe(into[c]) for c in ("condition", "_told", "_own")]
    ids = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_id", "source_ids"))), lambda x: x["source_ids"])))
    merged = every.join(into, same).groupBy("_to").agg(F.bool_and(F.coalesce("exclusive", F.lit(False))).alias("_x"), ids.alias("_ids"))
    out = every.join(merged, every["_id"] == merged["_to"])
    return out.select(*[F.col("_x").alias("exclusive") if c == "exclusive" else F.col("_ids").alias("source_ids") if c == "source_ids" else every[c] for c in rules.columns])


def rule_faults(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """(rule_id, reason) of extracted rules: no predicates, blank consequence, quote not in its chunk; null for sound ones."""
    text = chunks.select(F.col("chunk_id").alias("source_id"), "text").dropDuplicates(["source_id"])
    both = candidates.join(text, "source_id", "left")
    reason = (
        F.when(F.coalesce(F.size("when"), F.lit(0)) <= 0, "empty_predicates").when(F.trim(F.coalesce("consequence", F.lit(""))) == "", "blank_consequence")
        .when(~F.coalesce(F.contains("text", "quote"), F.lit(False)), "quote_not_verbatim")
    )
    return both.select("rule_id", reason.alias("reason"))


def sides(evaluated: DataFrame, exclusive: Column | None = None) -> DataFrame:
    """The side of a rule on which a profile stands; the side that doesn't apply is asked about only for exclusive rules."""
    side = F.when(F.col("applies").isNull(), "missing_field").when(F.col("applies"), "applies").otherwise("does_not_apply")
    return evaluated.withColumn("side", side).withColumn("skipped", (F.col("side") == "does_not_apply") & ~(exclusive if exclusive is not None else F.lit(True)))


def boundary_days(rows: DataFrame, key: str, source: str, as_of: str, kind: str, least: Column, most: Column, reach: int = 400) -> DataFrame:
    """(key, first_day, last_day): for each source date the as-of dates within reach at which the derived value is in a range."""
    from ..functions.dates import derive

    days = rows.select(key, source, F.explode(F.sequence(F.date_sub(as_of, reach), F.date_add(as_of, reach))).alias("day"))
    value = derive(kind, F.col(source), F.col("day"))
    return days.where((value >= least) & (value <= most)).groupBy(key).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def unpivot_profiles(df: DataFrame, person: str, fields: list[str]) -> DataFrame:
    """(person, key, value) from one column for each field."""
    pairs = F.array(*[F.struct(F.lit(f).alias("key"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select(F.col(person).alias("person"), F.explode(pairs).alias("x")).select("person", "x.*")


def profile_faults(facts: DataFrame, fields: DataFrame) -> DataFrame:
    """(person, key, fault): unknown keys, missing required ones, values unreadable or outside the domain; values aren't shown."""
    f = fields.select("key", "kind", F.col("values").alias("domain"), "required")
    both = facts.join(f, "key", "left")
    v = F.col("value")
    fault = (
        F.when(F.col("kind").isNull(), "unknown_key").when(v.isNull(), None).when((F.col("kind") == "number") & v.try_cast("double").isNull(), "not_a_number")
        .when((F.col("kind") == "date") & F.try_to_date(v, "yyyy-MM-dd").isNull(), "not_a_date").when((F.col("kind") == "bool") & ~F.lower(v).isin("true", "false"), "not_a_boolean")
        .when((F.col("kind") == "enum") & F.col("domain").isNotNull() & ~F.array_contains(F.col("domain"), v), "outside_domain")
    )
    bad = both.select("person", "key", fault.alias("fault")).where("fault IS NOT NULL")
    wanted = facts.select("person").distinct().crossJoin(f.where("required").select("key"))
    missing = wanted.join(facts.where("value IS NOT NULL AND trim(value) <> ''").select("person", "key"), ["person", "key"], "left_anti").withColumn("fault", F.lit("missing"))
    return bad.unionByName(missing.select("person", "key", "fault"))


def render_profile(facts: DataFrame, fields: DataFrame) -> DataFrame:
    """(person, line): "label: value, …" in the schema's order, booleans in lower case, blank values left out."""
    both = facts.join(fields.select("key", "label", "place", "kind"), "key").where("value IS NOT NULL AND trim(value) <> ''")
    value = F.when(F.col("kind") == "bool", F.lower("value")).otherwise(F.col("value"))
    g = both.groupBy("person").agg(F.array_sort(F.collect_list(F.struct("place", F.concat("label", F.lit(": "), value).alias("t")))).alias("l"))
    return g.select("person", F.array_join(F.transform("l", lambda x: x["t"]), ", ").alias("line"))


def clarification_text(missing: DataFrame) -> DataFrame:
    """(person, text) that asks for the missing labels."""
    g = missing.groupBy("person").agg(F.array_sort(F.collect_set("label")).alias("l"))
    return g.select("person", F.concat(F.lit("Please tell me: "), F.array_join("l", ", ")).alias("text"))


def extract_rules(chunks: DataFrame, terms: list[str], model) -> DataFrame:
    """Prefiltered chunks through a model call (see models.structured_calls), one row for each candidate."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(c, n, *r) for c, t in zip(b["chunk_id"], b["text"]) for n, r in enumerate(model(t), 1)]
            yield pd.DataFrame(out, columns=["source_id", "pos", "consequence", "quote"])

    return mentions(chunks, terms).select("chunk_id", "text").mapInPandas(call, "source_id string, pos int, consequence string, quote string")
