"""Rule, persona and date queries, with their SQL: customers and orders as profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import personas, rules
from ..session import table
from .catalog import core

# rule, pos, key, kind, op, values
RULES = [
    ("R1", 1, "segment", "enum", "in", ["BUILDING", "MACHINERY"]), ("R1", 2, "balance", "number", "gte", ["0"]),
    ("R2", 1, "balance", "number", "lt", ["1000.5"]), ("R2", 2, "nation", "number", "ne", ["3"]), ("R2", 3, "level", "enum", "eq", ["high"]),
    ("R3", 1, "segment", "enum", "not_in", ["AUTOMOBILE"]), ("R3", 2, "level", "enum", "ne", ["low"]),
    ("R4", 1, "nation", "number", "lte", ["12"]), ("R5", 1, "absent", "text", "eq", ["x"]), ("R5", 2, "nation", "number", "gt", ["20"]),
]
LEVEL = "case when c_custkey % 7 = 0 then null when c_custkey % 3 = 0 then 'High ' else 'low' end"


def _facts(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_custkey", "c_mktsegment AS segment", "c_acctbal AS balance", "c_nationkey AS nation", f"{LEVEL} AS level")
    return rules.unpivot_profiles(rows, "c_custkey", ["segment", "balance", "nation", "level"])


def _k(*parts: str) -> str:
    """Kleene AND of SQL conditions."""
    return " AND ".join(f"({p})" for p in parts)


_P = f"p AS (SELECT c_custkey AS person, c_mktsegment AS segment, c_acctbal AS balance, c_nationkey AS nation, {LEVEL} AS level FROM customer)"


@core.query(
    f"""WITH {_P} SELECT 'R1' AS rule_id, person, {_k("lower(segment) IN ('building', 'machinery')", "balance >= 0")} AS applies FROM p
    UNION ALL SELECT 'R2', person, {_k("balance < 1000.5", "nation <> 3", "lower(trim(level)) = 'high'")} FROM p
    UNION ALL SELECT 'R3', person, {_k("lower(segment) NOT IN ('automobile')", "lower(trim(level)) <> 'low'")} FROM p
    UNION ALL SELECT 'R4', person, nation <= 12 FROM p UNION ALL SELECT 'R5', person, {_k("NULL::boolean", "nation > 20")} FROM p"""
)
def rule_eval(spark, d):
    """Five rules on every customer, in three-valued logic."""
    predicates = spark.createDataFrame(RULES, "rule_id string, pos int, key string, kind string, op string, values array<string>")
    return rules.evaluate_rules(predicates, _facts(spark, d))


@core.query(
    """SELECT o_orderkey, greatest(-1000, (year(e) - year(s)) * 12 + month(e) - month(s) - (day(e) < day(s))::int)::bigint AS months, floor(((year(e) - year(s)) * 12 + month(e) - month(s) - (day(e) < day(s))::int) / 12.0)::bigint AS years,
    (e - s)::bigint AS days_since, (s - e)::bigint AS days_until FROM (SELECT o_orderkey, o_orderdate::date AS s, DATE '2024-02-29' AS e FROM orders)"""
)
def derived_dates(spark, d):
    s, e = F.to_date("o_orderdate"), F.lit("2024-02-29").cast("date")
    return table(spark, d, "orders").select(
        "o_orderkey", dates.derive("months_since", s, e).cast("bigint").alias("months"), dates.derive("years_since", s, e).cast("bigint").alias("years"),
        dates.derive("days_since", s, e).cast("bigint").alias("days_since"), dates.derive("days_until", s, e).cast("bigint").alias("days_until"),
    )


@core.query(
    """WITH s AS (SELECT c_custkey, DATE '1990-01-01' + ((c_custkey * 37) % 12000)::int AS born FROM customer), x AS (SELECT c_custkey, born, DATE '2024-06-15' + g::int AS day FROM s, generate_series(-400, 400) t(g)),
    y AS (SELECT *, floor(((year(day) - year(born)) * 12 + month(day) - month(born) - (day(day) < day(born))::int) / 12.0) AS years FROM x) SELECT c_custkey, min(day) AS first_day, max(day) AS last_day FROM y WHERE years BETWEEN 18 AND 18 GROUP BY 1"""
)
def boundary_scan(spark, d):
    """The days around a fixed date on which a person is eighteen."""
    rows = table(spark, d, "customer").select("c_custkey", F.expr("date_add(date'1990-01-01', cast((c_custkey * 37) % 12000 as int))").alias("born"), F.lit("2024-06-15").cast("date").alias("as_of"))
    return rules.boundary_days(rows, "c_custkey", "born", "as_of", "years_since", F.lit(18), F.lit(18))


@core.query(
    f"""WITH {_P}, f AS (SELECT person, 'segment' AS key, segment AS value FROM p UNION SELECT person, 'nation', nation::varchar FROM p UNION SELECT person, 'level', trim(level) FROM p WHERE level IS NOT NULL),
    v AS (SELECT DISTINCT key, value FROM f), pr AS (SELECT a.key AS ka, a.value AS va, b.key AS kb, b.value AS vb FROM v a, v b WHERE a.key < b.key),
    s AS (SELECT DISTINCT a.key AS ka, a.value AS va, b.key AS kb, b.value AS vb FROM f a JOIN f b ON a.person = b.person AND a.key < b.key) SELECT count(*) AS pairs, count(s.ka) AS covered FROM pr LEFT JOIN s USING (ka, va, kb, vb)"""
)
def persona_pairs(spark, d):
    facts = _facts(spark, d).where("key <> 'balance' AND value IS NOT NULL").withColumn("value", F.trim("value"))
    return personas.pair_coverage(facts, facts.select("key", "value").distinct())


@core.query(
    f"""WITH {_P} SELECT person, concat_ws(', ', 'Segment: ' || segment, CASE WHEN trim(level) <> '' THEN 'Level: ' || level END, 'Nation: ' || nation) AS line FROM p"""
)
def profile_lines(spark, d):
    fields = spark.createDataFrame([("segment", "Segment", 1, "enum"), ("level", "Level", 2, "enum"), ("nation", "Nation", 3, "number")], "key string, label string, place int, kind string")
    return rules.render_profile(_facts(spark, d), fields)


@core.query(
    f"""WITH {_P} SELECT person, 'level' AS key, 'missing' AS fault FROM p WHERE level IS NULL UNION ALL SELECT person, 'level', 'outside_domain' FROM p WHERE level NOT IN ('high', 'low') UNION ALL SELECT person, 'balance', 'unknown_key' FROM p"""
)
def profile_validation(spark, d):
    fields = spark.createDataFrame([("segment", "enum", None, True), ("level", "enum", ["high", "low"], True), ("nation", "number", None, True)], "key string, kind string, values array<string>, required boolean")
    return rules.profile_faults(_facts(spark, d), fields)


@core.query()
def rule_merge(spark, d):
    """Rules made of the brands' parts, merged by condition and consequence; sequential within a condition, checked on fixtures."""
    parts = table(spark, d, "part").selectExpr("cast(p_partkey as string) AS rule_id", "concat(p_brand, '/', p_size) AS condition", "concat('pays ', p_size, ' units for ', p_type) AS consequence", "p_partkey % 2 = 0 AS exclusive", "array(p_brand) AS source_ids", "cast(p_partkey as int) AS pos")
    return rules.merge_rules(parts).select("rule_id", "condition", "exclusive", F.size("source_ids").alias("sources"))
