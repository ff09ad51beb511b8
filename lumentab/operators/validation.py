"""Integrity rules of question sets and judged records, strict parsing, import errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import flat

TRUE, FALSE = ("true", "1", "yes", "y"), ("false", "0", "no", "n")


def strict_boolean(c: Column, default: bool | None = None) -> Column:
    """true/1/yes/y and false/0/no/n in any case, blank is the default; anything else is null, to be told by boolean_fault."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin(*TRUE), True).when(t.isin(*FALSE), False).when(t.isNull() | (t == ""), F.lit(default).cast("boolean"))


def boolean_fault(c: Column) -> Column:
    t = F.lower(F.trim(c.cast("string")))
    return t.isNotNull() & (t != "") & ~t.isin(*TRUE, *FALSE)


def invariant_violations(records: DataFrame) -> DataFrame:
    """(question_id, rule) for each rule a record breaks, in one pass."""
    c = F.col
    rules = {
        "correct_above_addressed": c("correct") > c("addressed"),
        "addressed_above_required": c("addressed") > c("required"),
        "found_above_required": c("retrieval_found") > c("required"),
        "passages_above_total": (c("chunks_relevant") > c("chunks_total")) | (c("chunks_contradictory") > c("chunks_total")),
        "anchor_not_canonical": c("anchor") & (c("question_form") != "canonical"),
        "broad_not_answer": (c("question_form") == "broad") & (c("expected_behavior") != "answer"),
        "clarify_not_ambiguous": (c("expected_behavior") == "clarify") & (c("question_form") != "ambiguous"),
        "both_flags": c("is_abstention") & c("is_clarification"),
    }
    broken = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]), lambda x: x.isNotNull())
    return records.select("question_id", F.explode(broken).alias("rule"))


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of the keys that stand in several rows."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def normalized_payload(df: DataFrame) -> DataFrame:
    """Question records with the defaults of older files, and payload_fault, why a record can't be read (null: it can).

    Columns that aren't there have their default: a question is answerable unless it is to be declined, its behaviour follows
    from that, its form from the behaviour; flags are false, lists empty.
    """
    have = {c.lower() for c in df.columns}
    col = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) if c in have else F.lit(None).cast("string")
    flags = {c: col(c) for c in ("answerable", "clarification_acceptable", "anchor")}
    lists = {c: col(c) for c in ("reference_claims", "supporting_quotes")}
    bad = [F.when(boolean_fault(v), F.lit(f"{c} is no truth value")) for c, v in flags.items()]
    bad += [F.when(v.isNotNull() & F.json_array_length(v).isNull(), F.lit(f"{c} is no JSON array")) for c, v in lists.items()]
    behavior = F.lower(col("expected_behavior"))
    out = df.withColumn("payload_fault", F.coalesce(*bad)).withColumn("answerable", F.coalesce(strict_boolean(flags["answerable"]), behavior.isNull() | (behavior != "abstain")))
    for c in ("clarification_acceptable", "anchor"):
        out = out.withColumn(c, F.coalesce(strict_boolean(flags[c]), F.lit(False)))
    out = out.withColumn("min_key_points", F.coalesce(col("min_key_points").try_cast("int"), F.lit(0)))
    out = out.withColumn("expected_behavior", F.coalesce(behavior, F.when(F.col("answerable"), "answer").otherwise("abstain")))
    out = out.withColumn("question_form", F.coalesce(F.lower(col("question_form")), F.when(F.col("expected_behavior") == "clarify", "ambiguous").otherwise("canonical")))
    for c, default in (("question_type", "basic_knowledge"), ("difficulty", "medium"), ("review_status", "pending")):
        out = out.withColumn(c, F.coalesce(F.lower(col(c)), F.lit(default)))
    return out.withColumn("claims", F.coalesce(F.from_json(lists["reference_claims"], "array<string>"), F.array().cast("array<string>")))


def question_set_faults(questions: DataFrame, key: str = "id") -> DataFrame:
    """(key, fault) for each rule of question sets that a record of normalized_payload breaks; repeated keys too.

    A task to answer without claims of its own takes them from its expected answer, so that lacking claims are no fault.
    """
    c = F.col
    blank = lambda x: F.trim(F.coalesce(c(x).cast("string"), F.lit(""))) == ""
    is_ = {x: c("expected_behavior") == x for x in ("answer", "clarify", "abstain")}
    held = F.size("claims")
    rules = {
        "blank_id": blank(key), "blank_question": blank("question"), "blank_expected_answer": blank("expected_answer"),
        "clarification_acceptable_without_answer": c("clarification_acceptable") & ~is_["answer"], "anchor_not_canonical": c("anchor") & (c("question_form") != "canonical"),
        "broad_without_answer": (c("question_form") == "broad") & ~is_["answer"], "key_points_out_of_range": (c("min_key_points") < 0) | (c("min_key_points") > F.greatest(F.lit(1), held)),
        "answer_not_answerable": is_["answer"] & ~c("answerable"), "clarify_not_ambiguous": is_["clarify"] & (~c("answerable") | (c("question_form") != "ambiguous")), "clarify_with_claims": is_["clarify"] & (held > 0),
        "abstain_answerable": is_["abstain"] & c("answerable"), "abstain_with_claims": is_["abstain"] & (held > 0),
    }
    broken = F.filter(F.array(c("payload_fault"), *[F.when(cond, F.lit(name)) for name, cond in rules.items()]), lambda x: x.isNotNull())
    own = questions.select(key, F.explode(broken).alias("fault"))
    return own.unionByName(duplicate_ids(questions, key).select(key, F.lit("duplicate_id").alias("fault")))


def fault_message(faults: DataFrame, most: int = 10) -> str | None:
    """What a strict reader says: the first faults, and how many more there are; null where there are none."""
    shown = faults.orderBy(*faults.columns).limit(most).collect()
    if not shown:
        return None
    more = faults.count() - len(shown)
    return "; ".join(f"{r[0]}: {r[1]}" for r in shown) + (f"; and {more} more" if more > 0 else "")


# The placeholder of an answering system that found passages but made no answer, and what is said of errors.
PLACEHOLDER = "לא הצלחנו ליצור סיכום לשאילתת החיפוש שלך, אבל כן מצאנו כמה תוצאות."
PLACEHOLDER_ERROR = "answer_generation_failed: RAG retrieval succeeded but answer generation returned a placeholder"
EMPTY_ERROR = "Premade result contains an empty chatbot answer"
THROTTLED_ERROR = "throttled: detected Spike Arrest violation in stored response"
FAULT_ERROR = "api_fault: detected structured fault payload in stored response"
FAULT_TOKENS = ("'fault'", '"fault"', "errorcode", "faultstring")


def import_error(answer: Column, error: Column) -> Column:
    """Why a saved answer is none: its own error text (cut at 240 characters), no content, a placeholder, throttling, a fault
    payload; empty for an answer."""
    told, text = flat(F.coalesce(error, F.lit(""))), flat(F.coalesce(answer, F.lit("")))
    low = F.lower(text)
    payload = low.rlike(r"^[{\[]") & F.exists(F.array(*map(F.lit, FAULT_TOKENS)), lambda t: F.contains(low, t))
    return (
        F.when(told != "", F.concat(F.lit("stored_error: "), F.substring(told, 1, 240), F.when(F.length(told) > 240, "…").otherwise("")))
        .when(text == "", EMPTY_ERROR).when(text == PLACEHOLDER, PLACEHOLDER_ERROR).when(F.contains(low, F.lit("spike arrest violation")), THROTTLED_ERROR)
        .when(payload, FAULT_ERROR).otherwise("")
    )
