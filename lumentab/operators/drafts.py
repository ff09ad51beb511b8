"""Drafts of questions about profiles, numbering and anchors of question sets, prompts of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bare_forms, plain_quote, seeded
from ..session import cut, ranked

# How a condition is told.
OPERATOR_TEXT = {"eq": "=", "ne": "!=", "in": "in", "not_in": "not in", "lt": "<", "lte": "<=", "gt": ">", "gte": ">="}
LETTERS = r"([\p{L}]{3,})"


def profile_value(profile: Column, key: str) -> Column:
    """The value at a dotted key of a profile in JSON: the field of just that name before the nested one; of an object with a
    description, that. Null where there is none."""
    nested = "$" + "".join(f"['{p}']" for p in key.split("."))
    value = F.coalesce(F.get_json_object(profile, f"$['{key}']"), F.get_json_object(profile, nested))
    return F.when(value.startswith("{"), F.coalesce(F.get_json_object(value, "$.description"), value)).otherwise(value)


def kept_claims(claims: Column, ids: Column) -> Column:
    """The claims with these numbers (from 1) in their order; all of them where there is no number, null where one is out of range."""
    wrong = F.exists(ids, lambda i: (i < 1) | (i > F.size(claims)))
    some = F.transform(F.array_sort(F.array_distinct(ids)), lambda i: F.get(claims, i - 1))
    return F.when(wrong, F.lit(None)).when(F.size(ids) > 0, some).otherwise(claims)


def decisive_fields(predicates: DataFrame, derived: DataFrame) -> DataFrame:
    """(rule_id, fields): the profile fields that a rule reads, in order of first use; a derived key stands for its source.

    predicates is (rule_id, pos, key), derived (key, source).
    """
    source = derived.select(F.trim("key").alias("_k"), "source").dropDuplicates(["_k"])
    rows = predicates.select("rule_id", "pos", F.trim("key").alias("_k")).join(source, "_k", "left").select("rule_id", "pos", F.coalesce("source", "_k").alias("field"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "field")))
    return rows.groupBy("rule_id").agg(F.array_distinct(F.transform(ordered, lambda x: x["field"])).alias("fields"))


def predicate_text(label: Column, key: Column, op: Column, values: Column) -> Column:
    told = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in OPERATOR_TEXT.items() for x in kv]), op), op)
    return F.concat(F.coalesce(label, key), F.lit(" ("), key, F.lit(") "), told, F.lit(" "), F.array_join(values, ", "))


def draft_faults(drafts: DataFrame, predicates: DataFrame) -> DataFrame:
    """(draft_id, reason): why the draft of a question about a rule can't be used; null where it can.

    drafts: (draft_id, rule_id, exclusive, question, answer_if_applies, answer_if_not, claims_if_applies, claims_if_not,
    general_rule_claim); predicates: (rule_id, kind, values). A question must not name the values of its conditions, but for truth
    values and single letters; a number counts where it stands as one.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    none = lambda c: F.size(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x) != "")) == 0
    values = predicates.where("kind <> 'bool' OR kind IS NULL").select("rule_id", F.explode("values").alias("v")).select("rule_id", F.trim("v").alias("v"))
    values = values.where((F.length("v") >= 2) | F.col("v").rlike("^[0-9]+$")).select("rule_id", plain_quote("v").alias("v")).groupBy("rule_id").agg(F.collect_set("v").alias("told"))
    rows = drafts.withColumn("_q", plain_quote("question")).join(values, "rule_id", "left")
    numbers = F.regexp_extract_all("_q", F.lit("([0-9]+)"), F.lit(1))
    restates = F.exists(F.coalesce("told", F.array().cast("array<string>")), lambda v: F.when(v.rlike("^[0-9]+$"), F.array_contains(numbers, v)).otherwise(F.contains(F.col("_q"), v)))
    reason = (
        F.when(blank("question"), "blank_question").when(blank("answer_if_applies") | (F.col("exclusive") & blank("answer_if_not")), "blank_answer")
        .when(none("claims_if_applies") | (F.col("exclusive") & none("claims_if_not")), "missing_claims").when(blank("general_rule_claim"), "missing_general_claim")
        .when(restates, "question_restates_condition")
    )
    return rows.select("draft_id", reason.alias("reason"))


def same_stem(a: Column, b: Column) -> Column:
    """Whether two words agree but for attached letters and endings: in three letters, and all but one of the shorter form."""
    forms = lambda w: F.concat(F.array(w), bare_forms(w))

    def alike(x: Column, y: Column) -> Column:
        n = F.greatest(F.lit(3), F.least(F.length(x), F.length(y)) - 1)
        return (F.length(x) >= n) & (F.length(y) >= n) & (F.substring(x, F.lit(1), n) == F.substring(y, F.lit(1), n))

    return F.exists(forms(a), lambda x: F.exists(forms(b), lambda y: alike(x, y)))


def stated_conditions(predicates: DataFrame, every: bool = True) -> DataFrame:
    """predicates with stated: whether their quote names the condition by some sign.

    (…, kind, op, values, names, quote): a number stands there (for an ordered operator also one beside it), or of a threshold of
    0 or 1 a word of the names; of a date the year; of the others all words of a name, or for an enum of a value. names are the
    label and its other wordings.
    """
    words = lambda c: F.regexp_extract_all(c, F.lit(LETTERS), F.lit(1))
    low = lambda c: F.transform(c, lambda x: F.lower(x))
    rows = predicates.withColumn("_q", plain_quote("quote")).withColumn("_w", words("_q"))
    rows = rows.withColumn("_n", F.transform(F.regexp_extract_all("_q", F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1)), lambda x: x.try_cast("double")))
    has = lambda t: F.exists("_w", lambda o: same_stem(t, o))
    by_words = lambda term, whole: (F.size(words(term)) > 0) & (F.forall(words(term), has) if whole else F.exists(words(term), has))
    any_name = lambda whole: F.exists(low(F.col("names")), lambda x: by_words(x, whole))
    ordered = F.col("op").isin("lt", "lte", "gt", "gte")
    near = lambda v: F.exists("_n", lambda n: (n == v) | (ordered & (F.abs(n - v) == 1)))
    numeric = F.transform("values", lambda v: v.try_cast("double"))
    number = F.exists(numeric, near) | (F.forall(numeric, lambda v: F.abs(v) <= 1) & any_name(False))
    date = F.exists("values", lambda v: F.array_contains(F.col("_n"), F.substring(v, 1, 4).try_cast("double")))
    other = any_name(every) | ((F.col("kind") == "enum") & F.exists(low(F.col("values")), lambda v: by_words(v, every)))
    stated = F.when(F.col("kind") == "number", number).when(F.col("kind") == "date", date).otherwise(other)
    return rows.withColumn("stated", F.coalesce(stated, F.lit(False))).drop("_q", "_w", "_n")


def basic_samples(facts: DataFrame, seed: int, most: int) -> DataFrame:
    """The first `most` of the (person, key) pairs that have a value, in a seeded order."""
    rows = facts.where("value IS NOT NULL").select("person", "key").distinct()
    return rows.orderBy(seeded(seed, F.concat(F.col("person").cast("string"), F.lit(":"), "key")), "person", "key").limit(most)


def marked_anchors(questions: DataFrame, user_facing: bool = True, key: str = "question_id") -> DataFrame:
    """questions with anchor: in a set for users, the canonical questions that have a natural variant."""
    covered = questions.where("question_form = 'natural_user' AND parent_question_id IS NOT NULL").select(F.col("parent_question_id").alias(key)).distinct().withColumn("_hit", F.lit(True))
    own = F.lit(user_facing) & (F.col("question_form") == "canonical") & F.col("_hit").isNotNull()
    return questions.drop("anchor").join(covered, key, "left").withColumn("anchor", F.coalesce(own, F.lit(False))).drop("_hit")


def next_number(ids: DataFrame, key: str = "id") -> int:
    """One more than the largest number of the ids Q and digits."""
    n = ids.agg(F.max(F.regexp_extract(key, "^Q([0-9]+)$", 1).try_cast("long"))).first()[0]
    return (n or 0) + 1


def sequential_ids(questions: DataFrame, order: list, start: int = 1, key: str = "id", parent: str = "parent_question_id") -> DataFrame:
    """questions with ids Q0001, Q0002, … in order; parents inside the set follow (of a repeated id, the first row's).

    Numbers come from sorted ranges, not from one task.
    """
    rows = ranked(questions, order, "_rank").withColumn("_new", F.format_string("Q%04d", F.col("_rank") + start))
    first = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_old")).agg(F.min_by("_new", "_rank").alias("_parent"))
    out = rows.join(first, rows[parent] == first["_old"], "left").withColumn(parent, F.coalesce("_parent", parent))
    return out.withColumn(key, F.col("_new")).drop("_rank", "_new", "_old", "_parent")


def document_map(chunks: DataFrame) -> DataFrame:
    """(document_id, file, title): documents D01, D02, … in order of their files; the title is that of the front matter of the
    first chunk, else the file's name without suffix, hyphens as blanks."""
    head = chunks.where("file IS NOT NULL").groupBy("file").agg(F.min_by("text", F.struct("chunk_no", "chunk_id")).alias("text"))
    title = F.trim(F.regexp_extract(F.coalesce("text", F.lit("")), r"(?m)^title:[ \t]*(.*)$", 1))
    stem = F.regexp_replace(F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1"), "-", " ")
    return ranked(head, ["file"], "_rank").select(F.format_string("D%02d", F.col("_rank") + 1).alias("document_id"), "file", F.when(title != "", title).otherwise(stem).alias("title"))


def partition_fingerprint(members: DataFrame) -> DataFrame:
    """One row (fingerprint): the identity of a partition into topics, (topic, id). Of each topic, however large, only the number of
    its ids and the sum of their digests is taken."""
    part = F.conv(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    one = members.distinct().groupBy("topic").agg(F.count("*").alias("n"), F.sum(part).alias("s"))
    row = F.sha2(F.concat_ws(":", "topic", F.col("n").cast("string"), F.col("s").cast("string")), 256)
    return one.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")), 256).alias("fingerprint"))


def carried_targets(windows: DataFrame) -> DataFrame:
    """(topic, window_no, target): a window's goal and what the windows before it left undone, folded along each topic's windows;
    windows is (topic, window_no, goal, made). A window with nothing to do passes on what it got."""
    g = windows.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("window_no", F.col("goal").cast("long").alias("goal"), F.col("made").cast("long").alias("made")))).alias("w"))
    zero = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<struct<window_no: bigint, target: bigint>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        target = x["goal"] + state["carry"]
        out = F.concat(state["out"], F.array(F.struct(x["window_no"].cast("long").alias("window_no"), target.alias("target"))))
        return F.struct(F.when(target > 0, target - x["made"]).otherwise(state["carry"]).alias("carry"), out.alias("out"))

    return g.select("topic", F.explode(F.aggregate("w", zero, step)["out"]).alias("x")).select("topic", "x.*")


def fitting_rows(rows: DataFrame, order: list, size: str, budget: int) -> DataFrame:
    """The rows that go into a prompt of a budget when each in order is added if it still fits, and later, smaller ones are tried
    on. size is a column of lengths.

    In rounds: of what is left and fits at all, the longest run in order that fits; what stands behind it goes on. The running
    sums are over ranges of ranks, and of ranks only up to the budget, as no row is empty.
    """
    left = cut(ranked(rows.where(F.col(size) > 0), order, "_rank"))
    taken, room, after = None, budget, -1
    while True:
        open_ = left.where((F.col(size) <= room) & (F.col("_rank") > after)).orderBy("_rank").limit(max(1, room))  # no more can fit
        sums = open_.withColumn("_sum", F.sum(size).over(Window.orderBy("_rank"))).where(F.col("_sum") <= room)
        now = cut(sums)
        got = now.agg(F.max("_sum"), F.max("_rank")).first()
        if got[0] is None:
            break
        part = now.drop("_sum")
        taken = part if taken is None else taken.unionByName(part)
        room, after = room - got[0], got[1]
    return (left.limit(0) if taken is None else taken).drop("_rank")
