"""Question sets, evaluations and saved answers as files."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.headers import FIELDS, resolve_headers
from ..operators.validation import fault_message, import_error
from ..session import numbered
from .corpus import xlsx_rows

RISKY_START = r"^\s*[=+\-@]"


def escape_formulas(df: DataFrame) -> DataFrame:
    """Texts that a spreadsheet would run get an apostrophe before them; restore_formulas takes it away again."""
    guard = lambda c: F.when(F.col(c).rlike(RISKY_START) | F.col(c).rlike(r"^'\s*[=+\-@]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c))
    return df.select(*[guard(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def restore_formulas(df: DataFrame) -> DataFrame:
    back = lambda c: F.when(F.col(c).rlike(r"^''?\s*[=+\-@]"), F.substring(F.col(c), F.lit(2), F.length(c))).otherwise(F.col(c))
    return df.select(*[back(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def encode_sources(sources: Column) -> Column:
    """The canonical JSON of an array of sources."""
    return F.to_json(sources)


#: The readable columns of a question's sources and the fields they list, in order, with " | " between.
SOURCE_COLUMNS = {"source_ids": "source_id", "source_files": "file", "source_locations": "location", "source_excerpts": "excerpt"}


def decode_sources(df: DataFrame) -> DataFrame:
    """sources from sources_json where it is there, else from the readable columns, one by one, short ones filled up with blanks.

    conflict is set where sources_json is no list of sources, or says otherwise than a readable column that is there.
    """
    schema = "array<struct<" + ",".join(f"{f}:string" for f in SOURCE_COLUMNS.values()) + ">>"
    have = {c: F.coalesce(F.col(c), F.lit("")) for c in SOURCE_COLUMNS if c in df.columns}
    told = F.nullif(F.col("sources_json"), F.lit(""))
    made = F.when(F.json_array_length(told).isNotNull(), F.from_json(told, schema))
    listed = lambda f: F.array_join(F.transform(made, lambda x: F.coalesce(x[f], F.lit(""))), " | ")
    differs = [F.coalesce(listed(SOURCE_COLUMNS[c]) != v, F.lit(True)) for c, v in have.items()]
    conflict = F.lit(False)
    for d in differs:
        conflict = conflict | d
    split = {f: F.when(have[c] != "", F.split(have[c], r" \| ")).otherwise(F.array().cast("array<string>")) if c in have else F.array().cast("array<string>") for c, f in SOURCE_COLUMNS.items()}
    longest = F.greatest(*[F.size(v) for v in split.values()])
    at = lambda v, i: F.coalesce(F.get(v, i), F.lit(""))
    legacy = F.when(longest > 0, F.transform(F.sequence(F.lit(0), longest - 1), lambda i: F.struct(*[at(v, i).alias(f) for f, v in split.items()]))).otherwise(F.array().cast(schema))
    return df.withColumn("conflict", F.when(told.isNotNull(), made.isNull() | conflict).otherwise(False)).withColumn("sources", F.coalesce(made, legacy))


# How forms, behaviours, outcomes, scopes and kinds of errors are named in a Hebrew table of evaluations.
FORM_NAMES = {"canonical": "שאלה מנוסחת היטב", "natural_user": "ניסוח משתמש טבעי", "ambiguous": "שאלה הדורשת הבהרה", "broad": "שאלה כללית"}
BEHAVIOR_NAMES = {"answer": "לענות", "clarify": "לשאול שאלת הבהרה", "abstain": "להימנע ממענה"}
OUTCOME_NAMES = {
    "correct_answer": "תשובה נכונה", "partial_too_little": "תשובה חלקית — חסר מידע", "partial_too_much": "תשובה חלקית — עודף מידע", "unrelated_answer": "תשובה שגויה ולא קשורה", "misleading_hallucination": "הזיה מטעה",
    "incorrect_abstention": "נמנע ממענה למרות שהמידע קיים", "correct_abstention": "נמנע ממענה בצדק", "should_have_abstained": "ענה למרות שהיה צריך להימנע", "correct_clarification": "שאלת הבהרה מתאימה",
    "missing_clarification": "נדרש בירור אך לא נשאל", "chatbot_error": "שגיאת מערכת בצ׳אטבוט", "judge_error": "שגיאה בתהליך הבדיקה",
}
SCOPE_NAMES = {"exact": "היקף מתאים", "too_little": "חסר מידע", "too_much": "עודף מידע"}
INCORRECT_NAMES = {"not_applicable": "לא רלוונטי", "unrelated": "תשובה לא קשורה", "hallucination": "הזיה מטעה"}
# The columns of that table, the field of an evaluation record in each, and how it is written.
EVALUATION_COLUMNS = [
    ("מזהה שאלה", "question_id", None), ("מזהה שאלת מקור", "parent_question_id", None), ("נושא", "topic", None), ("צורת שאלה", "question_form", FORM_NAMES), ("התנהגות מצופה", "expected_behavior", BEHAVIOR_NAMES),
    ("שאלה", "question", None), ("תשובה צפויה", "expected_answer", None), ("ניתנת למענה", "answerable", "yes_no"), ("תשובת הצ׳אטבוט", "answer", None), ("מקטעים שאוחזרו", "retrieved_context", None),
    ("סיווג", "outcome", OUTCOME_NAMES), ("קוד סיווג", "outcome", None), ("פרטים נדרשים", "required", "score"), ("פרטים שנענו", "addressed", "score"), ("פרטים שנענו נכון", "correct", "score"),
    ("טענות שגויות", "false_claims", "score"), ("טענות לא מבוססות", "unsupported", "score"), ("טענות עודפות", "extraneous", "score"), ("היקף התשובה", "answer_scope", SCOPE_NAMES), ("סוג שגיאה", "incorrect_type", INCORRECT_NAMES),
    ("פרטים שנמצאו באחזור", "retrieval_found", "score"), ("מספר מקטעים", "chunks_total", "score"), ("מקטעים רלוונטיים", "chunks_relevant", "score"), ("מקטעים סותרים", "chunks_contradictory", "score"),
    ("הסבר הבדיקה", "explanation", "score"), ("מידע חסר או שגוי", "missing_or_wrong", "score"), ("הסבר האחזור", "retrieval_explanation", "score"), ("זמן תגובה במילישניות", "latency_ms", None), ("שגיאת מערכת", "error", None),
    ("פירוט טענות הייחוס", "claim_assessments", "json"), ("דורש אימות", "requires_verification", "score"), ("ערכים לאימות", "verification_values", "lines"), ("פירוט טענות שגויות", "false_claim_details", "json"),
    ("בדיקה שנייה של טענות שגויות", "false_claim_verifications", "json"), ("הצבעות השופט לא תאמו", "votes_disagree", "yes"), ("סיווגי ההצבעות", "vote_outcomes", "slashes"),
]


def evaluation_rows(records: DataFrame) -> DataFrame:
    """The 36 columns of a table of evaluations, as texts; what a record lacks is blank, and so are the scores of an error."""
    kinds = dict(records.dtypes)
    scored = ~F.col("outcome").isin("chatbot_error", "judge_error")

    def cell(field: str, how: object) -> Column:
        if field not in kinds:
            return F.lit("[]" if how == "json" else "")
        c = F.col(field)
        if isinstance(how, dict):
            named = F.try_element_at(F.create_map(*[F.lit(x) for kv in how.items() for x in kv]), c)
            return F.when(scored | F.lit(how not in (SCOPE_NAMES, INCORRECT_NAMES)), F.coalesce(named, c)).otherwise("")
        if how == "yes_no":
            return F.when(c, "כן").otherwise("לא")
        if how == "yes":
            return F.when(scored & c, "כן").otherwise("")
        if how == "json":
            return F.when(scored, F.to_json(c)).otherwise("[]")
        if how in ("lines", "slashes"):
            return F.when(scored, F.array_join(c, "\n" if how == "lines" else " / ")).otherwise("")
        return F.when(scored | F.lit(how != "score"), c.cast("string")).otherwise("")

    return records.select(*[F.coalesce(cell(field, how), F.lit("[]" if how == "json" else "")).alias(name) for name, field, how in EVALUATION_COLUMNS])


def write_evaluations(records: DataFrame, folder: str, name: str = "evaluation_details") -> None:
    """Evaluation records twice: JSON lines with all their fields, and the table for people as CSV."""
    records.write.mode("overwrite").json(f"{folder}/{name}.jsonl")
    escape_formulas(evaluation_rows(records)).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(f"{folder}/{name}.csv")


def write_pair(df: DataFrame, folder: str, name: str) -> None:
    """A set twice: JSON lines, lossless, and CSV for people, nested columns as JSON. Each is replaced as a whole by Spark's
    commit."""
    df.write.mode("overwrite").json(f"{folder}/{name}.jsonl")
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    escape_formulas(flat).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(f"{folder}/{name}.csv")


def read_set(spark: SparkSession, path: str, schema: str | None = None, approved_only: bool = False) -> DataFrame:
    """A question set from CSV or JSON lines."""
    if path.rstrip("/").endswith(".csv"):
        df = restore_formulas(spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path))
    else:
        df = spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    return df.where(F.lower(F.trim("review_status")) == "approved") if approved_only else df


def read_evaluations(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Evaluation records; a repeated question id is an error when its row is read."""
    from pyspark.sql import Window

    df = spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    n = F.count("*").over(Window.partitionBy("question_id"))
    return df.withColumn("question_id", F.when(n > 1, F.raise_error(F.concat(F.lit("question id twice: "), F.col("question_id").cast("string")))).otherwise(F.col("question_id")))


def saved_answers(spark: SparkSession, path: str, columns: dict[str, str] | None = None, strict: bool = False) -> DataFrame:
    """The sixteen fields of saved answers from CSV, JSON lines or a workbook, with row_no (as people count them: the header is
    row 1 of a table, the first line 1 of JSON lines), reason of a skipped row (a text lacks, or its id was there before), and the
    import error of its answer. Columns are found by the accepted names or named in columns. strict: a row to skip is an error
    that names the first ten."""
    suffix = Path(path.rstrip("/")).suffix.lower()
    if suffix == ".xlsx":
        data = spark.read.format("binaryFile").load(path).select("content").first()["content"]  # one workbook
        head, *body = [r for r in xlsx_rows(bytes(data)) if any(x.strip() for x in r)]
        rows = [[*(r + [""] * len(head))[: len(head)], i] for i, r in enumerate(body, 2)]
        df = spark.createDataFrame(rows, [*head, "row_no"]) if rows else spark.createDataFrame([], ", ".join(f"`{h}` string" for h in head) + ", row_no long")
    elif suffix == ".csv":
        df = restore_formulas(spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path))
        df = numbered(df, "row_no", 2)
    elif suffix in (".jsonl", ".json"):
        df = numbered(spark.read.json(path), "row_no", 1)
    else:
        raise ValueError("saved answers are .xlsx, .csv or .jsonl")
    found = resolve_headers([c for c in df.columns if c != "row_no"], columns)
    out = df.select("row_no", *[(F.col(f"`{found[f]}`").cast("string") if f in found else F.lit(None).cast("string")).alias(f) for f in FIELDS])
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    lacking = F.when(blank("question") | blank("expected_answer"), "missing question or reference answer")
    # of the rows that are whole, the first one of an id counts
    whole = out.where(lacking.isNull() & ~blank("id")).groupBy(F.trim("id").alias("_id")).agg(F.min("row_no").alias("_first"))
    out = out.join(whole, F.trim(out["id"]) == whole["_id"], "left")
    out = out.withColumn("reason", F.coalesce(lacking, F.when(F.col("row_no") > F.col("_first"), "duplicate external question ID"))).drop("_id", "_first")
    if strict:
        bad = out.where("reason IS NOT NULL").select("row_no", "reason")
        if message := fault_message(bad):
            raise ValueError(f"rows that can't be imported: {message}")
    return out.withColumn("import_error", import_error(F.col("answer"), F.col("error")))


def review_rows(questions: DataFrame, language: str = "en") -> DataFrame:
    """A flat view for reviewers: the parent's question beside each variant, lists as lines, headers in English or Hebrew."""
    # The headers of a review file.
    headers = {"id": ("id", "מזהה"), "topic": ("topic", "נושא"), "question": ("question", "שאלה"), "expected_answer": ("expected answer", "תשובה צפויה"), "parent_question": ("parent question", "שאלת אב"), "review_status": ("review status", "סטטוס בדיקה")}
    parent = questions.select(F.col("id").alias("_pid"), F.col("question").alias("parent_question"))
    flat = questions.join(parent, questions["parent_question_id"] == parent["_pid"], "left").drop("_pid")
    flat = flat.select(*[F.array_join(F.transform(c, lambda x: x.cast("string")), "\n").alias(c) if t.startswith("array<string") else F.col(c) for c, t in flat.dtypes])
    return flat.select(*[F.col(c).alias(headers[c][language == "he"]) for c in headers if c in flat.columns])


def write_text(path: str, text: str) -> None:
    """A small driver-side file, replaced in one step."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=target.parent, delete=False) as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, target)
