"""Rows that fail to parse: they come out apart with the reason, while the valid ones load.

Method: a minimum-cost error parse. A record is read as fields between delimiters; a dynamic program over its quotes,
delimiters and stretches of text finds the cheapest insertions and deletions of quotes and delimiters that make it a record
of as many fields as its header: first the fewest edits that mend quoting, then the fewest others. A record of cost zero whose
values fit their fields loads. Of the others the edits give the reason, the first that holds of

``broken_quoting``  every reading has an edit of a quote, or parts a field at a quote that stands inside it,
``column_count``    delimiters alone are inserted or deleted (empty fields left over at the end don't count),
``invalid_value``   question or expected answer is empty, or a value is outside its domain.

The edits say where: ``insert quote at 12`` counts characters from 0. Records of zero cost are recognised by one regular
expression, so that the program runs over faulty records only.

Null and empty records have one empty field. Records of files without header have the reason ``no_header``. Repeated
records are judged alike, each on its own. Extra columns are kept unless they have the name of a field.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.headers import FIELDS, field_of

# What a non-empty value may be, compared without case.
DOMAINS = {
    "answerable": ("true", "false", "yes", "no", "y", "n", "1", "0"),
    "expected_behavior": ("answer", "clarify", "abstain"),
    "difficulty": ("easy", "medium", "hard"),
    "question_type": ("basic_knowledge", "topic_integration", "document_wide", "cross_document", "personal_basic", "personal_integration", "unanswerable"),
}
NEEDED = ("question", "expected_answer")


@functools.lru_cache(256)
def _grammar(delimiter: str) -> re.Pattern:
    d = re.escape(delimiter)
    plain = rf'[^"{d}]*+' if len(delimiter) == 1 else rf'(?:(?!{d})[^"])*+'
    field = rf'(?:"[^"]*+(?:""[^"]*+)*+"|{plain})'
    return re.compile(rf"{field}(?:{d}{field})*+")


def sound_fields(text: str, delimiter: str) -> list[str] | None:
    """The fields of a record whose quotes are sound, else null."""
    if not _grammar(delimiter).fullmatch(text):
        return None
    if '"' not in text:
        return text.split(delimiter)
    out, start = [], 0
    while True:
        if text[start : start + 1] == '"':
            end = text.index('"', start + 1) + 1
            while text[end : end + 1] == '"':  # a doubled quote
                end = text.index('"', end + 1) + 1
            out.append(text[start + 1 : end - 1].replace('""', '"'))
        else:
            end = text.find(delimiter, start)
            end = len(text) if end < 0 else end
            out.append(text[start:end])
        if end == len(text):
            return out
        start = end + len(delimiter)


START, PLAIN, QUOTED, CLOSED = range(4)


QUOTING = 1 << 20  # what an edit that mends quoting costs; any number of others is cheaper


def cheapest_edits(text: str, delimiter: str, columns: int) -> tuple[int, list[str]]:
    """(cost, edits): the cheapest edits that make text a record of so many fields; QUOTING for each that mends quoting, 1 for
    each other.

    The program's states are the place in a field (its start, in plain text, within quotes, after the closing quote) and the
    fields begun so far, up to columns; stretches without quote or delimiter are one step.
    """
    steps = [(m.start(), m.group()) for m in re.finditer(rf'"|{re.escape(delimiter)}|(?:(?!{re.escape(delimiter)})[^"])+', text, re.S)]
    best: list[dict[tuple[int, int], tuple[int, tuple | None]]] = [{(START, 1): (0, None)}]
    best += [{} for _ in steps]
    columns = max(1, columns)

    def reach(k: int, state: tuple[int, int], cost: int, back: tuple) -> None:
        if state[1] <= columns and cost < best[k].get(state, (1 << 60, None))[0]:
            best[k][state] = (cost, back)

    for k, (at, piece) in enumerate(steps):
        twice = piece == '"' and k + 1 < len(steps) and steps[k + 1][1] == '"'
        for (place, n), (cost, _) in list(best[k].items()):
            here = (k, (place, n))

            def go(to: int, fields: int, more: int = 0, edit: str = "", ahead: int = 1, here=here, cost=cost) -> None:
                reach(here[0] + ahead, (to, fields), cost + more, (here, edit))

            if piece == '"':
                go(place, n, QUOTING, f"delete quote at {at}")
                if place == START:
                    go(QUOTED, n)
                elif place == PLAIN:
                    go(QUOTED, n + 1, QUOTING, f"insert delimiter at {at}")
                elif place == QUOTED:
                    go(CLOSED, n)
                    go(QUOTED, n, QUOTING, f"insert quote at {at}")
                    if twice:
                        go(QUOTED, n, ahead=2)
                else:
                    go(QUOTED, n + 1, QUOTING, f"insert delimiter at {at}")
            elif piece == delimiter:
                if place == QUOTED:
                    go(QUOTED, n)
                    go(START, n + 1, QUOTING, f"insert quote at {at}")
                else:
                    go(START, n + 1)
                    go(START, n, 1, f"delete delimiter at {at}")  # the fields on both sides are one
            elif place == START:
                go(PLAIN, n)
                go(QUOTED, n, QUOTING, f"insert quote at {at}")
            elif place == CLOSED:
                go(PLAIN, n + 1, QUOTING, f"insert delimiter at {at}")
            else:
                go(place, n)
    ends = []
    for (place, n), (cost, _) in best[-1].items():
        tail = [f"insert quote at {len(text)}"] * (place == QUOTED) + [f"insert delimiter at {len(text)}"] * (columns - n)
        ends.append((cost + (QUOTING if place == QUOTED else 0) + columns - n, -n, place, tail))
    if not ends:
        return len(steps), ["no reading"]
    cost, n, place, tail = min(ends)
    edits, k, state = tail[::-1], len(steps), (place, -n)
    while True:
        back = best[k][state][1]
        if back is None:
            return cost, edits[::-1]
        (k, state), edit = back
        if edit:
            edits.append(edit)


def value_fault(values: dict[str, str]) -> str | None:
    """Which field is empty or holds what it may not, in words; null where all fit."""
    for field in NEEDED:
        if not values.get(field, "").strip():
            return f"{field} is empty"
    for field, domain in DOMAINS.items():
        v = values.get(field, "").strip()
        if v and v.lower() not in domain:
            return f"{field} is outside its domain"
    claims = values.get("reference_claims", "").strip()
    if claims:
        try:
            made = json.loads(claims)
        except (ValueError, RecursionError):
            made = None
        if not isinstance(made, list) or not all(isinstance(x, str) for x in made):
            return "reference_claims is no JSON array of strings"
    return None


def parse_record(text: str | None, delimiter: str | None, header: str | None) -> tuple[str | None, str | None, int, dict[str, str]]:
    """(reason, detail, cost, values) of one record."""
    if not delimiter or header is None:
        return "no_header", "the file has no header", 0, {}
    names = sound_fields(header, delimiter) or header.split(delimiter)
    text = text or ""
    fields = sound_fields(text, delimiter)
    while fields and len(fields) > len(names) and fields[-1] == "":
        fields.pop()
    if fields is None or len(fields) != len(names):  # no reading of cost zero
        cost, edits = cheapest_edits(text, delimiter, len(names))
        many, few = divmod(cost, QUOTING)
        reason = "broken_quoting" if many else "column_count"
        told = "; ".join(edits) if many else f"{len(fields or [])} fields for {len(names)} columns: " + "; ".join(edits)
        return reason, told, many + few, {}
    values: dict[str, str] = {}
    for name, value in zip(names, fields):
        field = field_of(name)
        if field and field not in values:
            values[field] = value
    fault = value_fault(values)
    return ("invalid_value", fault, 0, {}) if fault else (None, None, 0, values)


def parse_rows(raw: DataFrame, files: DataFrame, file_name: str = "file_name", raw_text: str = "raw_text") -> DataFrame:
    """raw with reason, detail, edit_cost and the sixteen fields; reason is null and the fields are filled on valid rows."""
    heads = files.select(F.col(file_name).alias("__file"), F.col("delimiter").alias("__delimiter"), F.col("header_text").alias("__header")).dropDuplicates(["__file"])
    own = [c for c in raw.columns if c.lower() not in {*FIELDS, "reason", "detail", "edit_cost"}]
    rows = raw.select(*[F.col(f"`{c}`") for c in own]).withColumn("__file", F.col(f"`{file_name}`")).join(heads, "__file", "left").drop("__file")
    schema = rows.drop("__delimiter", "__header").schema
    out_schema = T.StructType([*schema.fields, T.StructField("reason", T.StringType()), T.StructField("detail", T.StringType()), T.StructField("edit_cost", T.IntegerType()), *[T.StructField(f, T.StringType()) for f in FIELDS]])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            none = lambda s: s.astype(object).where(s.notna(), None)
            made = [parse_record(*x) for x in zip(none(b[raw_text]), none(b["__delimiter"]), none(b["__header"]))]
            out = b.drop(columns=["__delimiter", "__header"])
            more = pd.DataFrame({"reason": [m[0] for m in made], "detail": [m[1] for m in made], "edit_cost": pd.Series([m[2] for m in made], dtype="int32")} | {f: [m[3].get(f) for m in made] for f in FIELDS}, index=out.index)
            yield pd.concat([out, more], axis=1)

    return rows.mapInPandas(parse, out_schema)


def import_errors(parsed: DataFrame, block: int = 10_000) -> DataFrame:
    """(file_name, part, total, accepted, skipped, errors) shaped like the importer's own report.

    The errors of a file stand in parts of block row numbers each, so that no array grows with the file.
    """
    part = F.floor(F.col("row_no") / block).cast("int")
    err = F.when(F.col("reason").isNotNull(), F.struct(F.col("row_no").cast("int").alias("row"), F.concat_ws(": ", "reason", "detail").alias("reason")))
    return parsed.groupBy("file_name", part.alias("part")).agg(
        F.count("*").alias("total"), F.count_if(F.col("reason").isNull()).alias("accepted"), F.count("reason").alias("skipped"), F.array_sort(F.collect_list(err)).alias("errors")
    )
