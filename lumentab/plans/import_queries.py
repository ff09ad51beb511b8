"""Queries of the import operators on raw_results and import_files."""

from __future__ import annotations

from ..functions.headers import ALIASES
from ..operators import row_parse
from ..session import table
from .catalog import core

_BREAK = chr(0xE020)


def failing_sql() -> str:
    """p7_found: each record by the grammar of its delimiter, then cut at its quotes; what stands within them is every other piece."""

    def grammar(d: str) -> str:
        e = {"\t": r"\t", "|": r"\|"}.get(d, d)
        field = f'(?:"[^"]*(?:""[^"]*)*"|[^"{e}]*)'
        return f"{field}(?:{e}{field})*"

    sound = "CASE delimiter " + " ".join(f"WHEN {'chr(9)' if d == chr(9) else chr(39) + d + chr(39)} THEN regexp_full_match(t, '{grammar(d)}')" for d in (",", ";", "|", "\t")) + " END"
    pieces = lambda x: f"string_split({x}, '\"')"
    cells = lambda x: f"string_split(array_to_string(list_transform({pieces(x)}, lambda y, i: CASE WHEN i % 2 = 0 THEN replace(y, delimiter, '{_BREAK}') WHEN y = '' AND i > 1 AND i < len({pieces(x)}) THEN '\"' ELSE y END), ''), delimiter)"
    place = lambda f: "list_position(list_transform(h, lambda x: list_contains([" + ", ".join(f"'{a}'" for a in ALIASES[f]) + "], x)), true)"
    value = lambda f: rf"regexp_replace(coalesce(v[{place(f)}], ''), '^[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+|[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+$', '', 'g')"
    outside = " OR ".join(f"({value(f)} <> '' AND lower({value(f)}) NOT IN ({', '.join(repr(x) for x in domain)}))" for f, domain in row_parse.DOMAINS.items())
    claims = value("reference_claims")
    return rf"""WITH r AS (SELECT DISTINCT raw_id, coalesce(raw_text, '') AS t, delimiter, header_text FROM raw_results JOIN (SELECT file_name, any_value(delimiter) AS delimiter, any_value(header_text) AS header_text FROM import_files GROUP BY 1) USING (file_name)),
    s AS (SELECT *, {sound} AS sound, list_transform({cells('header_text')}, lambda x: trim(regexp_replace(lower(replace(x, '_', ' ')), '\s+', ' ', 'g'))) AS h, {cells('t')} AS c FROM r),
    k AS (SELECT *, CASE WHEN len(c) > len(h) AND len(list_filter(c[len(h) + 1:], lambda x: x <> '')) = 0 THEN c[:len(h)] ELSE c END AS c2 FROM s), g AS (SELECT *, list_transform(c2, lambda x: replace(x, '{_BREAK}', delimiter)) AS v FROM k),
    z AS (SELECT raw_id, CASE WHEN NOT sound THEN 'broken_quoting' WHEN len(v) <> len(h) THEN 'column_count' WHEN {value('question')} = '' OR {value('expected_answer')} = '' OR {outside}
    OR ({claims} <> '' AND NOT coalesce(CASE WHEN json_valid({claims}) THEN json_type({claims}) = 'ARRAY' AND len(list_filter(from_json({claims}, '["JSON"]'), lambda x: json_type(x) <> 'VARCHAR')) = 0 END, false)) THEN 'invalid_value' END AS reason FROM g)
    SELECT DISTINCT raw_id, reason FROM z WHERE reason IS NOT NULL"""


def _parsed(spark, d):
    return row_parse.parse_rows(table(spark, d, "raw_results"), table(spark, d, "import_files"))


@core.query(failing_sql())
def p7_found(spark, d):
    return _parsed(spark, d).where("reason in ('broken_quoting', 'column_count', 'invalid_value')").select("raw_id", "reason").distinct()


@core.query()
def p7_loaded(spark, d):
    """The valid records as rows of the sixteen fields."""
    return _parsed(spark, d).where("reason is null").drop("reason", "detail", "edit_cost", "raw_text")


@core.query()
def p7_errors(spark, d):
    """Counts and errors by file, shaped like the report of an importer."""
    return row_parse.import_errors(_parsed(spark, d))
