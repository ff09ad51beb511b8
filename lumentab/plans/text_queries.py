"""Text, chunk, evidence and retrieval queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, evidence, retrieval, validation
from ..session import table
from .catalog import core

W = r"[\p{L}\p{N}_]+"
# RE2 has no lookaround: terminators beside a digit are set aside under private code points first


def protect(c: str) -> str:
    for i, mark in enumerate(".!?;"):
        stand = chr(0xE000 + i)
        c = f"regexp_replace(regexp_replace({c}, '([0-9])[{mark}]', '\\1{stand}', 'g'), '[{mark}]([0-9])', '{stand}\\1', 'g')"
    return c


RESTORE = "translate({0}, '" + "".join(chr(0xE000 + i) for i in range(4)) + "', '.!?;')"


BL = r"[ \t\n\x0B\f\r]"
FLAT = "trim(regexp_replace({0}, '[ \\t\\n\\x0B\\f\\r\\x1C-\\x1F\\x85\\xA0\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'), ' ')"
PUA = "".join(chr(0xE000 + i) for i in range(4))


@core.query(
    rf"""WITH p AS (SELECT doc_id, text, unnest(regexp_split_to_array({protect('text')}, '[.!?;]|\n+')) AS x FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, {FLAT.format("regexp_replace(" + RESTORE.format('x') + ", '^" + BL + "*(?:[-*•·]|[0-9]+[.)]|[א-ת][.)])" + BL + "*', '')")} AS claim FROM p)
    SELECT DISTINCT doc_id, claim FROM c WHERE regexp_matches(claim, '[\p{{L}}\p{{N}}]')"""
)
def derived_claims(spark, d):
    """Distinct statements of each text."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.explode(X.derived_claims(F.col("text"))).alias("claim")).where(F.col("claim").rlike(r"[\p{L}\p{N}]"))


def units_sql(text: str = "text") -> str:
    """The parts of a text between the ends of statements; a digit's full stop is set aside, and so is looked for by its stand-in."""
    plain = f"regexp_replace({text}, '\\*\\*|__|`|#{{1,6}}[ \\t\\n\\r\\f]', ' ', 'g')"
    return f"regexp_split_to_array({protect(plain)}, '[.!?;]|\\n+|[ \\t\\n\\r\\f][-–•▪][ \\t\\n\\r\\f]|[ \\t\\n\\r\\f][0-9]+[{chr(0xE000)}.)][ \\t\\n\\r\\f]|\\|')"


@core.query(
    rf"""WITH p AS (SELECT doc_id, unnest({units_sql()}) AS x FROM documents WHERE text IS NOT NULL),
    w AS (SELECT doc_id, regexp_extract_all(replace(lower({RESTORE.format('x')}), 'ß', 'ss'), '{W}') AS w FROM p),
    n AS (SELECT doc_id, count(DISTINCT array_to_string(w, ' ')) AS units FROM w WHERE len(w) >= 4 GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN {FLAT.format('d.text')} = '' THEN 0 ELSE greatest(coalesce(n.units, 0), 1) END AS units FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id WHERE d.text IS NOT NULL"""
)
def information_units(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.information_units(F.col("text")).cast("bigint").alias("units"))


@core.query(
    rf"""WITH p AS (SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS x FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '([.!?;:])', '\1{chr(0xE010)}', 'g'), '{chr(0xE010)}|\n+') AS s FROM documents WHERE text IS NOT NULL)),
    g AS (SELECT doc_id, trim(x) AS sentence, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos FROM p WHERE len(regexp_extract_all(lower(x), '{W}')) >= 3 AND regexp_matches(x, '[0-9]|"[^"]+"|“[^”]+”|«[^»]+»'))
    SELECT doc_id, pos, sentence FROM g WHERE pos <= 8"""
)
def specific_sentences(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    rows = docs.select("doc_id", F.posexplode(X.specific_sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "sentence")


@core.query("SELECT doc_id, s AS start, substr(text, s::int + 1, 800) AS piece FROM documents, generate_series(0, greatest(length(text), 1) - 1, 700) g(s) WHERE text IS NOT NULL AND length(text) > 0")
def chunk_windows(spark, d):
    return chunking.window_chunks(table(spark, d, "documents"), "doc_id", "text", 800, 100)


@core.query()
def chunk_pack(spark, d):
    """Structured chunks of every document; sequential packing, checked by its invariants on fixtures."""
    docs = table(spark, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file"), "text")
    return chunking.chunk_documents(docs)


@core.query(
    """SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 128) || ' [...] ' || right(text, 65) END AS text,
    'D' || substr(sha256(text), 1, 16) AS content_id FROM documents WHERE text IS NOT NULL"""
)
def mid_truncate(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", X.middle_cut(F.col("text"), 200).alias("text"), X.content_id("D", F.col("text")).alias("content_id"))


@core.query(
    """SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('7:' || doc_id), doc_id) AS turn FROM documents WHERE source IS NOT NULL"""
)
def round_robin(spark, d):
    """The order in which sources take turns, each in its own seeded order."""
    docs = table(spark, d, "documents").where("source IS NOT NULL")
    w = Window.partitionBy("source").orderBy(X.seeded(7, F.col("doc_id")), "doc_id")
    return docs.select("source", "doc_id", F.row_number().over(w).cast("bigint").alias("turn"))


@core.query(
    """WITH r AS (SELECT file, chunk_no, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY file ORDER BY chunk_no, ingested_at NULLS FIRST, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM chunks WHERE text IS NOT NULL)
    SELECT file, chunk_no, length(CASE WHEN before + length(text) <= 6000 THEN text ELSE substr(text, 1, (6000 - before)::int) || ' [truncated]' END) AS n_chars FROM r WHERE before < 6000"""
)
def budget_prefix(spark, d):
    """The chunks of a file in order while they fit; the first that does not is cut to the room left."""
    chunks = table(spark, d, "chunks").where("text IS NOT NULL")
    return evidence.budget_prefix(chunks, "file", ["chunk_no", "ingested_at", "chunk_id"], "text", 6000).select("file", "chunk_no", F.length("text").cast("bigint").alias("n_chars"))


@core.query(
    """SELECT q.quote_id, CASE WHEN q.source_id IS NULL OR trim(q.source_id) = '' THEN 'no_source' WHEN c.chunk_id IS NULL THEN 'unknown_source' WHEN q.quote IS NULL OR trim(q.quote) = '' THEN 'blank_quote'
    WHEN contains(c.text, q.quote) THEN 'verbatim' WHEN contains(lower(regexp_replace(c.text, '[ \t\n]+', ' ', 'g')), lower(regexp_replace(trim(q.quote), '[ \t\n]+', ' ', 'g'))) THEN 'normalized' ELSE 'not_found' END AS status
    FROM (SELECT DISTINCT quote_id, source_id, quote FROM evidence_quotes) q LEFT JOIN (SELECT DISTINCT chunk_id, text FROM chunks) c ON q.source_id = c.chunk_id"""
)
def quote_contains(spark, d):
    return evidence.quote_status(table(spark, d, "evidence_quotes"), table(spark, d, "chunks"))


# compatibility forms of the characters that the tables have: full-width forms, two ligatures, accents apart from their letters
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_QUOTES = "'[\"''׳״‘’“”`]|[\u0591-\u05C7]'"


def nfk(x: str) -> str:
    return f"nfc_normalize(replace(replace(replace(translate({x}, '{_WIDE}', '{_NARROW}'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '…', '...'))"


def ss(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def plain_quote_sql(x: str) -> str:
    t = f"translate({nfk(x)}, '״“”„׳‘’־', '" + '"' * 4 + "' || chr(39) || chr(39) || chr(39) || '-')"
    t = rf"regexp_replace({t}, '\*\*|__|~~|`|[\x{{200b}}-\x{{200f}}\x{{202a}}-\x{{202e}}\x{{2066}}-\x{{2069}}\x{{feff}}]', '', 'g')"
    t = rf"regexp_replace({t}, '(^|\s)#{{1,6}}(\s)', '\1\2', 'g')"
    return ss(FLAT.format("@").replace("@", f"regexp_replace({t}, '[֑-ׇ]', '', 'g')"))


@core.query(
    f"""WITH r AS (SELECT result_no, max(question) AS question, max(expected_answer) AS expected_answer, max(answerable) AS answerable, max(question_type) AS question_type, max(reference_claims) AS reference_claims, max(supporting_quotes) AS supporting_quotes, max(reference_sources) AS reference_sources FROM results GROUP BY result_no),
    c AS (SELECT result_no AS id, question, expected_answer, coalesce(lower(trim(answerable)) NOT IN ('false', '0', 'no', 'n'), true) AS answerable, coalesce(question_type, '') AS kind,
    list_filter(string_split(coalesce(reference_sources, ''), ';'), lambda x: trim(x) <> '') AS s0, CASE WHEN json_valid(reference_claims) AND json_type(reference_claims) = 'ARRAY' THEN list_filter(list_transform(from_json(reference_claims, '["VARCHAR"]'), lambda x: trim(x)), lambda x: x <> '') ELSE [] END AS said,
    CASE WHEN json_valid(supporting_quotes) AND json_type(supporting_quotes) = 'ARRAY' THEN from_json(supporting_quotes, '[{{"source_id": "VARCHAR", "quote": "VARCHAR"}}]') ELSE [] END AS quotes FROM r),
    k AS (SELECT * REPLACE (list_transform(s0, lambda x: trim(x)) AS s0) FROM c), t AS (SELECT chunk_id, any_value(file) AS file, any_value(text) AS text FROM chunks GROUP BY 1),
    ci AS (SELECT id, count(*) FILTER (t.chunk_id IS NULL) AS unknown, count(DISTINCT file) AS files FROM (SELECT DISTINCT id, unnest(s0) AS s FROM k) LEFT JOIN t ON s = t.chunk_id GROUP BY 1),
    qu AS (SELECT id, s0, generate_subscripts(quotes, 1) AS pos, unnest(quotes) AS q FROM k),
    qf AS (SELECT id, pos, q.source_id AS s, CASE WHEN NOT list_contains(s0, q.source_id) OR t.text IS NULL THEN 'quote_source_mismatch' WHEN NOT coalesce(length({plain_quote_sql('q.quote')}) >= 3 AND contains({plain_quote_sql('t.text')}, {plain_quote_sql('q.quote')}), false) THEN 'quote_not_verbatim' END AS fault FROM qu LEFT JOIN t ON q.source_id = t.chunk_id),
    qg AS (SELECT id, min_by(fault, pos) FILTER (fault IS NOT NULL) AS fault, list(DISTINCT s) AS quoted FROM qf GROUP BY 1)
    SELECT k.id AS candidate_id, CASE WHEN coalesce(trim(question), '') = '' THEN 'blank_question' WHEN coalesce(trim(expected_answer), '') = '' THEN 'blank_expected_answer' WHEN len(s0) <> len(list_distinct(s0)) THEN 'duplicate_source_ids'
    WHEN coalesce(unknown, 0) > 0 THEN 'unknown_source_id' WHEN NOT answerable THEN CASE WHEN kind <> 'unanswerable' THEN 'invalid_unanswerable_type' WHEN len(s0) = 0 THEN 'missing_source_ids' WHEN len(said) > 0 THEN 'unanswerable_has_reference_claims' WHEN len(quotes) > 0 THEN 'unanswerable_has_supporting_quotes' END
    WHEN kind IN ('personal_basic', 'personal_integration', 'unanswerable') THEN 'unsupported_question_type' WHEN len(s0) = 0 OR len(quotes) = 0 THEN 'missing_evidence' WHEN len(said) = 0 THEN 'missing_reference_claims' WHEN len(said) <> len(list_distinct(said)) THEN 'duplicate_reference_claims'
    WHEN fault IS NOT NULL THEN fault WHEN len(list_filter(s0, lambda x: NOT list_contains(quoted, x))) > 0 THEN 'source_without_quote' WHEN kind = 'document_wide' AND (len(s0) < 2 OR files <> 1) THEN 'invalid_document_wide_evidence' WHEN kind = 'cross_document' AND files < 2 THEN 'invalid_cross_document_evidence' END AS reason
    FROM k LEFT JOIN ci ON k.id = ci.id LEFT JOIN qg ON k.id = qg.id"""
)
def candidate_grounding(spark, d):
    """The results as candidate questions: why each isn't grounded in the chunks."""
    names = ("question", "expected_answer", "answerable", "question_type", "reference_claims", "supporting_quotes", "reference_sources")
    rows = table(spark, d, "results").groupBy(F.col("result_no").alias("candidate_id")).agg(*[F.max(c).alias(c) for c in names])
    listed = lambda c, kind: F.when(F.json_array_length(c).isNotNull(), F.from_json(c, kind))
    c = rows.select(
        "candidate_id", "question", "expected_answer", F.coalesce(~F.lower(F.trim("answerable")).isin(*validation.FALSE), F.lit(True)).alias("answerable"), "question_type",
        F.filter(F.transform(F.split(F.coalesce("reference_sources", F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "").alias("source_ids"),
        listed("reference_claims", "array<string>").alias("claims"), listed("supporting_quotes", "array<struct<source_id: string, quote: string>>").alias("quotes"),
    )
    return evidence.candidate_grounding(c, table(spark, d, "chunks"))


@core.query(
    f"""WITH e AS (SELECT result_no, coalesce({FLAT.format('error')}, '') AS e, coalesce({FLAT.format('answer')}, '') AS a FROM results)
    SELECT result_no, CASE WHEN e <> '' THEN 'stored_error: ' || substr(e, 1, 240) || CASE WHEN length(e) > 240 THEN '…' ELSE '' END WHEN a = '' THEN '{validation.EMPTY_ERROR}' WHEN a = '{validation.PLACEHOLDER}' THEN '{validation.PLACEHOLDER_ERROR}'
    WHEN contains(lower(a), 'spike arrest violation') THEN '{validation.THROTTLED_ERROR}' WHEN (starts_with(a, '{{') OR starts_with(a, '[')) AND (contains(lower(a), chr(39) || 'fault' || chr(39)) OR contains(lower(a), '"fault"') OR contains(lower(a), 'errorcode') OR contains(lower(a), 'faultstring')) THEN '{validation.FAULT_ERROR}' ELSE '' END AS reason FROM e"""
)
def import_errors(spark, d):
    return table(spark, d, "results").select("result_no", validation.import_error(F.col("answer"), F.col("error")).alias("reason"))


_TV = "lower(trim({0})) NOT IN ('true', '1', 'yes', 'y', 'false', '0', 'no', 'n')"


@core.query(
    f"""WITH r AS (SELECT result_no, id, question, expected_answer, nullif(trim(answerable), '') AS a, lower(nullif(trim(expected_behavior), '')) AS b, lower(nullif(trim(question_form), '')) AS f, nullif(trim(reference_claims), '') AS rc, nullif(trim(supporting_quotes), '') AS sq FROM results),
    n AS (SELECT *, CASE WHEN {_TV.format('a')} THEN 'answerable is no truth value' WHEN rc IS NOT NULL AND NOT (json_valid(rc) AND json_type(rc) = 'ARRAY') THEN 'reference_claims is no JSON array' WHEN sq IS NOT NULL AND NOT (json_valid(sq) AND json_type(sq) = 'ARRAY') THEN 'supporting_quotes is no JSON array' END AS pf,
    coalesce(CASE WHEN lower(a) IN ('true', '1', 'yes', 'y') THEN true WHEN lower(a) IN ('false', '0', 'no', 'n') THEN false END, b IS NULL OR b <> 'abstain') AS ans, CASE WHEN json_valid(rc) AND json_type(rc) = 'ARRAY' THEN json_array_length(rc) ELSE 0 END AS held FROM r),
    m AS (SELECT *, coalesce(b, CASE WHEN ans THEN 'answer' ELSE 'abstain' END) AS beh FROM n), v AS (SELECT *, coalesce(f, CASE WHEN beh = 'clarify' THEN 'ambiguous' ELSE 'canonical' END) AS form FROM m),
    x AS (SELECT result_no, unnest([pf, CASE WHEN coalesce(trim(id), '') = '' THEN 'blank_id' END, CASE WHEN coalesce(trim(question), '') = '' THEN 'blank_question' END, CASE WHEN coalesce(trim(expected_answer), '') = '' THEN 'blank_expected_answer' END,
    CASE WHEN form = 'broad' AND beh <> 'answer' THEN 'broad_without_answer' END, CASE WHEN beh = 'answer' AND NOT ans THEN 'answer_not_answerable' END, CASE WHEN beh = 'clarify' AND (NOT ans OR form <> 'ambiguous') THEN 'clarify_not_ambiguous' END, CASE WHEN beh = 'clarify' AND held > 0 THEN 'clarify_with_claims' END,
    CASE WHEN beh = 'abstain' AND ans THEN 'abstain_answerable' END, CASE WHEN beh = 'abstain' AND held > 0 THEN 'abstain_with_claims' END]) AS fault FROM v)
    SELECT result_no::varchar AS record, fault FROM x WHERE fault IS NOT NULL UNION ALL SELECT id, 'duplicate_id' FROM (SELECT id FROM results WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)"""
)
def question_set_faults(spark, d):
    """The results as a question set: every rule that a record breaks, and the ids that stand twice."""
    rows = validation.normalized_payload(table(spark, d, "results"))
    named = rows.withColumn("record", F.col("result_no").cast("string"))
    own = validation.question_set_faults(named.withColumn("_blank_id", F.trim(F.coalesce("id", F.lit(""))) == ""), "record").where("fault <> 'duplicate_id'")
    blank = named.where(F.trim(F.coalesce("id", F.lit(""))) == "").select("record", F.lit("blank_id").alias("fault"))
    again = validation.duplicate_ids(rows, "id").select(F.col("id").alias("record"), F.lit("duplicate_id").alias("fault"))
    return own.unionByName(blank).unionByName(again)


@core.query("SELECT id, count(*) AS n FROM results WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return validation.duplicate_ids(table(spark, d, "results"), "id")


@core.query(
    """SELECT result_no, CASE WHEN lower(trim(answerable)) IN ('true', '1', 'yes', 'y') THEN true WHEN lower(trim(answerable)) IN ('false', '0', 'no', 'n') THEN false WHEN coalesce(trim(answerable), '') = '' THEN true END AS answerable,
    coalesce(trim(answerable), '') <> '' AND lower(trim(answerable)) NOT IN ('true', '1', 'yes', 'y', 'false', '0', 'no', 'n') AS fault FROM results"""
)
def strict_booleans(spark, d):
    c = F.col("answerable")
    return table(spark, d, "results").select("result_no", validation.strict_boolean(c, True).alias("answerable"), validation.boolean_fault(c).alias("fault"))


# words in the form of names, and what they may be without attached letters
_P = "[והבלכמש]"


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all({ss(f'regexp_replace({x}, {_QUOTES}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')}, " + r"'[\p{L}\p{N}_\x{0590}-\x{05FF}]+')"


def _bare(mark: str) -> str:
    return f"CASE WHEN regexp_matches(t, '^{_P}{{2}}.{{3,}}$') THEN [{mark}substr(t, 2), {mark}substr(t, 3)] WHEN regexp_matches(t, '^{_P}.{{3,}}$') THEN [{mark}substr(t, 2)] ELSE []::varchar[] END"


def doc_terms(x: str) -> str:
    return f"flatten(list_transform({tokens_sql(x)}, lambda t: list_concat([t], {_bare(chr(39) + '~' + chr(39) + ' || ')})))"


def ask_terms(x: str) -> str:
    return f"flatten(list_transform({tokens_sql(x)}, lambda t: list_concat([t, '~' || t], {_bare('')})))"


@core.query(f"""SELECT term, count(*) AS df, sum(tf)::bigint AS cf FROM (SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest({doc_terms('text')}) AS t FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2) GROUP BY 1""")
def term_stats(spark, d):
    """How many documents have a term, and how often it stands in them; Hebrew words also without attached letters."""
    return retrieval.term_stats(retrieval.postings(table(spark, d, "documents"), "doc_id", "text"))


def bm25_sql(doc: str, text: str, source: str, ask: str, asked: str) -> str:
    """p, dl, s, f, q, sc: postings, lengths, size, frequencies, queries and scores; asked gives (query, qt)."""
    return f"""p AS (SELECT doc, t AS term, count(*) AS tf, any_value(n) AS length FROM (SELECT doc, len(w) AS n, unnest(w) AS t FROM (SELECT {doc} AS doc, {doc_terms(text)} AS w FROM {source})) GROUP BY 1, 2),
    dl AS (SELECT doc, any_value(length) AS length FROM p GROUP BY 1), s AS (SELECT count(*)::double AS n, avg(length) AS average FROM dl), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
    q AS (SELECT DISTINCT query, unnest({ask_terms(ask)}) AS term FROM ({asked})),
    sc AS (SELECT query, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / average))), 6) AS score FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY 1, 2)"""


@core.query(
    "WITH " + bm25_sql("chunk_id", nfk("text"), "(SELECT DISTINCT chunk_id, text FROM chunks WHERE text IS NOT NULL)", nfk("qt"), "SELECT DISTINCT quote_id AS query, quote AS qt FROM evidence_quotes WHERE quote_id % 20 = 0 AND quote IS NOT NULL")
    + ", r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc) SELECT query, doc, score, rank FROM r WHERE rank <= 10"
)
def bm25_topk(spark, d):
    """Every twentieth quote as a query against all chunks; words meet also where one has letters attached."""
    chunks = table(spark, d, "chunks").where("text IS NOT NULL").select("chunk_id", "text").distinct()
    quotes = table(spark, d, "evidence_quotes").where("quote_id % 20 = 0").select("quote_id", "quote").distinct()
    return retrieval.bm25_top_k(chunks, "chunk_id", "text", quotes, "quote_id", "quote").withColumn("rank", F.col("rank").cast("bigint"))


DENSE_SQL = "dn AS (SELECT a.vec_id AS query, b.vec_id AS doc, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)"


@core.query(f"WITH {DENSE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM dn) SELECT * FROM r WHERE rank <= 10")
def dense_topk(spark, d):
    """Every twentieth vector as a query against all vectors."""
    e = table(spark, d, "embeddings")
    return retrieval.dense_top_k(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding").withColumn("rank", F.col("rank").cast("bigint"))


@core.query(
    "WITH " + bm25_sql("doc_id", "text", "(SELECT doc_id, text FROM documents JOIN embeddings ON doc_id = vec_id WHERE text IS NOT NULL)", "qt", "SELECT doc_id AS query, text AS qt FROM documents JOIN embeddings ON doc_id = vec_id WHERE doc_id % 20 = 0 AND text IS NOT NULL")
    + f", {DENSE_SQL}, l AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc UNION ALL SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) FROM dn),"
    " fu AS (SELECT query, doc, round(sum(1.0 / (60 + rank)), 9) AS score FROM l WHERE rank <= 1000 GROUP BY 1, 2), z AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM fu) SELECT * FROM z WHERE rank <= 10"
)
def rrf_fusion(spark, d):
    """Lexical and dense ranks of the documents that have a vector, fused; every twentieth one is a query."""
    e = table(spark, d, "embeddings")
    return fused(table(spark, d, "documents").join(e.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi"), e)


@core.query()
def rrf_fusion_all(spark, d):
    """The same over all documents, with a vector or without; checked on a fixture."""
    return fused(table(spark, d, "documents"), table(spark, d, "embeddings"))


def fused(docs, e, depth: int = 1000, best: int = 10):
    """(query, doc, score, rank): the ten best by lexical rank among docs and dense rank among the vectors e.

    Every document and vector is ranked; a rank beyond depth, which would add less than 1 / (60 + depth), adds nothing. A query
    without a vector has no dense ranks: its best are the first ones of its lexical ranks, and no others are needed.
    """
    dense_too = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("_dense")).distinct()
    asked = docs.where("doc_id % 20 = 0").join(dense_too, "doc_id", "left")
    lexical = retrieval.bm25_top_k(docs, "doc_id", "text", asked, "doc_id", "text", F.when(F.col("_dense"), depth).otherwise(best))
    dense = retrieval.dense_top_k(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", depth)
    return retrieval.fuse([lexical, dense], best).withColumn("rank", F.col("rank").cast("bigint"))


@core.query("SELECT min(doc_id) AS class_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark, d):
    return retrieval.exact_duplicates(table(spark, d, "documents"))


def near_sql(rows: str, key: str, text: str) -> str:
    """w, s, c, x, p and the pairs: five-word shingles of each text, classes of equal sets, and what two of them share."""
    return rf"""WITH w AS (SELECT {key} AS k, regexp_extract_all(lower({text}), '{W}') AS w FROM {rows} WHERE {text} IS NOT NULL),
    s AS (SELECT k, list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN generate_series(1, greatest(len(w) - 4, 1))])) AS s FROM w WHERE len(w) > 0),
    c AS (SELECT min(k) AS id, s, len(s) AS n FROM s GROUP BY s), x AS (SELECT id, n, unnest(s) AS t FROM c),
    p AS (SELECT a.id AS key_a, b.id AS key_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM x a JOIN x b ON a.t = b.t AND a.id < b.id AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n GROUP BY 1, 2)
    SELECT key_a, key_b, round(k::double / (na + nb - k), 6) AS similarity FROM p WHERE k::double / (na + nb - k) >= 0.8"""


@core.query(near_sql("documents", "doc_id", "text"))
def near_duplicates(spark, d):
    """Pairs of different texts of which four fifths of the five-word shingles are shared; the test documents have none."""
    return retrieval.near_duplicates(table(spark, d, "documents"))


@core.query(near_sql("results", "result_no", "expected_answer"))
def near_duplicate_answers(spark, d):
    """The same of the expected answers, which have some."""
    return retrieval.near_duplicates(table(spark, d, "results"), "result_no", "expected_answer")


def greedy_sql() -> str:
    """The texts of near_duplicate_answers one after the other: each is dropped that is like an earlier one not dropped."""
    near = near_sql("results", "result_no", "expected_answer")
    head = near[: near.rindex("SELECT key_a")].replace("WITH ", "WITH RECURSIVE ", 1)
    return f"""{head}, pr AS (SELECT key_a, key_b FROM p WHERE k::double / (na + nb - k) >= 0.8), nb AS (SELECT *, row_number() OVER (ORDER BY node) AS i FROM (SELECT key_b AS node, list(key_a) AS earlier FROM pr GROUP BY 1)),
    g AS (SELECT 0::bigint AS i, []::bigint[] AS gone UNION ALL SELECT nb.i, CASE WHEN len(list_filter(earlier, lambda e: NOT list_contains(gone, e))) > 0 THEN list_append(gone, node) ELSE gone END FROM g JOIN nb ON nb.i = g.i + 1)
    SELECT id AS result_no FROM c WHERE NOT list_contains((SELECT gone FROM g ORDER BY i DESC LIMIT 1), id)"""


@core.query(greedy_sql())
def greedy_dedup(spark, d):
    """Expected answers that stay when each is dropped that is like an earlier one that stays."""
    rows = table(spark, d, "results")
    firsts = retrieval.first_copies(retrieval.shingle_sets(rows, "result_no", "expected_answer"))
    pairs = retrieval.near_pairs(rows, "result_no", "expected_answer", firsts).select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    return retrieval.greedy_kept(firsts.select(F.col("id").alias("result_no")), pairs, "result_no").select("result_no")


@core.query("SELECT doc_id, sha256(doc_id || chr(0) || coalesce(text, '')) AS digest FROM documents")
def record_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("\0"), F.coalesce("text", F.lit(""))), 256).alias("digest"))


_CANON = f"trim(regexp_replace({ss(f'regexp_replace(entity, {_QUOTES}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')}, " + r"'[^\p{L}\p{N}_\x{0590}-\x{05FF}]+', ' ', 'g'))"


@core.query(
    f"""WITH e AS (SELECT DISTINCT node_id, entity, {_CANON} AS c FROM (SELECT node_id, unnest(entities) AS entity FROM graph_nodes) WHERE entity IS NOT NULL),
    f AS (SELECT *, split_part(c, ' ', 1) AS t, regexp_matches(entity, {_QUOTES.split('|')[0]}') OR contains(c, ' ') AS loose FROM e), g AS (SELECT *, CASE WHEN loose AND length(t) >= 4 AND regexp_matches(t, '^[והבלכמש]') THEN substr(t, 2) END AS one FROM f),
    h AS (SELECT *, CASE WHEN length(one) >= 4 AND regexp_matches(one, '^[והבלכמש]') THEN substr(one, 2) ELSE one END AS two FROM g)
    SELECT node_id, entity, c AS canonical, CASE WHEN c = '' THEN '' ELSE array_to_string(list_sort(list_distinct(list_filter([c, two || substr(c, length(t) + 1)], lambda x: x IS NOT NULL))), '|') END AS match_keys FROM h"""
)
def canonical_entities(spark, d):
    """Names of the nodes' entities in one form, and the keys under which they are met; the compatibility forms that SQL lacks are
    the texts themselves here, and checked on literals."""
    rows = table(spark, d, "graph_nodes").select("node_id", F.explode("entities").alias("entity")).where("entity IS NOT NULL").distinct()
    return rows.select("node_id", "entity", X.plain_name("entity").alias("canonical"), F.array_join(F.array_sort(X.name_keys("entity")), "|").alias("match_keys"))
