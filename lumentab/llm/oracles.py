"""SQL by brute force for the queries of this subpackage that SQL can express, on whole tables."""

from __future__ import annotations

from .lookalike import APOSTROPHES, HEBREW, HYPHENS, LOOKALIKES

_TRIM = r"trim({0}, E' \n\r\t\f\v')"
_MARK = chr(0xE000)


def oversized() -> str:
    """p2_found: the parts of each text at each level, and the first level at which all are within the limit."""
    paragraphs = r"regexp_split_to_array(text, '\n[ \t\r\f\v]*\n\s*')"
    sentences = rf"regexp_split_to_array(regexp_replace(x, '([.?!])\s+', '\1{_MARK}', 'g'), '{_MARK}')"
    longest = lambda parts: f"list_max(list_transform({parts}, lambda y: length({_TRIM.format('y')})))"
    return rf"""WITH c AS (SELECT DISTINCT chunk_id, file, text FROM chunks WHERE text IS NOT NULL), l AS (SELECT lower(trim(suffix)) AS s, any_value(max_chars) AS m FROM split_limits GROUP BY 1),
    o AS (SELECT chunk_id, m, text, {paragraphs} AS p FROM c JOIN l ON lower(regexp_extract(file, '\.([^./\\]+)$', 1)) = s WHERE m >= 1 AND length(text) > m)
    SELECT DISTINCT chunk_id, CASE WHEN {longest('p')} <= m THEN 'paragraph' WHEN {longest(f'flatten(list_transform(p, lambda x: {sentences}))')} <= m THEN 'sentence' WHEN {longest("regexp_split_to_array(text, chr(92) || 's+')")} <= m THEN 'word' ELSE 'none' END AS boundary FROM o"""


def _sets(table: str, key: str, column: str) -> str:
    clean = rf"list_filter(list_transform({column}, lambda x: trim(regexp_replace(lower(x), '\s+', ' ', 'g'))), lambda x: x IS NOT NULL AND x <> '')"
    return f"SELECT '{column}' AS field, k, list_sort(list_distinct(v)) AS s FROM (SELECT {key} AS k, {clean} AS v FROM {table} WHERE {key} IS NOT NULL) WHERE len(list_distinct(v)) >= 5"


def similar_sets() -> str:
    """p3_found: all pairs of sets with a common value, and how many they have in common."""
    return f"""WITH r AS (SELECT DISTINCT * FROM ({_sets('graph_nodes', 'node_id', 'entities')} UNION ALL {_sets('graph_nodes', 'node_id', 'keyphrases')} UNION ALL {_sets('graph_edges', 'edge_id', 'shared')})),
    x AS (SELECT field, k, s, len(s) AS n, unnest(s) AS t FROM r), p AS (SELECT a.field, a.k AS ka, b.k AS kb, a.n AS na, b.n AS nb, count(*) AS c FROM x a JOIN x b ON a.field = b.field AND a.t = b.t AND a.k < b.k GROUP BY a.field, a.k, a.s, b.k, b.s, a.n, b.n)
    SELECT DISTINCT field, ka AS key_a, kb AS key_b FROM p WHERE c >= 0.6 * (na + nb - c) - 1e-9"""


_ALL_SETS = " UNION ALL ".join((_sets("graph_nodes", "node_id", "entities"), _sets("graph_nodes", "node_id", "keyphrases"), _sets("graph_edges", "edge_id", "shared")))
_CLASSES = f"r AS (SELECT DISTINCT * FROM ({_ALL_SETS})), c AS (SELECT field, s, len(s) AS n, min(k) AS rep, count(DISTINCT k) AS copies FROM r GROUP BY 1, 2)"


def set_members() -> str:
    """p3_members: each record beside the least key with its set."""
    return f"WITH {_CLASSES} SELECT r.field, k AS key, rep, copies FROM r JOIN c ON r.field = c.field AND r.s = c.s"


def set_classes() -> str:
    """p3_classes: all pairs of distinct sets with a common value, by their least keys, the lower one first."""
    return f"""WITH {_CLASSES}, x AS (SELECT *, unnest(s) AS t FROM c), p AS (SELECT a.field, a.rep AS ra, b.rep AS rb, a.n AS na, b.n AS nb, count(*) AS c FROM x a JOIN x b ON a.field = b.field AND a.t = b.t AND a.s < b.s GROUP BY a.field, a.rep, b.rep, a.n, b.n, a.s, b.s)
    SELECT field, CASE WHEN (ra, na) > (rb, nb) THEN rb ELSE ra END AS rep_a, CASE WHEN (ra, na) > (rb, nb) THEN ra ELSE rb END AS rep_b, c AS overlap, CASE WHEN (ra, na) > (rb, nb) THEN nb ELSE na END AS size_a, CASE WHEN (ra, na) > (rb, nb) THEN na ELSE nb END AS size_b
    FROM p WHERE c >= 0.6 * (na + nb - c) - 1e-9"""


def sets_between() -> str:
    """p3_between: all pairs of a set of entities and one of shared values with a common value."""
    side = lambda name, source: f"{name} AS (SELECT s, len(s) AS n, min(k) AS rep, unnest(s) AS t FROM ({source}) GROUP BY s)"
    return f"""WITH {side('a', _sets('graph_nodes', 'node_id', 'entities'))}, {side('b', _sets('graph_edges', 'edge_id', 'shared'))}, p AS (SELECT a.rep AS rep_a, b.rep AS rep_b, count(*) AS overlap, a.n AS size_a, b.n AS size_b FROM a JOIN b USING (t) GROUP BY a.s, b.s, a.rep, b.rep, a.n, b.n)
    SELECT * FROM p WHERE overlap >= 0.6 * (size_a + size_b - overlap) - 1e-9"""


_WORDS = r"w AS (SELECT DISTINCT result_no AS k, list_sort(list_distinct(regexp_extract_all(lower(question || ' ' || expected_answer), '[\p{L}\p{N}]+'))) AS s FROM results WHERE question <> '' AND expected_answer <> '' AND result_no IS NOT NULL)"


def _likely(source: str) -> str:
    """x, df, o, f: of the rows (k, s) of source the rarest words, as many as two like sets must share one of."""
    return f"""x AS (SELECT k, s, len(s) AS n, unnest(s) AS t FROM {source} WHERE len(s) > 0), df AS (SELECT t, count(*) AS df FROM x GROUP BY 1), o AS (SELECT k, n, s, x.t, row_number() OVER (PARTITION BY k, s ORDER BY df, x.t) AS pos FROM x JOIN df ON x.t = df.t),
    f AS (SELECT * FROM o WHERE pos <= n - ceil(0.8 * n - 1e-9) + 1)"""


_LIKE = "len(list_intersect(sa, sb)) >= 0.8 * (len(sa) + len(sb) - len(list_intersect(sa, sb))) - 1e-9"


def near_duplicates() -> str:
    """p4_found: pairs with a common word among their rarest ones, compared whole."""
    return f"""WITH {_WORDS}, {_likely('w')}, c AS (SELECT DISTINCT a.k AS ka, b.k AS kb, a.s AS sa, b.s AS sb FROM f a JOIN f b ON a.t = b.t AND a.k < b.k)
    SELECT DISTINCT ka AS result_a, kb AS result_b FROM c WHERE {_LIKE}"""


def near_duplicate_groups() -> str:
    """p4_groups: classes of equal word sets, and how many other classes each is like."""
    return f"""WITH {_WORDS}, g AS (SELECT s, min(k) AS k, count(DISTINCT k) AS copies FROM w WHERE len(s) > 0 GROUP BY 1), {_likely('g')}, c AS (SELECT DISTINCT a.s AS sa, b.s AS sb FROM f a JOIN f b ON a.t = b.t AND a.s < b.s),
    l AS (SELECT unnest([sa, sb]) AS s FROM c WHERE {_LIKE}), n AS (SELECT s, count(*) AS links FROM l GROUP BY 1) SELECT w.k AS result_no, g.k AS class_key, copies, coalesce(links, 0) AS links FROM w JOIN g ON w.s = g.s LEFT JOIN n ON w.s = n.s"""


def _folded(x: str) -> str:
    text = lambda s: s.replace("'", "''")
    like = {b: a for latin, other in LOOKALIKES.values() for a, b in zip(latin, other)}
    wide = {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}
    blanks = {chr(c): " " for c in (*range(9, 14), 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}
    table = like | wide | {c: "'" for c in APOSTROPHES} | {c: "-" for c in HYPHENS} | blanks
    gone = "".join(map(chr, (0xAD, 0x34F, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF)))
    out = f"translate({x}, '{text(''.join(table) + gone)}', '{text(''.join(table.values()))}')"
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), *HEBREW.items()):
        out = f"replace({out}, '{a}', '{text(b)}')"
    return f"regexp_replace(nfc_normalize({out}), ' +', ' ', 'g')"


def lookalike_quotes() -> str:
    """p6_found: quote and chunk under one table of the characters that the test tables have, then composed."""
    return f"""WITH q AS (SELECT DISTINCT quote_id, source_id, quote FROM evidence_quotes WHERE quote IS NOT NULL), c AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE text IS NOT NULL),
    f AS (SELECT quote_id, trim({_folded('quote')}) AS a, {_folded('text')} AS b FROM q JOIN c ON source_id = chunk_id WHERE NOT contains(text, quote)) SELECT DISTINCT quote_id FROM f WHERE a <> '' AND contains(b, a)"""
