"""Page queries on text_lines, with their SQL."""

from __future__ import annotations

from ..operators import pages
from ..session import table
from .catalog import core


@core.query(
    """WITH n AS (SELECT file, size, sum(length(text)) AS n FROM text_lines WHERE size IS NOT NULL AND trim(text) <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, size) AS k FROM n) SELECT file, size AS body FROM r WHERE k = 1"""
)
def page_body_sizes(spark, d):
    return pages.body_sizes(table(spark, d, "text_lines"))


@core.query(
    r"""WITH a AS (SELECT file, count(DISTINCT page) AS n FROM text_lines GROUP BY 1), l AS (SELECT file, trim(regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), '\s+', ' ', 'g')) AS line, count(DISTINCT page) AS pages FROM text_lines WHERE trim(text) <> '' GROUP BY 1, 2)
    SELECT l.file, line, pages FROM l JOIN a ON l.file = a.file WHERE pages >= greatest(2, ceil(n / 2.0))"""
)
def page_running_lines(spark, d):
    return pages.running_lines(table(spark, d, "text_lines"))
