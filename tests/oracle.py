"""Runs a query and its SQL on the same tables and compares rows as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings chunks evidence_quotes graph_nodes graph_edges "
    "results text_lines import_diagnostics raw_results import_files split_limits pack_limits mix_targets"
).split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, decimal.Decimal)):
        return float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x if isinstance(x, str) else str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sql: str, d: str = SF):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{d}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    return rows_of(columns, got.fetchall())


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def differences(name: str, df, sql: str, d: str = SF) -> str | None:
    a, b = spark_rows(df), duck(sql, d)
    if a[0] != b[0]:
        return f"{name}: columns {a[0]} and {b[0]}"
    if a[1] == b[1]:
        return None
    left, right = [x for x in a[1] if x not in set(b[1])][:3], [x for x in b[1] if x not in set(a[1])][:3]
    return f"{name}: {len(a[1])} and {len(b[1])} rows; only here {left}; only in SQL {right}"
