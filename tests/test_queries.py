"""Every query that has SQL gives the same rows in DuckDB, on the same Parquet tables."""

import decimal
import os
from pathlib import Path

import duckdb
import pytest

from textspark import queries as own

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """A value that sorts and compares alike from both engines."""
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def duck(sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    con.execute("SET TimeZone = 'UTC'")
    got = con.execute(sql)
    return rows_of([c[0] for c in got.description], got.fetchall())


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_same_rows_in_both_engines(spark, name):
    df = own.queries()[name](spark, SF_DIR)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == duck(own.oracle_sql()[name], SF_DIR)


def test_every_sql_belongs_to_a_query():
    assert set(own.oracle_sql()) <= set(own.queries())
