"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

DATA = os.environ.get("STRANDLINE_TESTDATA", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def cell(value):
    return round(value, 9) if isinstance(value, float) else value


def compare(spark, query, sql):
    df = query(spark, DATA)
    names = sorted(df.columns)
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    want = con.sql(sql)
    assert sorted(want.columns) == names
    got = Counter(tuple(map(cell, r)) for r in df.select(*names).collect())
    quoted = ", ".join(f'"{n}"' for n in names)
    assert got == Counter(tuple(map(cell, r)) for r in con.sql(f"SELECT {quoted} FROM ({sql})").fetchall())
    return sum(got.values())
