"""The queries that have SQL against it, on the smallest tables and on a table of odd texts."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

from quarry.llm import queries

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
duckdb = pytest.importorskip("duckdb")


def compare(spark, name, path):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet{'/*.parquet' if os.path.isdir(f'{path}/documents.parquet') else ''}'")
    want = db.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, str(path))
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_on_the_tables(spark, name):
    compare(spark, name, DATA)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_on_odd_texts(spark, make, corpus, tmp_path, name):
    more = {500: "Released under the MIT License. UNDER THE MIT-LICENSE", 501: "apache license, version 2 cc by nc", 502: "É under the mit license é"}
    make(corpus | more).write.parquet(f"{tmp_path}/documents.parquet")
    compare(spark, name, tmp_path)
