"""Corpus queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from gritstone.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    rows = sorted(repr(tuple(r)) for r in got.select(columns).collect())
    assert rows == sorted(repr(r) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
