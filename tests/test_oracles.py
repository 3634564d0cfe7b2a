"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from gritstone.plans.oracles import ORACLES
from gritstone.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql_but_those_of_another_kind():
    assert set(QUERIES) - set(ORACLES) == {"lsh_candidates", "inverted_file_top_k", "inverted_file_recall"}
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = db.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    rows = sorted(repr(tuple(r)) for r in got.select(columns).collect())
    assert rows == sorted(repr(r) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_lsh_finds_only_true_neighbours(spark):
    rows = QUERIES["lsh_candidates"](spark, SF).collect()
    assert rows and all(r["distance"] <= 1.3 for r in rows)
