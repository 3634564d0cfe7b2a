"""The versioned table: segments, tombstones, merging, conflicts and crashes."""

import os
import random
from dataclasses import replace

import pytest

from gritstone.config import Config
from gritstone.sources import paths
from gritstone.sources.table import Table, bucket

CFG = replace(Config(), buckets=3, max_segments=2)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, patent_id string, v int").withColumn("bucket", bucket(CFG))


def content(table, **kw):
    return sorted((r.chunk_id, r.patent_id, r.v) for r in table.rows(**kw).collect())


def files(table):
    return {os.path.join(d, f) for d, _, fs in os.walk(f"{table.path}/data") for f in fs if f.endswith(".parquet")}


def test_random_upserts_equal_a_dictionary(spark, tmp_path):
    r, table, want = random.Random(1), Table(spark, str(tmp_path / "t"), CFG), {}
    for step in range(8):
        rows = {}
        for _ in range(r.choice([2, 2, 3, 30])):
            patent = f"p{r.randint(0, 9)}"
            rows[f"{patent}::{r.randint(0, 3)}"] = (patent, step)
        drop = r.random() < 0.4
        gone = [f"p{r.randint(0, 9)}"] if r.random() < 0.3 else []
        want = {k: v for k, v in want.items() if v[0] not in gone and not (drop and v[0] in {p for p, _ in rows.values()})} | rows
        marks = spark.createDataFrame([(p,) for p in gone], "patent_id string") if gone else None
        table.upsert(rows_of(spark, [(k, p, v) for k, (p, v) in rows.items()]), drop, marks)
        assert content(table) == sorted((k, p, v) for k, (p, v) in want.items()), step
        assert len(table.version().deltas) <= CFG.max_segments + 1
    # the last of these upserts has folded all segments already, so one more makes sure that there is something to fold
    table.upsert(rows_of(spark, [("p3::0", "p3", 99)]))
    want["p3::0"] = ("p3", 99)
    assert table.compact() and not table.version().deltas and content(table) == sorted((k, p, v) for k, (p, v) in want.items())


def test_rows_that_move_to_another_partition_are_one_row(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), CFG, partition="list", fixed=False)
    make = lambda rows: spark.createDataFrame(rows, "chunk_id string, patent_id string, v int, list int")
    table.upsert(make([("a", "p", 1, 0), ("b", "p", 1, 1)]))
    table.upsert(make([("a", "p", 2, 3)]))
    table.upsert(make([("b", "p", 3, 0)]))
    assert content(table) == [("a", "p", 2), ("b", "p", 3)]
    assert content(table, partitions=[0]) == [("b", "p", 3)] and content(table, partitions=[1]) == [] and content(table, partitions=[3]) == [("a", "p", 2)]
    assert table.compact() and content(table, partitions=[0, 1]) == [("b", "p", 3)]


def test_an_upsert_writes_in_proportion_to_its_rows(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), CFG)
    table.upsert(rows_of(spark, [(f"p{i}::0", f"p{i}", i) for i in range(5000)]))
    before = files(table)
    segment = table.upsert(rows_of(spark, [("p7::0", "p7", -1), ("new::0", "new", -2)]))
    new = files(table) - before
    assert before <= files(table) and len(new) <= 2 and sum(map(os.path.getsize, new)) < 5000 and (segment.rows, segment.base) == (2, False)
    assert table.rows().count() == 5001 and table.rows().where("v < 0").count() == 2
    assert sorted(r.v for r in table.segment_rows(segment).collect()) == [-2, -1]


def test_a_crash_between_steps_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = Table(spark, str(tmp_path / "t"), CFG)
    table.upsert(rows_of(spark, [("a::0", "a", 1)]))

    def dies(*_):
        raise RuntimeError("lost")

    import gritstone.sources.table as T

    with monkeypatch.context() as m:
        m.setattr(T, "put_text", dies)
        with pytest.raises(RuntimeError):
            table.upsert(rows_of(spark, [("a::0", "a", 2), ("b::0", "b", 2)]), replace_owner=True)
        with pytest.raises(RuntimeError):
            table._swap([], table.version().segments[0])
    assert content(table) == [("a::0", "a", 1)] and table.version().number == 1
    left = set(paths.names_in(spark, f"{table.path}/data"))
    table.vacuum(older_than=-1)
    assert len(left) == 2 and len(paths.names_in(spark, f"{table.path}/data")) == 1
    assert table.upsert(rows_of(spark, [("b::0", "b", 3)])) and content(table) == [("a::0", "a", 1), ("b::0", "b", 3)]


def test_two_writers_both_count_and_old_versions_stay_readable(spark, tmp_path, monkeypatch):
    import gritstone.sources.table as T

    table, other = Table(spark, str(tmp_path / "t"), CFG), Table(spark, str(tmp_path / "t"), CFG)
    table.upsert(rows_of(spark, [("a::0", "a", 1)]))
    real, calls = T.put_text, []

    def slow(spark_, path, text):
        if not calls:
            calls.append(path)
            other.upsert(rows_of(spark, [("b::0", "b", 2)]))  # commits between this writer's look and its put
        return real(spark_, path, text)

    monkeypatch.setattr(T, "put_text", slow)
    table.upsert(rows_of(spark, [("a::0", "a", 3)]))
    assert content(table) == [("a::0", "a", 3), ("b::0", "b", 2)] and table.version().number == 3
    assert content(table, version=1) == [("a::0", "a", 1)] and content(table, version=2) == [("a::0", "a", 1), ("b::0", "b", 2)]
    assert not real(spark, f"{table.path}/versions/{3:012d}.json", "{}")


def test_nothing_to_write_empty_tables_and_new_columns(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), CFG)
    assert not table.exists()
    table.upsert(rows_of(spark, []))
    assert table.exists() and content(table) == []
    assert table.upsert(rows_of(spark, [])) is None and table.version().number == 1
    table.upsert(rows_of(spark, [("a::0", "a", 1), ("a::0", "a", 5), (None, "n", 2)]))
    more = spark.createDataFrame([("c::0", "c", 2, "extra")], "chunk_id string, patent_id string, v int, w string").withColumn("bucket", bucket(CFG))
    table.upsert(more)
    assert {(r.chunk_id, r.v, r.w) for r in table.rows().collect()} == {("a::0", 5, None), (None, 2, None), ("c::0", 2, "extra")}


def test_named_partitions_alone_are_read(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), CFG)
    table.upsert(rows_of(spark, [(f"p{i}::0", f"p{i}", i) for i in range(40)]))
    table.upsert(rows_of(spark, [("p1::0", "p1", -1)]))
    read = {f.split("bucket=")[1][0] for f in table.rows([2]).where("v >= 0").inputFiles() if "/bucket=" in f}
    base = table.version().base
    assert {f for f in table._scan(table.version().schema, base, [2]).inputFiles() if "bucket=2" not in f} == set() and "2" in read
