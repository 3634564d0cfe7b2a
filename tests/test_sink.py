"""Points into an outside store: batches, commit, abort, and tasks that die and are tried again."""

import json
import os
import subprocess
import sys
from collections import Counter
from dataclasses import replace
from pathlib import Path

import pytest

from gritstone.config import Config
from gritstone.plans.jobs import export
from gritstone.sources.sink import write_points
from gritstone.sources.table import upsert

ROOT = Path(__file__).resolve().parent.parent


class Folder:
    """A store of files: batches staged by attempt, and a list of the attempts that count."""

    def __init__(self, path, die_at=None, always=False):
        self.path, self.die_at, self.always = Path(path), die_at, always

    def stage(self, attempt, batch, points):
        mark = self.path / "died"
        if self.die_at in [p["id"] for p in points] and (self.always or not mark.exists()):
            mark.touch()
            (self.path / f"staged-{attempt}-{batch}-half.json").write_text(json.dumps(points[:1]))
            os._exit(1) if not self.always else None  # a lost executor's worker cleans nothing up
            raise OSError("store is away")
        (self.path / f"staged-{attempt}-{batch}.json").write_text(json.dumps(points))

    def publish(self, attempts):
        part = self.path / f"published-{len(list(self.path.glob('published-*')))}.tmp"
        part.write_text(json.dumps(attempts))
        part.rename(part.with_suffix(".json"))

    def discard(self, attempts):
        for a in attempts:
            for f in self.path.glob(f"staged-{a}-*"):
                f.unlink()

    def batches(self):
        named = [a for f in sorted(self.path.glob("published-*.json")) for a in json.loads(f.read_text())]
        return [json.loads(f.read_text()) for a in named for f in sorted(self.path.glob(f"staged-{a}-*"))]


def connect_to(path, **kw):
    """A factory of ``Folder`` that carries this module, for tasks that cannot import it."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return lambda: Folder(path, **kw)


def test_batches_reach_the_store_once_each_and_nulls_pass(spark, tmp_path):
    rows = spark.range(0, 1050, 1, 4).selectExpr("id", "if(id % 7 = 0, null, concat('t', id)) text", "array(1.5D, cast(id as double)) vector", "named_struct('lang', 'en') metadata")
    write_points(rows, connect_to(str(tmp_path)), Config())
    got = Folder(tmp_path).batches()
    assert max(map(len, got)) == 100 and sum(len(b) < 100 for b in got) <= 4
    points = [p for b in got for p in b]
    assert sorted(p["id"] for p in points) == list(range(1050))
    assert all(p["text"] == (None if p["id"] % 7 == 0 else f"t{p['id']}") and p["vector"] == [1.5, p["id"]] and p["metadata"] == {"lang": "en"} for p in points)


def test_a_collection_is_exported_as_readers_see_it(spark, tmp_path):
    cfg, store = replace(Config(), table_path=str(tmp_path / "table"), buckets=3), tmp_path / "store"
    store.mkdir()
    make = lambda rows: spark.createDataFrame(rows, "id long, chunk_id string, patent_id string, vector array<float>")
    upsert(spark, make([(i, f"p{i % 5}::{i}", f"p{i % 5}", [0.5, float(i)]) for i in range(250)]), cfg.table_path, cfg)
    upsert(spark, make([(-1, "p1::1", "p1", None)]), cfg.table_path, cfg)
    export(spark, connect_to(str(store)), cfg)
    points = [p for b in Folder(store).batches() for p in b]
    want = {f"p{i % 5}::{i}": [0.5, i] for i in range(250)} | {"p1::1": None}
    assert len(points) == 250 and {p["chunk_id"]: p["vector"] for p in points} == want


def test_an_empty_table_publishes_nothing(spark, tmp_path):
    write_points(spark.createDataFrame([], "id long, text string"), connect_to(str(tmp_path)), Config())
    assert Folder(tmp_path).batches() == [] and not list(tmp_path.glob("staged-*"))


def test_a_write_that_fails_publishes_nothing(spark, tmp_path):
    with pytest.raises(Exception, match="store is away"):
        write_points(spark.range(0, 1000, 1, 2), connect_to(str(tmp_path), die_at=777, always=True), Config())
    assert not list(tmp_path.glob("published-*")) and not list(tmp_path.glob("*-half.json"))


SCRIPT = """
import sys
sys.path[:0] = [{root!r}, {tests!r}]
from pyspark.sql import SparkSession
import test_sink
from gritstone.config import Config
from gritstone.sources.sink import write_points
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.local.dir", {path!r} + "/local").getOrCreate()
write_points(spark.range(0, 1000, 1, 4), test_sink.connect_to({path!r}, die_at=640), Config())
spark.stop()
"""


def test_a_task_that_dies_and_runs_again_leaves_no_point_twice(tmp_path):
    script = SCRIPT.format(root=str(ROOT), tests=str(ROOT / "tests"), path=str(tmp_path))
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": str(ROOT)})
    assert done.returncode == 0, done.stderr[-2000:]
    assert (tmp_path / "died").exists() and list(tmp_path.glob("*-half.json"))  # the first attempt did leave something
    assert Counter(p["id"] for b in Folder(tmp_path).batches() for p in b) == Counter(range(1000))
