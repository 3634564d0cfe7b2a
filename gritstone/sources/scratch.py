"""Shared scratch tables: how iterative jobs cut lineage, so that lost executors cost a re-read and not a re-run.

The folder is the one the cluster names in ``spark.checkpoint.dir``; a folder of our own is made only where that is
unset, as in tests with a local master.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def scratch_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Without one, a folder of this machine is made for a local master; any other master is refused, since executors would
    write to disks of their own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-gritstone-")
        sc.setCheckpointDir(named)
    return named


class Scratch:
    """Tables written under one fresh folder of the shared scratch space.

    ``keep`` writes a DataFrame as Parquet and returns a DataFrame that reads it; ``drop`` deletes a table that no later
    step reads, so that iterations do not pile up on disk.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_dir(spark)}/gritstone-{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        self.paths.append(path)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t.scratch_path)

    def clear(self, *but: DataFrame) -> None:
        """Drops all tables but those given."""
        kept = {t.scratch_path for t in but}
        for path in [p for p in self.paths if p not in kept]:
            self._delete(path)
        self.paths = sorted(kept)
        if not kept:
            self._delete(self.base)


#: Bytes of an Arrow batch, and Spark's own bound, which counts as unset.
BATCH_BYTES, DEFAULT_BATCH_BYTES = 8 << 20, 64 << 20


def let_workers_import(spark: SparkSession) -> None:
    """Readies a session for tasks in Python.

    Puts this checkout on the Python path of workers started on the same machine (clusters ship it with --py-files), and
    bounds Arrow batches, which hold whole texts, to BATCH_BYTES where the session has Spark's default.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(DEFAULT_BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (path, ROOT) if x)
