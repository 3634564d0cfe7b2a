"""The collection: a Parquet table of points by key, changed by small segments and read by merging them.

    data/segment=<name>/<partition>=<n>/part-*.parquet     rows, written once and never changed
    versions/<number>.json                                 the segments of a version, put there in one step

An upsert of n rows writes a segment of n rows and a version that lists it; readers take the newest version, so they see
all of an upsert or nothing of it, and a job that dies leaves files that no version names. Of rows with one key the
newest segment's counts. A *tombstone* hides all older rows of its owner (patent). Segments are merged when there are
many: newest ones of like size first, so that a row is written again a number of times that grows with the logarithm of
the upserts; and into the base, in the partitions they touch, once they hold a good part of its rows.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BooleanType, IntegerType, StructType
from pyspark.sql.window import Window

from gritstone.config import Config
from gritstone.sources.paths import delete, names_in, path_exists, put_text, read_text

#: Keys or tombstones of segments (some 100 bytes each) up to which they are sent to every task; beyond, both sides are shuffled.
MAX_SENT_KEYS = 100_000
KEEP_VERSIONS, KEEP_SECONDS = 3, 3600.0


def bucket(cfg: Config):
    return F.pmod(F.xxhash64("patent_id"), F.lit(cfg.buckets)).cast("int")


def merged(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key is not among them."""
    return old.join(new.select(key), key, "left_anti").select(old.columns).unionByName(new, allowMissingColumns=True)


def latest(rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row for each ``key``: of several, the last in the order of their plain columns."""
    plain = [f.name for f in rows.schema.fields if isinstance(f.dataType, AtomicType) and f.name != key]
    order = Window.partitionBy(key).orderBy(*[F.desc(c) for c in plain] or [key])
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


@dataclass(frozen=True)
class Segment:
    name: str
    seq: int  # the version that brought it; newer rows win
    rows: int
    tombstones: int
    base: bool
    partitions: list[int]  # those that count; a base segment loses the ones that are written anew


@dataclass(frozen=True)
class Version:
    number: int
    schema: StructType
    segments: list[Segment]

    @property
    def base(self) -> list[Segment]:
        return [s for s in self.segments if s.base]

    @property
    def deltas(self) -> list[Segment]:
        return sorted((s for s in self.segments if not s.base), key=lambda s: s.seq)


class Table:
    """Rows by ``key`` in partitions; ``owner`` is the column whose values tombstones name.

    With ``fixed`` the partition is a function of the owner, so rows of one key never move to another.
    """

    def __init__(self, spark: SparkSession, path: str, cfg: Config, key: str = "chunk_id", owner: str = "patent_id", partition: str = "bucket", fixed: bool = True):
        self.spark, self.path, self.cfg = spark, path.rstrip("/"), cfg
        self.key, self.owner, self.partition, self.fixed = key, owner, partition, fixed

    # versions

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in names_in(self.spark, f"{self.path}/versions") if n.removesuffix(".json").isdigit())

    def exists(self) -> bool:
        return bool(self._numbers())

    def version(self, number: int | None = None) -> Version:
        """A version that is still kept, the newest if no number is given."""
        numbers = self._numbers()
        if not numbers:
            raise FileNotFoundError(f"no table at {self.path}")
        number = numbers[-1] if number is None else number
        body = json.loads(read_text(self.spark, f"{self.path}/versions/{number:012d}.json"))
        return Version(number, StructType.fromJson(body["schema"]), [Segment(**s) for s in body["segments"]])

    def _commit(self, change: Callable[[Version | None], Version | None]) -> bool:
        """Puts the version that ``change`` makes of the newest one, again if another writer was faster; None: nothing to do."""
        while True:
            now = self.version() if self.exists() else None
            made = change(now)
            if made is None:
                return False
            number = now.number + 1 if now else 1
            body = json.dumps({"schema": made.schema.jsonValue(), "segments": [asdict(s) for s in made.segments]})
            if put_text(self.spark, f"{self.path}/versions/{number:012d}.json", body):
                return True

    # segments

    def _folder(self, name: str) -> str:
        return f"{self.path}/data/segment={name}"

    def _write(self, rows: DataFrame, name: str, mode: str = "error") -> None:
        """``rows`` by partition; large partitions are dealt to several tasks and files, small ones share a task."""
        (
            rows.hint("rebalance", self.partition).write.mode(mode).option("maxRecordsPerFile", self.cfg.rows_per_file)
            .partitionBy(self.partition).parquet(self._folder(name))
        )

    def _scan(self, schema: StructType, segments: list[Segment], partitions: list[int] | None = None) -> DataFrame:
        """All rows of ``segments`` with seq and deleted, in the given partitions only if there are any given."""
        wanted = lambda s: [p for p in s.partitions if partitions is None or p in chosen]
        chosen = set(partitions or ())
        folders = [f"{self._folder(s.name)}/{self.partition}={p}" for s in segments for p in wanted(s)]
        whole = StructType([f for f in schema if f.name != self.partition]).add("deleted", BooleanType())
        if not folders:
            return self.spark.createDataFrame([], whole).withColumn(self.partition, F.lit(0)).withColumn("seq", F.lit(0))
        found = self.spark.read.schema(whole).option("basePath", f"{self.path}/data").parquet(*folders)
        order = F.create_map(*[F.lit(x) for s in segments for x in (s.name, s.seq)])
        return found.withColumn(self.partition, F.col(self.partition).cast("int")).withColumn("seq", F.element_at(order, F.col("segment").cast("string"))).drop("segment")

    def _merged(self, version: Version, segments: list[Segment], partitions: list[int] | None) -> DataFrame:
        """Rows of ``segments`` that none of them hides, with seq."""
        base, deltas = [s for s in segments if s.base], [s for s in segments if not s.base]
        rows = self._scan(version.schema, base, partitions)
        if not deltas:
            return rows.drop("deleted")
        # keys and tombstones are read from all partitions, for a key may have been in another one, but these columns alone
        every = self._scan(version.schema, deltas)
        keys = every.where("deleted is null").groupBy(F.col(self.key).alias("__key")).agg(F.max("seq").alias("newest"))
        few = sum(s.rows for s in deltas) <= MAX_SENT_KEYS
        keys = F.broadcast(keys) if few else keys
        same = F.col(self.key).eqNullSafe(F.col("__key"))
        rows = rows.join(keys, same, "left_anti")
        own = self._scan(version.schema, deltas, partitions).where("deleted is null")
        own = own.join(keys, same & (F.col("seq") == F.col("newest")), "left_semi") if len(deltas) > 1 else own
        rows = rows.unionByName(own)
        if n := sum(s.tombstones for s in deltas):
            gone = every.where("deleted").groupBy(self.owner).agg(F.max("seq").alias("gone"))
            gone = F.broadcast(gone) if n <= MAX_SENT_KEYS else gone
            rows = rows.join(gone, self.owner, "left").where("gone is null or seq >= gone").drop("gone")
        return rows.drop("deleted")

    def rows(self, partitions: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The table's rows with their partition, of the given partitions only (others are not read) if any are given."""
        v = self.version(version)
        return self._merged(v, v.segments, partitions).select(*v.schema.names)

    def segment_rows(self, segment: Segment) -> DataFrame:
        """The rows that an upsert has written."""
        return self._scan(self.version().schema, [segment]).where("deleted is null").drop("deleted", "seq")

    # changes

    def upsert(self, new: DataFrame, replace_owner: bool = False, gone: DataFrame | None = None) -> Segment | None:
        """Inserts or replaces rows by key; with ``replace_owner`` older rows of the owners in ``new`` go, and so do those of
        the owners in ``gone``. Returns the segment; None, and no version, if there was nothing to write.

        ``new`` is computed once. Of rows with one key the last in the order of their plain columns stays: keys alone are
        looked at first, and the segment is written again only if one comes twice. Rows with a null key are one key.
        """
        name = uuid.uuid4().hex
        self._write(new, name)
        own = StructType([f for f in new.schema if f.name != self.partition]).add(self.partition, IntegerType())
        read = lambda: self.spark.read.schema(own).option("basePath", self._folder(name)).parquet(self._folder(name))
        if read().groupBy(self.key).count().where("count > 1").limit(1).count():
            first, name = self._folder(name), uuid.uuid4().hex
            again = self.spark.read.schema(own).option("basePath", first).parquet(first)
            self._write(latest(again, self.key), name)
            delete(self.spark, first)
        marks = gone.select(self.owner) if gone is not None else None
        if replace_owner:
            mine = read().select(self.owner)
            marks = mine if marks is None else marks.union(mine)
        if marks is not None:
            place = bucket(self.cfg) if self.fixed else F.lit(0)
            self._write(marks.where(F.col(self.owner).isNotNull()).distinct().withColumn(self.partition, place).withColumn("deleted", F.lit(True)), name, "append")
        segment = self._measured(name, own)
        written: list[Segment] = []

        def change(now: Version | None) -> Version | None:
            written.clear()
            if now and not segment.rows and not segment.tombstones:
                return None
            written.append(replace(segment, seq=now.number + 1 if now else 1, base=not now))
            if not now:
                return Version(1, own, written[:])
            names = set(now.schema.names)
            schema = StructType([*now.schema, *(f for f in own if f.name not in names)])
            return Version(now.number + 1, schema, [*now.segments, *written])

        self._commit(change)
        if written:
            self.tidy()
        return written[0] if written else None

    def _measured(self, name: str, schema: StructType) -> Segment:
        """Rows, tombstones and partitions of a written segment, from one narrow column."""
        whole = StructType([f for f in schema if f.name != self.partition]).add("deleted", BooleanType()).add(self.partition, IntegerType())
        found = self.spark.read.schema(whole).parquet(self._folder(name))
        counts = found.groupBy(self.partition).agg(F.count("*").alias("n"), F.count("deleted").alias("gone")).collect()  # a row for each partition
        return Segment(name, 0, sum(r.n - r.gone for r in counts), sum(r.gone for r in counts), False, sorted(r[0] for r in counts))

    def tidy(self) -> None:
        """Merges segments where there are more than cfg.max_segments, and deletes what no kept version names."""
        now = self.version()
        deltas = now.deltas
        if len(deltas) <= self.cfg.max_segments:
            return
        run, size = deltas[-2:], deltas[-1].rows + deltas[-2].rows
        for s in reversed(deltas[:-2]):
            if s.rows > 2 * size:
                break
            run, size = [s, *run], size + s.rows
        if len(run) == len(deltas) and size >= self.cfg.fold_share * sum(s.rows for s in now.base):
            self.compact()
        else:
            self._merge_deltas(now, run)
        self.vacuum()

    def _merge_deltas(self, now: Version, run: list[Segment]) -> bool:
        """One segment for a run of neighbours, with the newest one's place in the order."""
        name, seq = uuid.uuid4().hex, run[-1].seq
        self._write(self._merged(now, run, None).drop("seq"), name)
        if any(s.tombstones for s in run):
            marks = self._scan(now.schema, run).where("deleted").select(self.owner, self.partition).distinct()
            self._write(marks.withColumn("deleted", F.lit(True)), name, "append")
        made = replace(self._measured(name, now.schema), seq=seq)
        return self._swap(run, made)

    def compact(self) -> bool:
        """Folds all segments into the base, in the partitions they touch (in all of them if rows may have moved)."""
        now = self.version()
        deltas = now.deltas
        if not deltas:
            return False
        touched = {p for s in deltas for p in s.partitions} if self.fixed else {p for s in now.segments for p in s.partitions}
        name = uuid.uuid4().hex
        self._write(self._merged(now, now.segments, sorted(touched)).drop("seq"), name)
        made = replace(self._measured(name, now.schema), seq=now.number, base=True)
        return self._swap(deltas, made, touched)

    def _swap(self, gone: list[Segment], made: Segment, touched: set[int] | None = None) -> bool:
        """A version with ``made`` for the segments ``gone``, unless another writer has replaced one of them already."""
        names = {s.name for s in gone}

        def change(now: Version) -> Version | None:
            if not names <= {s.name for s in now.segments}:
                return None
            left = [s for s in now.segments if s.name not in names]
            if touched is not None:
                left = [replace(s, partitions=[p for p in s.partitions if p not in touched]) if s.base else s for s in left]
            left = [s for s in left if s.partitions or not s.base]
            return replace(now, segments=[*left, made])

        return self._commit(change)

    def vacuum(self, keep: int = KEEP_VERSIONS, older_than: float = KEEP_SECONDS) -> None:
        """Deletes all versions but the newest ``keep``, and segments that no kept version names if they have not changed
        for ``older_than`` seconds (a writer may be about to name a newer one)."""
        numbers, cut = self._numbers(), time.time() - older_than
        for n in numbers[:-keep]:
            delete(self.spark, f"{self.path}/versions/{n:012d}.json")
        used = {f"segment={s.name}" for n in numbers[-keep:] for s in self.version(n).segments}
        for folder, changed in names_in(self.spark, f"{self.path}/data").items():
            if folder not in used and changed < cut:
                delete(self.spark, f"{self.path}/data/{folder}")


def collection(spark: SparkSession, path: str, cfg: Config) -> Table:
    """The table of chunks, in cfg.buckets partitions by patent."""
    return Table(spark, path, cfg)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    return Table(spark, path, Config()).rows().drop("bucket")


def upsert(spark: SparkSession, new: DataFrame, path: str, cfg: Config, replace_patent: bool = False) -> Segment | None:
    """Inserts or replaces points by chunk_id; with ``replace_patent`` older chunks of the patents in ``new`` go too."""
    return collection(spark, path, cfg).upsert(new.withColumn("bucket", bucket(cfg)), replace_patent)


def in_batches(rows: DataFrame, send, cfg: Config) -> None:
    """Hands each task's rows to ``send(list of Row)`` in batches of cfg.batch_size, for a sink outside Spark."""
    size = cfg.batch_size

    def run(part) -> None:
        held = []
        for r in part:
            held.append(r)
            if len(held) == size:
                send(held)
                held = []
        if held:
            send(held)

    rows.foreachPartition(run)


__all__ = ["Segment", "Table", "Version", "bucket", "collection", "in_batches", "latest", "merged", "path_exists", "read_collection", "upsert"]
