"""Vector codes: product quantisation in whole numbers, by an integer Walsh-Hadamard transform with early elimination.

Components become integers, vectors are cut into equal parts, and each part is coded by the nearest entry of its place's
codebook, which a fixed number of assign-and-average rounds makes from the first vectors. To find the nearest entry, part
and entries are padded with zeros to a power of two and transformed (Walsh-Hadamard, sums and differences only). The
transform multiplies squared distances by its length, so comparing scaled sums compares distances, exactly. Coefficients
are taken in order of sequency, where the slow ones, which hold most of the difference, come first; an entry is dropped
as soon as its sum so far exceeds the whole sum of the entry that led after the first few. No step uses floating point.

Each round is one scan: tasks send integer sums for each entry and component, in limbs of 30 bits so that sums of any
size stay exact, and the driver, which holds nothing but the codebooks, divides.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.llm.store import Scratch, let_workers_import

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
SLICE = 2048  # vectors compared at once
LIMB = 30
MOST = (1 << 63) - 1
HOT = 1000  # labels with more than a 1000th of all rows, fewer than 1000 by that, are joined by broadcast


def sequency(size: int) -> np.ndarray:
    """Places of the transform's coefficients by sequency (sign changes of their rows): bit-reversed Gray codes."""
    bits = size.bit_length() - 1
    return np.array([int(f"{i ^ i >> 1:0{bits}b}"[::-1], 2) if bits else 0 for i in range(size)])


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, padded with zeros to a power of two, in order of sequency."""
    width = max(1, x.shape[1])
    size = 1 << (width - 1).bit_length()
    y = np.zeros((len(x), size), x.dtype)
    y[:, : x.shape[1]] = x
    h = 1
    while h < size:
        pairs = y.reshape(len(y), -1, 2, h)
        y = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(y), size)
        h *= 2
    return y[:, sequency(size)]


def nearest(x: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, scaled squared distance) for each transformed row of ``x`` among transformed entries; ties to the lower."""
    n, size = x.shape
    step = max(1, size // 4)
    squares = lambda a, b: ((a - b) ** 2).sum(-1)
    so_far = squares(x[:, None, :step], e[None, :, :step])
    lead = so_far.argmin(1).astype(np.int64)
    bound = so_far[np.arange(n), lead] + squares(x[:, step:], e[lead, step:])
    row, entry = np.nonzero(so_far <= bound[:, None])
    d = so_far[row, entry]
    for a in range(step, size, step):
        d = d + squares(x[row, a : a + step], e[entry, a : a + step])
        alive = (d <= bound[row]).astype(bool)
        row, entry, d = row[alive], entry[alive], d[alive]
    first = np.searchsorted(row, np.arange(n))  # rows come in order, each with its leader at least
    least = np.minimum.reduceat(d, first)
    at = np.flatnonzero((d == least[row]).astype(bool))
    at = at[np.searchsorted(row[at], np.arange(n))]
    return entry[at], d[at]


def _small(size: int) -> int:
    """Components up to this size keep all sums of a transformed part of ``size`` within 63 bits."""
    return math.isqrt((1 << 60) // max(1, size) ** 3)


def integers(column: pa.Array, dims: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of a list column, short vectors padded with zeros: int64, or Python integers where those overflow."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64)
    lens = np.diff(offsets)
    x = np.zeros((len(lens), dims))
    x[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], lens)] = flat
    if not x.size or np.abs(x).max() < 2.0**40:
        return np.floor(x * scale).astype(np.int64)
    exact = [math.floor(v * scale) if abs(v) < 2.0**50 else int(v) * scale for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def _kind(x: np.ndarray, size: int) -> np.ndarray:
    """``x`` as int64 where its squares allow, else as Python integers."""
    most = max((abs(int(v)) for v in (x.min(), x.max())), default=0) if x.size else 0
    return x.astype(np.int64 if most <= _small(size) else object)


@dataclass(frozen=True)
class Codebooks:
    """``entries[part][entry]`` are lists of integers; parts have ``width`` components each."""

    entries: list
    width: int
    scale: int = SCALE

    @property
    def dims(self) -> int:
        return self.width * len(self.entries)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for e in part for x in e).encode()).hexdigest()

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries, squared distances) of integer vectors, a column for each part."""
        size = 1 << (max(1, self.width) - 1).bit_length()
        code, error = np.zeros((len(x), len(self.entries)), np.int64), np.zeros((len(x), len(self.entries)), object)
        for p, own in enumerate(self.entries):
            book = _kind(np.array(own, object).reshape(len(own), self.width), size)
            for a in range(0, len(x), SLICE):
                part = _kind(x[a : a + SLICE, p * self.width : (p + 1) * self.width], size)
                kind = object if object in (part.dtype, book.dtype) else np.int64
                code[a : a + SLICE, p], d = nearest(transform(part.astype(kind)), transform(book.astype(kind)))
                error[a : a + SLICE, p] = d // size
        return code, error


def usable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """key, label and vector (as doubles) of the rows whose vector is there and holds finite numbers only."""
    rows = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | (F.abs(x) >= float("inf")))  # NaN counts as the greatest
    return rows.where(F.col("v").isNotNull() & ~odd)


def first_vectors(rows: DataFrame, n: int) -> list[list[float]]:
    """Vectors of the ``n`` smallest keys, in order; of repeated keys the smallest vector. Each task sends ``n`` rows at most."""
    kind = rows.schema["key"].dataType.simpleString()

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        schema = None
        for batch in batches:
            schema = schema or batch.select(["key", "v"]).schema
            keys = batch.column("key")
            new = {}
            for i, k in enumerate(keys.to_pylist()):
                if k is not None and (len(held) < n or k <= max(held)):
                    new.setdefault(k, []).append(i)
            for k in sorted(new)[:n]:
                held[k] = min([*([held[k]] if k in held else []), *batch.column("v").take(new[k]).to_pylist()])
            held = {k: held[k] for k in sorted(held)[:n]}
        if held:
            yield pa.RecordBatch.from_pylist([{"key": k, "v": v} for k, v in held.items()], schema)

    found = rows.select("key", "v").mapInArrow(least, f"key {kind}, v array<double>")
    return [r.v for r in found.groupBy("key").agg(F.min("v").alias("v")).orderBy("key").limit(n).collect()]


def _sums(rows: DataFrame, books: Codebooks) -> dict:
    """(part, entry, position) to the sum of its members' integers, and at position -1 their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, k = books.width, max(map(len, books.entries))
        sums, counts = np.zeros((len(books.entries), k, w), object), np.zeros((len(books.entries), k), np.int64)
        for batch in batches:
            x = integers(batch.column(0), books.dims, books.scale)
            code, _ = books.assign(x)
            for p in range(len(books.entries)):
                own = code[:, p, None] == np.arange(k)
                counts[p] += own.sum(0)
                part = x[:, p * w : (p + 1) * w]
                for e in np.flatnonzero(own.any(0)):
                    sums[p, e] += part[own[:, e]].sum(0)
        out = [(p, e, -1, 0, int(n)) for (p, e), n in np.ndenumerate(counts) if n]
        for (p, e, i), v in np.ndenumerate(sums):
            limb, sign, left = 0, -1 if v < 0 else 1, abs(int(v))
            while left:
                out.append((p, e, i, limb, sign * (left & ((1 << LIMB) - 1))))
                limb, left = limb + 1, left >> LIMB
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:4]), pa.array(cols[4], pa.int64())], ["part", "entry", "position", "limb", "n"])

    sent = rows.select("v").mapInArrow(run, "part int, entry int, position int, limb int, n long")
    out: dict = defaultdict(int)
    for r in sent.groupBy("part", "entry", "position", "limb").agg(F.sum("n").alias("n")).collect():  # no more than the codebooks' components and limbs
        out[r.part, r.entry, r.position] += r.n << (LIMB * r.limb)
    return out


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of ``rows`` (key, v; see ``usable``), made from all of them; None where no row has a key.

    A part's entries start as that part of the ``entries`` smallest keys' vectors, fewer if there are fewer keys. Entries
    that no part is assigned to stay. The length of vectors is the greatest there is, rounded up to a multiple of
    ``parts``; shorter ones are padded with zeros.
    """
    let_workers_import(rows.sparkSession)
    starts = first_vectors(rows, entries)
    if not starts:
        return None
    width = -(-(rows.agg(F.max(F.size("v"))).first()[0] or 0) // parts)
    x = integers(pa.array(starts, pa.list_(pa.float64())), width * parts, scale).astype(object)
    books = Codebooks([x[:, p * width : (p + 1) * width].tolist() for p in range(parts)], width, scale)
    for _ in range(rounds):
        sums = _sums(rows, books)
        averaged = lambda p, e, old: [sums[p, e, i] // n for i in range(width)] if (n := sums.get((p, e, -1), 0)) else old
        books = Codebooks([[averaged(p, e, old) for e, old in enumerate(own)] for p, own in enumerate(books.entries)], width, scale)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """key, label, code (two hex digits a part) and error (squared distance, 2^63 - 1 at most) of ``rows``."""
    let_workers_import(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = books.assign(integers(batch.column("v"), books.dims, books.scale))
            codes = [c.tobytes().hex() for c in code.astype(np.uint8)]
            errors = [min(int(e), MOST) for e in error.sum(1)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["key", "label", "code", "error"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("key", "label")}
    return rows.mapInArrow(run, f"key {kinds['key']}, label {kinds['label']}, code string, error long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` (stored) with label_error, the sum of error over rows of one label (null is one), 2^63 - 1 at most.

    Sums are made in the tasks first. The sums of labels with many rows, fewer than HOT by their share, are sent to all
    tasks; the others are joined by shuffle, where no label is large.
    """
    sums = coded.groupBy("label").agg(F.count("*").alias("rows"), F.sum(F.col("error").cast("decimal(20,0)")).alias("sum"))
    sums = Scratch(coded.sparkSession, "label-sums").keep(
        sums.select(F.col("label").alias("of"), "rows", F.least("sum", F.lit(MOST).cast("decimal(30,0)")).cast("long").alias("label_error")), "sums"
    )
    total = sums.agg(F.sum("rows")).first()[0] or 0
    hot = F.broadcast(sums.where(F.col("rows") * HOT > total).drop("rows"))
    same = F.col("label").eqNullSafe(F.col("of"))
    found = coded.join(hot.withColumn("is_hot", F.lit(True)), same, "left").drop("of")
    rest = found.where("is_hot is null").drop("label_error", "is_hot")
    rare = rest.join(sums.where(F.col("rows") * HOT <= total).drop("rows"), same).drop("of")
    return found.where("is_hot").drop("is_hot").unionByName(rare)


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """(key, label, code, error for each usable vector; the codebooks).

    Rows whose vector is null or holds null or non-finite components are dropped, as the first step. Every row that is
    left is coded, repeated ones and those with a null key too (which start no entry). Of equally near entries the lower
    is taken. An empty vector counts as zeros. An empty table gives no rows and no codebooks, and so does one whose keys
    are all null. Other columns are not read, whatever their names. Rows are written once, since each round scans them.
    """
    let_workers_import(vectors.sparkSession)
    rows = Scratch(vectors.sparkSession, "vector-codes").keep(usable(vectors, key, vector, label), "vectors")
    books = fit(rows, parts, entries, rounds)
    if books is None:
        coded = rows.where("false").select("key", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        coded = encode(rows, books)
    return Scratch(vectors.sparkSession, "vector-codes").keep(coded, "coded"), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = books.sha256() if books else hashlib.sha256(b"").hexdigest()
    return with_label_error(coded).select(F.col("key").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    """DuckDB SQL of the same rounds, each part against each entry; for tables whose vectors have one length."""
    whole = lambda s, n: f"(({s}) - ((({s}) % {n}) + {n}) % {n}) // {n}"  # noqa: E731  floor of the quotient
    text = f"""
WITH g AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS x FROM g, range({PARTS}) AS t(part)),
s AS (SELECT vec_id, min(r) AS r FROM g WHERE vec_id IS NOT NULL GROUP BY vec_id ORDER BY vec_id LIMIT {ENTRIES}),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x FROM s JOIN p USING (r)),"""
    for i in range(ROUNDS + 1):
        text += f"""
a{i} AS MATERIALIZED (SELECT r, part, min(CAST(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * {ENTRIES} + c.e) AS m
  FROM p JOIN c{i} c USING (part) GROUP BY r, part),"""
        if i < ROUNDS:
            text += f"""
m{i} AS (SELECT part, e, list(y ORDER BY i) AS y FROM (SELECT part, m % {ENTRIES} AS e, i, CAST({whole("sum(x[i])", "count(*)")} AS BIGINT) AS y
  FROM a{i} JOIN p USING (r, part), range(1, len(x) + 1) AS t(i) GROUP BY ALL) GROUP BY part, e),
c{i + 1} AS MATERIALIZED (SELECT part, e, coalesce(y, x) AS x FROM c{i} LEFT JOIN m{i} USING (part, e)),"""
    return f"""{text}
f AS (SELECT r, string_agg(printf('%02x', m % {ENTRIES}), '' ORDER BY part) AS code, CAST(sum(m // {ENTRIES}) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r),
h AS (SELECT sha256(coalesce(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, e, i), '')) AS h FROM (SELECT part, e, i, x[i] AS x FROM c{ROUNDS}, range(1, len(x) + 1) AS t(i)))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM h) AS codebooks_sha256 FROM f JOIN g USING (r)
"""


ORACLE = _oracle()
