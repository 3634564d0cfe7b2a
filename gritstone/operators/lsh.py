"""Joins of hashed vectors: pairs that share a hash and lie near each other, without a shuffle of candidates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gritstone.config import Config
from gritstone.operators.search import _passes, matrix
from gritstone.sources.scratch import let_workers_import

#: Queries and rows that are compared at once.
BLOCK = 512


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row of ``a`` to that of ``b``, summed from the first component to the last."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        total += (x - y) ** 2
    return np.sqrt(total)


def hashed_pairs(queries: DataFrame, rows: DataFrame, most: float, cfg: Config) -> DataFrame:
    """query_id, id, distance of each query and row that are equal in one of their hashes and less than ``most`` apart.

    ``queries`` has query_id, vector and hashes, ``rows`` has id, vector and hashes (a number for each hash table). As in
    ``search``, queries go to the rows in passes of cfg.pass_queries and each task compares its rows where they lie, so
    nothing is shuffled, and a task holds a pass and a block; pairs that share a hash are as good as all pairs here.
    Null vectors meet nothing; repeated rows repeat their pairs.
    """
    session = queries.sparkSession
    let_workers_import(session)
    kinds = [df.schema[c].dataType for df, c in ((queries, "query_id"), (rows, "id"))]
    fields = f"query_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, distance double"
    schema = pa.schema([("query_id", to_arrow_type(kinds[0])), ("id", to_arrow_type(kinds[1])), ("distance", pa.float64())])
    whole = F.concat(F.col("vector").cast("array<double>"), "hashes")  # one list for both
    tables = F.size("hashes").alias("tables")
    first = queries.where("query_id is not null and vector is not null").select(tables).first()
    if not first:
        return session.createDataFrame([], fields)
    own = rows.where("id is not null and vector is not null").select("id", whole.alias("whole"))

    def one(names: list, asked: np.ndarray) -> DataFrame:
        sent = session.sparkContext.broadcast((names, asked))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, asked = sent.value
            names, n = pa.array(names, schema.field("query_id").type), first.tables
            q, q_hash = np.ascontiguousarray(asked[:, :-n]), asked[:, -n:]
            q_norm = (q * q).sum(1)
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    block = batch.slice(at, BLOCK)
                    both = matrix(block.column(1))
                    v, v_hash = np.ascontiguousarray(both[:, :-n]), both[:, -n:]
                    v_norm = (v * v).sum(1)
                    for a in range(0, len(q), BLOCK):
                        own = slice(a, a + BLOCK)
                        # squares by dot products tell most pairs apart; those near the border or below are measured
                        scale = q_norm[own, None] + v_norm
                        near = scale - 2 * (q[own] @ v.T) < most * most + 1e-9 * (1 + scale)
                        same = reduce(np.logical_or, (q_hash[own, t, None] == v_hash[:, t] for t in range(n)))
                        i, j = np.nonzero(near & same)
                        d = distances(q[own][i], v[j])
                        i, j, d = (x[d < most] for x in (i, j, d))
                        if len(d):
                            yield pa.RecordBatch.from_arrays([names.take(pa.array(i + a)), block.column(0).take(pa.array(j)), pa.array(d)], schema=schema)

        return own.mapInArrow(run, fields)

    asked = queries.where("vector is not null").select("query_id", whole.alias("query_vector"))
    return reduce(DataFrame.unionAll, [one(*p) for p in _passes(asked, cfg)])
