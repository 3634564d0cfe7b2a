"""Embedding: text to vectors of length 1 through a model adapter in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.config import Config
from gritstone.functions import models
from gritstone.sources.scratch import let_workers_import


def embed(rows: DataFrame, cfg: Config, text: str = "text", vector: str = "vector") -> DataFrame:
    """``rows`` with a column ``vector`` of cfg.vector_size floats; a null text has a zero vector.

    A model whose vectors have another size fails the job. Validate first: filters do not move below this step.
    """
    let_workers_import(rows.sparkSession)
    rows = rows.drop(vector)
    at, name, dim = rows.columns.index(text), cfg.embedding_model, cfg.vector_size
    factory = models.EMBEDDERS[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            model = models.loaded(factory, dim)  # not before there is a row for it
            v = np.asarray(model([t or "" for t in batch.column(at).to_pylist()]), np.float64)
            if v.shape != (batch.num_rows, dim):
                raise ValueError(f"model {name!r} gave vectors of shape {v.shape} for {batch.num_rows} texts; {dim} dimensions are asked for")
            n = np.sqrt((v * v).sum(1, keepdims=True))
            flat = (v / np.where(n == 0, 1, n)).astype(np.float32).ravel()
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors], [*batch.schema.names, vector])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, `{vector}` array<float>")


def check_dimension(rows: DataFrame, cfg: Config, vector: str = "vector") -> DataFrame:
    """Rows whose vector has another length than the contract's; none are expected."""
    return rows.where(F.size(vector) != cfg.vector_size)
