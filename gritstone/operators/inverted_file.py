"""Approximate search: an inverted file kept beside the collection.

Centroids are fitted to a bounded sample (k-means by cosine); every row goes to the list of its nearest centroid, a
partition of a versioned table like the collection's own. A query looks in the lists whose centroids are nearest to it,
so partitions that no query of a pass looks in are not read. How many lists that is comes from a measurement: for some
vectors of the sample the exact nearest rows are found, and a recall is known for each number of lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.config import Config
from gritstone.functions.vectors import norm
from gritstone.operators.search import matrix, nearest, vector_search
from gritstone.sources.paths import path_exists
from gritstone.sources.scratch import let_workers_import
from gritstone.sources.table import Table

MOST_LISTS = 4096


def index_path(cfg: Config) -> str:
    return f"{cfg.table_path.rstrip('/')}_index"


def list_table(spark: SparkSession, path: str, cfg: Config) -> Table:
    """chunk_id, patent_id, vector and home (the row's partition in the collection) by list."""
    return Table(spark, f"{path}/lists", cfg, partition="list", fixed=False)


@dataclass
class Index:
    path: str
    centroids: np.ndarray  # of length 1
    recall: np.ndarray  # with 1, 2, ... lists probed, as measured

    def probes(self, recall: float) -> int:
        """The smallest number of lists that gave this recall; all of them if none did."""
        enough = np.flatnonzero(self.recall >= recall)
        return int(enough[0]) + 1 if len(enough) else len(self.centroids)

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """For each vector the lists, nearest first."""
        return np.argsort(-np.round(vectors @ self.centroids.T, 9), axis=1, kind="stable")

    def probed(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        """For each vector and list whether the vector looks in it."""
        out = np.zeros((len(vectors), len(self.centroids)), bool)
        np.put_along_axis(out, self.order(vectors)[:, :probes], True, 1)
        return out


def with_list(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``rows`` (with vector) and the list each belongs to; a null vector has none and is left out."""
    let_workers_import(rows.sparkSession)
    rows = rows.where("vector is not null")
    at, names = rows.columns.index("vector"), [*rows.columns, "list"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = np.round(matrix(batch.column(at)) @ centroids.T, 9).argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, list int")


def _sample(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows whose id has the smallest hash."""
    return rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(n)


def _fitted(rows: DataFrame, cfg: Config) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    usable = rows.where(F.col("vector").isNotNull() & (norm(F.col("vector")) > 0))
    n = usable.count()
    lists = max(1, min(cfg.index_lists or min(MOST_LISTS, round(n**0.5)), cfg.index_sample, n))
    sample = _sample(usable, cfg.index_sample).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    if lists == 1:
        first = sample.first()
        centroids = np.array([first[0].toArray()]) if first else np.zeros((1, 1))
    else:
        centroids = np.array(KMeans(k=lists, distanceMeasure="cosine", maxIter=10, seed=11).fit(sample).clusterCenters())
    return centroids / np.maximum(np.sqrt((centroids**2).sum(1, keepdims=True)), 1e-30)


def build_index(spark: SparkSession, rows: DataFrame, path: str, cfg: Config) -> Index:
    """An index of all ``rows`` (chunk_id, patent_id, vector, home) at ``path``, with its recall measured against exact search.

    cfg.index_sample rows at most fit the centroids, and cfg.index_queries of them are the queries of the measurement,
    which runs over all rows. Of an empty table one list is made.
    """
    rows = rows.select("chunk_id", "patent_id", "vector", "home")
    index = Index(path, _fitted(rows, cfg), np.ones(1))
    lists = list_table(spark, path, cfg)
    lists.upsert(with_list(rows, index.centroids))
    asked = _sample(rows.where("vector is not null"), cfg.index_queries).select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query_vector"))
    hits = vector_search(asked, lists.rows().select(F.col("chunk_id").alias("id"), "vector", F.col("list").alias("part")), cfg)
    found = hits.groupBy("query_id").agg(F.collect_list("part").alias("parts")).join(asked, "query_id").collect()  # cfg.index_queries rows at most
    n, seen = len(index.centroids), np.zeros(len(index.centroids), np.int64)
    for r in found:
        place = np.argsort(index.order(np.array([r.query_vector], np.float64))[0])  # of each list in the query's order
        seen += np.bincount(place[r.parts], minlength=n)
    index.recall = np.cumsum(seen) / max(1, seen.sum()) if seen.sum() else np.ones(n)
    known = [(i, c.tolist(), float(q)) for i, (c, q) in enumerate(zip(index.centroids, index.recall, strict=True))]
    spark.createDataFrame(known, "list int, centroid array<double>, recall double").coalesce(1).write.parquet(f"{path}/centroids")
    return index


def load_index(spark: SparkSession, path: str) -> Index | None:
    if not path_exists(spark, f"{path}/centroids/_SUCCESS"):
        return None
    known = spark.read.schema("list int, centroid array<double>, recall double").parquet(f"{path}/centroids").orderBy("list").collect()  # MOST_LISTS rows at most
    return Index(path, np.array([r.centroid for r in known]), np.array([r.recall for r in known]))


def add_to_index(spark: SparkSession, index: Index, rows: DataFrame, cfg: Config, replace_owner: bool = False, gone: DataFrame | None = None) -> None:
    """Takes rows that the collection has taken into the lists of the centroids there are."""
    list_table(spark, index.path, cfg).upsert(with_list(rows.select("chunk_id", "patent_id", "vector", "home"), index.centroids), replace_owner, gone)


def approximate_search(queries: DataFrame, index: Index, cfg: Config, probes: int | None = None) -> DataFrame:
    """query_id, id, part (home), vector_score, vector_rank as ``vector_search`` gives them, from ``probes`` lists a query: by default
    as many as gave a recall of cfg.index_recall. With all lists probed the result is the exact one."""
    lists = list_table(queries.sparkSession, index.path, cfg)
    kind = lists.version().schema["chunk_id"].dataType.simpleString()
    probes = probes or index.probes(cfg.index_recall)
    rows = lambda wanted: lists.rows(wanted).select(F.col("chunk_id").alias("id"), "vector", F.col("list").alias("part"), "home")
    return nearest(queries, rows, cfg, kind, lambda asked: index.probed(asked, probes))
