"""Vector search for a table of queries, reranking, and results by patent.

Queries go to the rows, never the rows to the queries: the driver takes the queries in passes of cfg.pass_queries, sends
a pass's vectors to every task, and each task scans its rows where they lie and keeps a running top-k. Only k rows a
query and task are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from gritstone.config import Config
from gritstone.functions import models
from gritstone.functions.topk import PLACES, Stats, TopK
from gritstone.sources.scratch import Scratch, let_workers_import
from gritstone.sources.table import Table

#: Hits (ids and numbers, some 100 bytes each) up to which they are sent to every task.
MAX_SENT_HITS = 100_000
#: Queries and groups of which a task holds statistics before it gives them out.
MAX_HELD_STATS = 500_000


def _passes(queries: DataFrame, cfg: Config) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, matrix) of at most cfg.pass_queries queries with a vector; the driver holds one pass."""
    rows = queries.where("query_id is not null and query_vector is not null").select("query_id", "query_vector").toLocalIterator()
    while some := list(islice(rows, cfg.pass_queries)):
        yield [r[0] for r in some], np.array([r[1] for r in some], np.float64)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of a list column as rows of doubles; all must have one length."""
    lens = np.diff(column.offsets.to_numpy())
    if len(set(lens.tolist())) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(set(lens.tolist()))}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lens), -1)


def _values(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _scored(batches: Iterator[pa.RecordBatch], asked: np.ndarray, cfg: Config, probed: np.ndarray | None) -> Iterator[tuple]:
    """(numbers of queries, scores, ids, homes) of blocks of queries and rows; ``probed`` says for each query and part
    whether they meet."""
    for batch in batches:
        for at in range(0, batch.num_rows, cfg.row_block):
            block = batch.slice(at, cfg.row_block)
            ids, v, parts, homes = _values(block.column(0)), matrix(block.column(1)), _values(block.column(2)), _values(block.column(3))
            for p in [None] if probed is None else np.unique(parts).tolist():
                own = slice(None) if p is None else parts == p
                numbers = np.arange(len(asked)) if p is None else np.flatnonzero(probed[:, p])
                for a in range(0, len(numbers), cfg.query_block):
                    some = numbers[a : a + cfg.query_block]
                    yield some, np.round(asked[some] @ v[own].T, PLACES), ids[own], homes[own]


def _scan(rows: DataFrame, queries: DataFrame, cfg: Config, fold: Callable, fields: str, probing: Callable | None = None) -> DataFrame:
    """``fold(blocks, query ids)`` over the rows of each task, for each pass of queries.

    ``rows`` has id, vector, part and perhaps home, which is given to the fold (else part is). ``probing`` gives for a pass's matrix the parts that each query looks in, and
    ``rows`` is then a function of the parts that any of them looks in. No row leaves its task.
    """
    session = queries.sparkSession
    let_workers_import(session)

    def one(ids: list, asked: np.ndarray) -> DataFrame:
        probed = probing(asked) if probing else None
        own = rows if probed is None else rows(np.flatnonzero(probed.any(0)).tolist())
        sent = session.sparkContext.broadcast((ids, asked, probed))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, vectors, probes = sent.value
            yield from fold(_scored(batches, vectors, cfg, probes), names)

        home = F.col("home" if "home" in own.columns else "part").alias("home")
        return own.where("id is not null and vector is not null").select("id", "vector", "part", home).mapInArrow(run, fields)

    found = [one(*p) for p in _passes(queries, cfg)]
    return reduce(DataFrame.unionAll, found) if found else session.createDataFrame([], fields)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def nearest(queries: DataFrame, rows: DataFrame | Callable[[list[int]], DataFrame], cfg: Config, id_kind: str, probing: Callable | None = None) -> DataFrame:
    """query_id, id, part (of ``home``), vector_score, vector_rank of the cfg.vector_top_k nearest rows of each query."""
    k = cfg.vector_top_k
    query_type = queries.schema["query_id"].dataType
    names_type = to_arrow_type(query_type)

    def fold(blocks: Iterator[tuple], names: list) -> Iterator[pa.RecordBatch]:
        best = TopK(len(names), k)
        for some, scores, ids, parts in blocks:
            best.add(some, scores, ids, parts)
        q, s, ids, parts = best.cut()
        if len(q):
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, names_type).take(pa.array(q)), pa.array(ids), pa.array(parts, pa.int32()), pa.array(s)], ["query_id", "id", "part", "score"]
            )

    found = _scan(rows, queries, cfg, fold, f"query_id {query_type.simpleString()}, id {id_kind}, part int, score double", probing)
    return ranked(found.withColumnRenamed("score", "vector_score"), "vector_score", k, "vector_rank", ["id"])


def score_stats(queries: DataFrame, rows: DataFrame, group: str, cfg: Config) -> DataFrame:
    """query_id, ``group``, points, least, mean and most of the scores of each query with the rows of each group (not null)."""
    kinds = _kind(queries, "query_id"), _kind(rows, group)
    names_type, group_type = (to_arrow_type(df.schema[c].dataType) for df, c in ((queries, "query_id"), (rows, group)))

    def fold(blocks: Iterator[tuple], names: list) -> Iterator[pa.RecordBatch]:
        def given(stats: Stats) -> pa.RecordBatch:
            q, groups, *rest = zip(*stats.rows(), strict=True)
            columns = [pa.array([names[i] for i in q], names_type), pa.array(groups, group_type), *map(pa.array, rest)]
            return pa.RecordBatch.from_arrays(columns, ["query_id", "part", "n", "sum", "least", "most"])

        stats = Stats()
        for some, scores, _, groups in blocks:
            stats.add(some, scores, groups)
            if len(stats.seen) * len(names) > MAX_HELD_STATS:
                yield given(stats)
                stats = Stats()
        if stats.seen:
            yield given(stats)

    found = _scan(rows.where(F.col(group).isNotNull()).withColumn("part", F.col(group)), queries, cfg, fold, f"query_id {kinds[0]}, part {kinds[1]}, n long, sum long, least double, most double")
    by = found.groupBy("query_id", F.col("part").alias(group))
    return by.agg(F.sum("n").alias("points"), F.min("least").alias("least"), (F.sum("sum") / F.lit(10.0**PLACES) / F.sum("n")).alias("mean"), F.max("most").alias("most"))


def ranked(scores: DataFrame, by: str, k: int, rank: str, ties: list) -> DataFrame:
    """The best ``k`` of each query, numbered from 1 in column ``rank``."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by), *ties)
    return scores.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def vector_search(queries: DataFrame, rows: DataFrame, cfg: Config) -> DataFrame:
    """query_id, id, vector_score, vector_rank: the cfg.vector_top_k nearest rows of each query; ties go by id.

    ``queries`` has query_id and query_vector, ``rows`` has id and vector, and part if hits are to carry it (a number of
    the row's partition). Scores are dot products, to 6 places. Rows and queries with a null id or vector meet nothing.
    """
    carried = "part" in rows.columns
    rows = rows if carried else rows.withColumn("part", F.lit(0))
    found = nearest(queries, rows, cfg, _kind(rows, "id"))
    return found if carried else found.drop("part")


def with_payload(hits: DataFrame, chunks: DataFrame | Table, queries: DataFrame) -> DataFrame:
    """Hits joined with their chunk's payload (chunk_id) and query text; vectors are not carried.

    Hits are written once. Of a table only the partitions are read that hits lie in (``part``). Where hits are few, their
    ids and scores are sent to the collection, whose text then is not shuffled; where not, both sides are. Query texts are
    joined after that.
    """
    hits = Scratch(hits.sparkSession, "hits").keep(hits.withColumnRenamed("id", "chunk_id"), "hits")
    few = hits.count() <= MAX_SENT_HITS
    if isinstance(chunks, Table):
        named = [r[0] for r in hits.select("part").distinct().collect()]  # no more than the table has partitions
        chunks = chunks.rows(named).drop(chunks.partition)
    hits = hits.drop("part")
    found = chunks.drop("vector").join(F.broadcast(hits) if few else hits, "chunk_id")
    return found.join(queries.select("query_id", "query_text"), "query_id")


def rerank(pairs: DataFrame, cfg: Config) -> DataFrame:
    """``pairs`` (query_text, text, vector_score) with rerank_score and rerank_rank, the best cfg.final_top_k of each query."""
    factory = models.RERANKERS[cfg.reranker_model]

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = models.loaded(factory)
        for q, t, v in batches:
            yield pd.Series(np.round(model(q.fillna("").tolist(), t.fillna("").tolist(), v.to_numpy()), 6))

    scored = pairs.withColumn("rerank_score", score("query_text", "text", "vector_score"))
    return ranked(scored, "rerank_score", cfg.final_top_k, "rerank_rank", ["vector_rank", "chunk_id"])


def by_patent(ranked_chunks: DataFrame) -> DataFrame:
    """query_id, patent_id, score, best_chunk, matching_chunks (best first), metadata and patent_rank of every patent with a
    hit; patents of a query are ranked by score, then id."""
    chunk = F.struct("chunk_id", "section", "text", "rerank_score", "rerank_rank")
    meta = [F.first("metadata").alias("metadata")] if "metadata" in ranked_chunks.columns else []
    found = ranked_chunks.groupBy("query_id", "patent_id").agg(
        F.max("rerank_score").alias("score"),
        F.min_by(chunk, "rerank_rank").alias("best_chunk"),
        F.transform(F.sort_array(F.collect_list(F.struct("rerank_rank", chunk.alias("chunk")))), lambda x: x["chunk"]).alias("matching_chunks"),
        *meta,
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "patent_id")  # cfg.final_top_k rows at most
    return found.withColumn("patent_rank", F.row_number().over(order))
