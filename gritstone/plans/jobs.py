"""End-to-end jobs: ingest, search, prompts and report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.config import Config
from gritstone.operators.chunks import section_chunks
from gritstone.operators.embed import embed
from gritstone.operators.inverted_file import Index, add_to_index, approximate_search, index_path, load_index
from gritstone.operators.inverted_file import build_index as index_rows
from gritstone.operators.prompts import prompts
from gritstone.operators.report import indexed_summary, section_breakdown
from gritstone.operators.search import by_patent, rerank, vector_search, with_payload
from gritstone.operators.sections import sections
from gritstone.operators.units import section_units
from gritstone.operators.validate import indexed, judged
from gritstone.sources.files import load_patents
from gritstone.sources.paths import delete
from gritstone.sources.scratch import Scratch
from gritstone.sources.sink import Store, write_points
from gritstone.sources.table import Table, bucket, collection, latest, read_collection

PAYLOAD = [
    "patent_id", "section", "text", "chunk_id", "section_chunk_index", "document_chunk_index", "total_chunks", "token_count", "word_count",
    "start_offset", "end_offset", "metadata",
]


def built_chunks(patents: DataFrame, cfg: Config) -> DataFrame:
    """All chunks of ``patents``, before validation."""
    return section_chunks(section_units(sections(patents.select("patent_id", "text"), cfg), cfg), cfg)


def valid_chunks(patents: DataFrame, cfg: Config) -> DataFrame:
    """Valid chunks with their indexes."""
    return indexed(judged(built_chunks(patents, cfg), cfg, counted=True))


def payload(patents: DataFrame, cfg: Config) -> DataFrame:
    """The payload of each valid chunk, with its patent's metadata where there is any."""
    rows = valid_chunks(patents, cfg)
    if "metadata" in patents.columns:
        rows = rows.join(patents.select("patent_id", "metadata"), "patent_id", "left")
    else:
        rows = rows.withColumn("metadata", F.lit(None).cast("string"))
    return rows.select(PAYLOAD)


def embedded_chunks(patents: DataFrame, cfg: Config) -> DataFrame:
    """The payload and vector of each valid chunk."""
    return embed(payload(patents, cfg), cfg)


def hashed(rows: DataFrame, cfg: Config) -> DataFrame:
    """Payload rows with text_hash, of what the vector is made from (model and text), and row_hash, of all there is."""
    model = F.lit(f"{cfg.embedding_model}/{cfg.vector_size}/")
    return rows.withColumn("text_hash", F.md5(F.concat(model, F.coalesce("text", F.lit(""))))).withColumn("row_hash", F.md5(F.concat(model, F.to_json(F.struct(*PAYLOAD)))))


def store(spark: SparkSession, rows: DataFrame, cfg: Config, gone: DataFrame | None = None) -> None:
    """Payload rows into the collection at cfg.table_path and its index, if there is one; chunks of patents in ``gone`` go.

    Rows that the collection holds as they are, are left out; of those with the same text the stored vector is taken; so
    the model sees new and changed texts alone. Hashes decide that, from the partitions that ``rows`` touch.
    """
    table, scratch = collection(spark, cfg.table_path, cfg), Scratch(spark, "ingest")
    new = hashed(rows, cfg).withColumn("bucket", bucket(cfg))
    try:
        if table.exists() and {"text_hash", "row_hash"} <= set(table.version().schema.names):
            new = scratch.keep(new, "new")
            if new.groupBy("chunk_id").count().where("count > 1").limit(1).count():
                new = scratch.keep(latest(new), "single")
            old = table.rows([r[0] for r in new.select("bucket").distinct().collect()])  # cfg.buckets numbers at most
            seen = old.select("chunk_id", F.col("text_hash").alias("old_text"), F.col("row_hash").alias("old_row"))
            changed = new.join(seen, "chunk_id", "left").where("old_row is null or old_row <> row_hash")
            changed = scratch.keep(changed.withColumn("known", F.coalesce(F.expr("old_text = text_hash"), F.lit(False))).drop("old_text", "old_row"), "changed")
            kept = changed.where("known").join(old.select("chunk_id", "vector"), "chunk_id")
            rows = embed(changed.where("not known"), cfg).unionByName(kept).drop("known")
        else:
            rows = embed(new, cfg)
        segment = table.upsert(rows, gone=gone)
        index = load_index(spark, index_path(cfg)) if segment else None
        if index:
            add_to_index(spark, index, _points(table.segment_rows(segment)), cfg, gone=gone)
    finally:
        scratch.clear()


def ingest(spark: SparkSession, folder: str, cfg: Config) -> None:
    """Files of a folder into the collection at cfg.table_path; files that have not changed cost no model call."""
    store(spark, payload(load_patents(spark, folder), cfg), cfg)


def export(spark: SparkSession, connect: Callable[[], Store], cfg: Config) -> str:
    """All points of the collection, with vectors, into a store outside of Spark; all of them are published, or none."""
    return write_points(read_collection(spark, cfg.table_path), connect, cfg)


def _points(rows: DataFrame) -> DataFrame:
    return rows.select("chunk_id", "patent_id", "vector", F.col("bucket").alias("home"))


def build_index(spark: SparkSession, cfg: Config) -> Index:
    """An inverted file of the collection, in place of the one there is; later ingests add to it."""
    delete(spark, index_path(cfg))
    return index_rows(spark, _points(collection(spark, cfg.table_path, cfg).rows()), index_path(cfg), cfg)


def search_chunks(queries: DataFrame, table: Table, cfg: Config) -> DataFrame:
    """Reranked chunks of every query; ``queries`` has query_id and query_text. With cfg.approximate the index is asked."""
    asked = embed(queries.select("query_id", "query_text"), cfg, "query_text", "query_vector")
    index = load_index(queries.sparkSession, index_path(cfg)) if cfg.approximate else None
    if index:
        hits = approximate_search(asked, index, cfg)
    else:
        hits = vector_search(asked, table.rows().select(F.col("chunk_id").alias("id"), "vector", F.col("bucket").alias("part")), cfg)
    return rerank(with_payload(hits, table, queries), cfg)


def search(spark: SparkSession, queries: DataFrame, cfg: Config) -> DataFrame:
    """Results by patent for every query, from the collection at cfg.table_path."""
    return by_patent(search_chunks(queries, collection(spark, cfg.table_path, cfg), cfg))


def build_prompts(results: DataFrame, queries: DataFrame) -> DataFrame:
    return prompts(results, queries)


def report(spark: SparkSession, cfg: Config, verbose: bool = False) -> DataFrame:
    rows = read_collection(spark, cfg.table_path)
    return section_breakdown(rows) if verbose else indexed_summary(rows)
