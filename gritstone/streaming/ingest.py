"""Incremental ingest: files that arrive in a folder go through the batch steps and into the collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gritstone.config import Config
from gritstone.plans.jobs import payload, store
from gritstone.sources.files import literal, metadata_files, text_files, with_metadata
from gritstone.sources.paths import path_exists
from gritstone.sources.table import bucket, collection

SUFFIXES = (".txt", ".json")
NAMED = "path string, modificationTime timestamp, length long, content binary"  # content is not read


def _renamed(spark: SparkSession, patents: DataFrame, cfg: Config) -> DataFrame | None:
    """Ids under which texts of ``patents`` were stored before their metadata gave them another one: the stems of those
    texts, where the collection has them without metadata."""
    table = collection(spark, cfg.table_path, cfg)
    if not table.exists() or "metadata" not in table.version().schema.names:
        return None
    stems = patents.where("patent_id <> stem").select(F.col("stem").alias("patent_id"))
    homes = [r[0] for r in stems.select(bucket(cfg).alias("b")).distinct().collect()]  # cfg.buckets numbers at most
    if not homes:
        return None
    return table.rows(homes).where("metadata is null").select("patent_id").join(F.broadcast(stems), "patent_id", "left_semi").distinct()


def stream_ingest(spark: SparkSession, folder: str, checkpoint: str, cfg: Config, once: bool = True) -> StreamingQuery:
    """Starts the stream; with ``once`` it stops when all files there are done.

    Text and metadata of a patent may come in any order and in different batches. A batch is the names of at most
    cfg.files_per_trigger files, which the driver holds; for each stem among them both files are read as they are now. So
    a .json that comes late updates its patent: chunks that were stored under the file's stem are replaced by those with
    the id that the .json gives, and stored vectors are used again, since texts have not changed. A .json without a text
    waits for it in the folder. The state is folder and table: a batch that runs again changes nothing.
    """
    files = (
        spark.readStream.format("binaryFile").schema(NAMED).option("pathGlobFilter", "*.{txt,json}")
        .option("maxFilesPerTrigger", cfg.files_per_trigger).load(folder)
    )

    def write(batch: DataFrame, _: int) -> None:
        own = batch.sparkSession
        stems = sorted({r[0].rsplit(".", 1)[0] for r in batch.collect()})
        texts, found = ([literal(s + x) for s in stems if path_exists(own, s + x)] for x in SUFFIXES)
        if texts:
            patents = with_metadata(text_files(own, *texts), metadata_files(own, *found))
            store(own, payload(patents, cfg), cfg, _renamed(own, patents, cfg))

    out = files.select("path").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
