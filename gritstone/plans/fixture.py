"""Views that give the driver's tables the shape of the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.config import Config

#: The tables have one line for a paragraph and 64 dimensions.
TABLE_CONFIG = Config(paragraph_separator=r"\n", vector_size=64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patent_id(doc_id) -> F.Column:
    return F.concat(F.lit("US"), F.lpad(doc_id.cast("string"), 8, "0"))


def patents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as patents: the same lines with standard headings put before some of them."""
    docs = table(spark, sf_dir, "documents")
    n = F.size("ls")

    def headed(line, i):
        heading = (
            F.when(i == 0, "ABSTRACT\n").when((i == 1) & (n > 3), "BACKGROUND OF THE INVENTION\n")
            .when((i == 2) & (n > 4), "Detailed Description:\n").when((i == n - 1) & (n > 1), "CLAIMS\n").otherwise("")
        )
        return F.concat(heading, line)

    rows = docs.select("doc_id", "lang", "source", "n_chars", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("ls"))
    return rows.select(
        patent_id(F.col("doc_id")).alias("patent_id"), F.array_join(F.transform("ls", headed), "\n").alias("text"),
        F.struct("lang", "source", "n_chars").alias("metadata"),
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
