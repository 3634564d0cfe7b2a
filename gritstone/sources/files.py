"""Patent files: whole text files with JSON metadata beside them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KNOWN = ["patent_id", "title", "filing_date", "classification_codes", "inventors"]


def _stem(suffix: str):
    """File name without its suffix; Spark gives names as parts of a URI, where a plus sign stands for itself."""
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return F.regexp_extract(name, rf"(?s)^(.*)\.{suffix}$", 1)


def literal(path: str) -> str:
    """A path whose characters Spark's reader takes as they are, not as a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def text_files(spark: SparkSession, *paths: str) -> DataFrame:
    """stem, text: one row for each .txt file of folders or among files."""
    if not paths:
        return spark.createDataFrame([], "stem string, text string")
    raw = spark.read.option("pathGlobFilter", "*.txt").text(list(paths), wholetext=True)
    return raw.select(_stem("txt").alias("stem"), F.col("value").alias("text"))


def metadata_files(spark: SparkSession, *paths: str) -> DataFrame:
    """stem, patent_id, metadata: one row for each .json file; keys other than the known ones are kept in ``extra``."""
    if not paths:
        return parsed_metadata(spark.createDataFrame([], "stem string, value string"))
    raw = spark.read.option("pathGlobFilter", "*.json").text(list(paths), wholetext=True)
    return parsed_metadata(raw.select(_stem("json").alias("stem"), "value"))


def parsed_metadata(raw: DataFrame) -> DataFrame:
    """stem, patent_id, metadata from stem and value, the JSON text."""
    known = "patent_id string, title string, filing_date string, classification_codes array<string>, inventors array<string>"
    rows = raw.select("stem", F.from_json("value", known).alias("m"), F.from_json("value", "map<string,string>").alias("all"))
    extra = F.map_filter("all", lambda k, _: ~k.isin(*KNOWN))
    meta = F.struct(
        F.col("m.title").alias("title"), F.try_to_date("m.filing_date").alias("filing_date"),
        F.col("m.classification_codes").alias("classification_codes"), F.col("m.inventors").alias("inventors"), extra.alias("extra"),
    )
    return rows.select("stem", F.col("m.patent_id").alias("patent_id"), meta.alias("metadata"))


def load_patents(spark: SparkSession, folder: str) -> DataFrame:
    """patent_id, text, metadata: texts with the metadata beside them; a text without any has null metadata and its stem as id."""
    return with_metadata(text_files(spark, folder), metadata_files(spark, folder)).drop("stem")


def with_metadata(texts: DataFrame, metadata: DataFrame) -> DataFrame:
    joined = texts.join(metadata, "stem", "left")
    return joined.select(F.coalesce("patent_id", "stem").alias("patent_id"), "text", "metadata", "stem")
