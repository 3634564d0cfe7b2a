"""Reports on a collection of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def indexed_summary(chunks: DataFrame) -> DataFrame:
    """Per patent: chunks, sections, tokens and, where there is any, metadata."""
    meta = [F.first("metadata").alias("metadata")] if "metadata" in chunks.columns else []
    return chunks.groupBy("patent_id").agg(
        F.count("*").alias("chunks"), F.countDistinct("section").alias("sections"), F.sum("token_count").alias("tokens"), *meta
    )


def section_breakdown(chunks: DataFrame) -> DataFrame:
    """Per patent and section: chunks and their tokens in sum, least, most and mean (6 places)."""
    t = "token_count"
    return chunks.groupBy("patent_id", "section").agg(
        F.count("*").alias("chunks"), F.sum(t).alias("tokens"), F.min(t).alias("min_tokens"), F.max(t).alias("max_tokens"), F.round(F.avg(t), 6).alias("avg_tokens")
    )


def collection_report(chunks: DataFrame) -> DataFrame:
    """Summary and breakdown in one pass: a row for each section, each patent and the whole collection.

    level (section, patent, collection), patent_id and section (null above them), chunks, sections and tokens with the
    least, most and mean of a chunk (6 places). Chunks are counted once, by section; the levels above add up those rows,
    so one scan does. A null patent_id or section is a group of its own, told from the levels above by ``level``.
    An empty collection has one row of level collection without chunks.
    """
    t = "token_count"
    own = chunks.groupBy("patent_id", "section").agg(F.count("*").alias("n"), F.sum(t).alias("sum"), F.min(t).alias("least"), F.max(t).alias("most"), F.count(t).alias("counted"))
    level = F.when(F.grouping_id() == 0, "section").when(F.grouping_id() == 1, "patent").otherwise("collection")
    return own.rollup("patent_id", "section").agg(
        level.alias("level"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.count("*").alias("sections"), F.sum("sum").alias("tokens"),
        F.min("least").alias("min_tokens"), F.max("most").alias("max_tokens"), F.round(F.sum("sum") / F.nullif(F.sum("counted"), F.lit(0)), 6).alias("avg_tokens"),
    )
