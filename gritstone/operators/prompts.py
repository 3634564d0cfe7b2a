"""Prompts: instructions, a block for each patent, and the question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INSTRUCTIONS = "Answer from the patent excerpts below and from nothing else. If they do not hold the answer, say so."


def context_blocks(results: DataFrame) -> DataFrame:
    """query_id, patent_id, score and block, the text that shows a patent's matching chunks."""
    part = F.transform("matching_chunks", lambda c: F.concat(F.lit("["), c["section"], F.lit(" | "), c["chunk_id"], F.lit("]\n"), c["text"]))
    block = F.concat(F.lit("Patent "), "patent_id", F.lit(" (score "), F.format_number("score", 4), F.lit(")\n"), F.array_join(part, "\n"))
    return results.select("query_id", "patent_id", "score", block.alias("block"))


def prompts(results: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id and prompt, patents by score; queries without results get a prompt without blocks."""
    blocks = context_blocks(results)
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "patent_id", "block")))
    joined = blocks.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda b: b["block"]), "\n\n").alias("context"))
    text = F.concat(F.lit(f"{INSTRUCTIONS}\n\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), F.coalesce("query_text", F.lit("")), F.lit("\nAnswer:"))
    return queries.select("query_id", "query_text").join(joined, "query_id", "left").select("query_id", text.alias("prompt"))
