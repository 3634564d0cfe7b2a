"""Chunk validation: one reason for each rejected chunk, and the indexes of those that stay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gritstone.config import Config
from gritstone.functions.text import alpha_ratio, collapse_whitespace, is_heading, share_of, tokens_of, word_count, word_tokens
from gritstone.functions.words import blocks, in_text_before, words
from gritstone.sources.scratch import let_workers_import


def is_heading_only(norm: Column, cfg: Config) -> Column:
    return is_heading(norm, cfg)


def _new_in_section(rows: DataFrame) -> DataFrame:
    """``rows`` with ``prev``, the chunk before in the section, ``words``, the number of their ``tokens`` (left out), and
    ``new``, how many of these no chunk before has.

    A task reads its chunks in order and holds the words of one section at a time, so no word becomes a row of its own.
    """
    let_workers_import(rows.sparkSession)
    kept = [f for f in rows.schema.fields if f.name != "tokens"]
    names, key = [f.name for f in kept], ["patent_id", "section_idx", "chunk_no"]
    at = [names.index(k) for k in key]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        section, before, seen = None, None, set()
        for batch in batches:
            prev, new, words = [], [], []
            for patent, idx, no, own in zip(*(batch.column(i).to_pylist() for i in [*at, len(names)]), strict=True):
                if section != (patent, idx):
                    section, before, seen = (patent, idx), None, set()
                known = len(seen)
                seen.update(own or ())
                prev.append(before)
                new.append(len(seen) - known)
                words.append(len(own) if own is not None else None)
                before = no
            more = [pa.array(c, pa.int32()) for c in (prev, new, words)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *more], [*names, "prev", "new", "words"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    ordered = rows.repartition("patent_id").sortWithinPartitions(*key).select(*[F.col(f"`{c}`") for c in names], "tokens")
    return ordered.mapInArrow(count, f"{fields}, prev int, new int, words int")


def _new_words(texts: Column, *section: str) -> Column:
    """(new, words, letters) of each text: distinct words, those of them that the text before it in its section does not
    have (null without one), and letters. Rows must come by section, in the order of their chunks.
    """

    @F.arrow_udf("struct<new:int,words:int,letters:int>")
    def count(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        before, last = None, pa.array([], pa.string())  # the row before, and its words
        for columns in batches:
            out = [pa.array([], pa.struct([(n, pa.int32()) for n in ("new", "words", "letters")]))]
            for texts, *ids in blocks(*columns):
                found, counts, letters = words(texts)
                distinct, again = in_text_before(last, found, counts)
                keys = [before, *zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in [*ids, texts.is_null()]), strict=True)]
                first = np.array([a != b or b[-1] for a, b in zip(keys, keys[1:], strict=False)])
                nulls = np.array([k[-1] for k in keys[1:]])
                out.append(pa.StructArray.from_arrays(
                    [pa.array((distinct - again).astype(np.int32), mask=first), pa.array(distinct.astype(np.int32), mask=nulls), pa.array(letters.astype(np.int32))], ["new", "words", "letters"]
                ))
                before, last = keys[-1], found.slice(len(found) - int(counts[-1]))
            yield pa.concat_arrays(out)

    # what it gives depends on the rows before, so no filter may move below it
    return count.asNondeterministic()(texts, *section)


def judged(chunks: DataFrame, cfg: Config, counted: bool = False) -> DataFrame:
    """``chunks`` with text normalised, alpha_ratio, novelty (null for a section's first) and reject_reason (null: valid).

    Novelty is the share of a chunk's distinct words that the chunk before it in its section does not have, or none of
    those before it (``novelty_against``). Chunks of a section are told apart by chunk_no. ``counted`` says that the rows
    are those of ``section_chunks``: still dealt out by patent_id alone, as ``sections`` does, and token_count and word_count are those of the
    text; single white space changes neither word_count nor the regular expression's tokens, so these are then not counted
    again.
    """
    rows = chunks.withColumn("text", collapse_whitespace(F.col("text")))
    if not (counted and cfg.token_counter == "regex"):
        rows = rows.withColumn("token_count", tokens_of(F.col("text"), cfg)).withColumn("word_count", word_count(F.col("text"))).repartition("patent_id")
    # windows come before steps in Python, after which Spark no longer knows that a patent's rows lie together
    same = Window.partitionBy("patent_id", F.md5(F.col("text").cast("binary"))).orderBy("section_idx", "chunk_no")
    rows = rows.withColumn("copy_no", F.row_number().over(same))
    short = F.col("token_count") < cfg.min_chunk_tokens
    if cfg.keep_only_chunk:
        rows = rows.withColumn("of_section", F.count("*").over(Window.partitionBy("patent_id", "section_idx")))
        short = short & (F.col("of_section") > 1)
    if cfg.novelty_against == "section":
        rows = _new_in_section(rows.withColumn("tokens", word_tokens(F.col("text"))))
        new, alpha = F.when(F.col("prev").isNotNull(), F.col("new")), alpha_ratio(F.col("text"))
    elif cfg.novelty_against == "previous":
        let_workers_import(rows.sparkSession)
        ordered = rows.sortWithinPartitions("patent_id", "section_idx", "chunk_no").withColumn("n", _new_words(F.lower("text"), "patent_id", "section_idx"))
        rows = ordered.withColumns({c: F.col(f"n.{c}") for c in ("new", "words", "letters")}).drop("n")
        new, alpha = F.col("new"), share_of(F.col("letters"), F.col("text"))
    else:
        raise ValueError(f"novelty_against is previous or section, not {cfg.novelty_against!r}")
    rows = rows.withColumn("alpha_ratio", alpha).withColumn("novelty", new / F.nullif("words", F.lit(0))).drop("prev", "new", "words", "letters")
    reason = (
        F.when(F.lit(cfg.reject_heading_only) & is_heading_only(F.col("text"), cfg), "heading_only")
        .when(F.col("alpha_ratio") < cfg.low_info_threshold, "low_information")
        .when(F.col("novelty") < cfg.min_novelty, "degenerate_overlap")
        .when(short, "too_short")
        .when(F.col("copy_no") > 1, "duplicate")
    )
    return rows.withColumn("reject_reason", reason).drop("copy_no", "of_section")


def indexed(judged_chunks: DataFrame) -> DataFrame:
    """The valid chunks with section_chunk_index, document_chunk_index (from 0) and total_chunks."""
    section = Window.partitionBy("patent_id", "section_idx").orderBy("chunk_no")
    document = Window.partitionBy("patent_id").orderBy("section_idx", "chunk_no")
    return (
        judged_chunks.where("reject_reason is null")
        .withColumn("section_chunk_index", F.row_number().over(section) - 1)
        .withColumn("document_chunk_index", F.row_number().over(document) - 1)
        .withColumn("total_chunks", F.count("*").over(Window.partitionBy("patent_id")).cast("int"))
    )


def validation_report(judged_chunks: DataFrame) -> DataFrame:
    return judged_chunks.groupBy(F.coalesce("reject_reason", F.lit("valid")).alias("outcome"), "section").agg(F.count("*").alias("chunks"))
