"""Greedy, token-bounded chunks of a section's units, with overlap from the chunk before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.config import Config
from gritstone.functions.text import all_costs, all_tokens, let, sentences, strip_end, token_count, tokens_of, word_count


def last_sentence(text: Column) -> Column:
    return let(F.coalesce(F.try_element_at(sentences(text), F.lit(-1)), F.lit("")), strip_end)


def chunk_starts(tokens: Column, carried: Column | Callable[[Column], Column], cfg: Config) -> Column:
    """Array of (unit, overlap): first unit of each chunk and the tokens it takes over from the unit before.

    A fold over the section's units. ``carried`` has, or gives by a unit's number, the tokens that a unit hands on; it is asked
    only where a chunk ends. Overlap counts towards the budget and is left out where it and the next unit do not fit. The state's
    array grows once for a chunk, not once for a unit.
    """
    most = cfg.max_chunk_tokens
    handed_on = (lambda i: F.get(carried, i)) if isinstance(carried, Column) else carried
    empty = F.struct(
        F.lit(0).alias("size"), F.lit(0).alias("unit"),
        F.array().cast("array<struct<unit:int,overlap:int>>").alias("starts"),
    )

    def step(acc: Column, tokens: Column) -> Column:
        first, following = F.size(acc["starts"]) == 0, (acc["unit"] + 1).alias("unit")

        def opened(overlap: Column) -> Column:
            start = F.struct(acc["unit"].alias("unit"), overlap.alias("overlap"))
            return F.struct((overlap + tokens).alias("size"), following, F.array_append(acc["starts"], start).alias("starts"))

        stays = ~first & (acc["size"] + tokens <= most)
        handed = F.when(first, F.lit(0)).otherwise(handed_on(acc["unit"] - 1))
        overlap = let(handed, lambda c: F.when(c + tokens > most, F.lit(0)).otherwise(c))
        return F.when(stays, F.struct((acc["size"] + tokens).alias("size"), following, acc["starts"].alias("starts"))).otherwise(let(overlap, opened))

    return F.aggregate(tokens, empty, step, lambda acc: acc["starts"])


def section_chunks(section_units: DataFrame, cfg: Config) -> DataFrame:
    """One row for each chunk: ids, chunk_no (from 0 in its section), text, sizes, overlap and offsets.

    Takes the rows of ``units.section_units``. Each section is folded within its row, so no chunk or overlap crosses a
    section and nothing is shuffled; a chunk's row carries its own units alone.
    """
    carried = {"last_sentence": last_sentence, "last_unit": lambda t: t, "none": lambda _: F.lit("")}[cfg.overlap_strategy]
    ids = ["patent_id", "section_idx", "section"]
    tail = lambda i: carried(F.get("units", i)["text"])
    if cfg.token_counter == "regex":
        rows, of_tail = section_units.select(*ids, "units"), lambda i: token_count(tail(i))
        own = F.transform("units", lambda u: u["token_count"])
    else:  # these see all texts of a section together
        rows = section_units.select(*ids, "units").withColumn("tail_tokens", all_tokens(F.transform("units", lambda u: carried(u["text"])), cfg))
        of_tail = F.col("tail_tokens")
        # of a counter that joins text to text, what counts is a unit's share of its chunk
        own = all_costs(F.transform("units", lambda u: u["text"]), cfg)
    rows = rows.withColumn("costs", own)
    rows = rows.withColumn("starts", chunk_starts(F.col("costs"), of_tail, cfg)).select(*ids, "units", "starts")

    def part(s: Column, i: Column) -> Column:
        n = F.coalesce(F.get(F.col("starts"), i + 1)["unit"], F.size("units")) - s["unit"]
        return F.struct(
            i.alias("chunk_no"), s["unit"].alias("first"), s["overlap"].alias("overlap"), F.slice("units", s["unit"] + 1, n).alias("own"),
            F.when(s["overlap"] > 0, tail(s["unit"] - 1)).alias("tail"), F.get("units", s["unit"] - 1)["end_offset"].alias("tail_end"),
        )

    rows = rows.select(*ids, F.explode(F.transform("starts", part)).alias("c"))
    texts = F.transform("c.own", lambda u: u["text"])
    rows = rows.withColumn("text", F.array_join(F.when(F.col("c.tail").isNotNull(), F.concat(F.array("c.tail"), texts)).otherwise(texts), " "))
    # the regular expression's tokens don't reach over white space, so those of the parts add up
    tokens = F.aggregate("c.own", F.col("c.overlap"), lambda n, u: n + u["token_count"]) if cfg.token_counter == "regex" else tokens_of(F.col("text"), cfg)
    start = F.when(F.col("c.tail").isNotNull(), F.col("c.tail_end") - F.length("c.tail")).otherwise(F.col("c.own")[0]["start_offset"])
    return rows.select(
        *ids, F.col("c.chunk_no").alias("chunk_no"),
        F.concat_ws("::", "patent_id", F.col("section_idx").cast("string"), F.col("c.chunk_no").cast("string")).alias("chunk_id"),
        "text", F.col("c.first").alias("first_unit"), F.size("c.own").alias("unit_count"), F.col("c.overlap").alias("overlap_tokens"),
        tokens.alias("token_count"), word_count(F.col("text")).alias("word_count"),
        start.cast("int").alias("start_offset"), F.element_at("c.own", -1)["end_offset"].alias("end_offset"),
    )


def chunks(units: DataFrame, cfg: Config) -> DataFrame:
    """``section_chunks`` of units given as rows, such as those of ``units.units``, which are grouped by section first."""
    unit = F.struct("kind", "text", "token_count", "start_offset", "end_offset")
    ordered = F.sort_array(F.collect_list(F.struct("unit_idx", unit.alias("unit"))))
    return section_chunks(units.groupBy("patent_id", "section_idx", "section").agg(F.transform(ordered, lambda x: x["unit"]).alias("units")), cfg)
