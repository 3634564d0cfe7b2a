"""Semantic units: paragraphs, or their sentences, or pieces of sentences, whichever is the coarsest that fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.config import Config
from gritstone.functions.text import all_costs, all_cut, all_tokens, fragments, running_sums, sentences, strip_end, token_count

SECTION = ["patent_id", "section_idx", "section"]


def paragraphs(body: Column, cfg: Config) -> Column:
    """Paragraphs with the separator after them; together they are the body."""
    if cfg.paragraph_separator == r"\n":  # the same pieces, found in half the time
        return F.regexp_extract_all(body, F.lit(r"(?s).[^\n]*+(?:\n|\z)"), F.lit(0))
    return F.regexp_extract_all(body, F.lit(rf"(?s).+?(?:{cfg.paragraph_separator}|\z)"), F.lit(0))


def _piece(text: Column, kind: Column, cost: Column) -> Column:
    return F.struct(text.alias("piece"), kind.alias("kind"), cost.cast("int").alias("cost"))


def section_units(sections: DataFrame, cfg: Config) -> DataFrame:
    """patent_id, section_idx, section and ``units``, an array of (kind, text, token_count, start_offset, end_offset).

    All is done within a section's row, without a shuffle. Fragments are cut by words and marks, or where a token
    counter's own tokens start; either way each fits. Offsets are code points of the document's text, end exclusive.
    White space at a unit's end is left out; blank pieces are no units.
    """
    regex, most = cfg.token_counter == "regex", cfg.max_chunk_tokens
    words = cfg.fragment_words or most
    cost = token_count if regex else (lambda _: F.lit(None))
    # the regular expression counts a piece once, with or without white space; other counters see all pieces of a level together
    costs = lambda c, of: F.transform(c, lambda x: x["cost"]) if regex else all_costs(F.transform(c, lambda x: strip_end(x[of])), cfg)
    rows = sections.select(*SECTION, "body_start", F.transform(paragraphs(F.col("body"), cfg), lambda p: _piece(p, F.lit("paragraph"), cost(p))).alias("ps"))
    rows = rows.withColumn("fit", F.transform(costs(F.col("ps"), "piece"), lambda c: c <= most))
    cut = F.zip_with("ps", "fit", lambda p, fit: F.when(fit, F.array(p)).otherwise(F.transform(sentences(p["piece"]), lambda s: _piece(s, F.lit("sentence"), cost(s)))))
    rows = rows.select(*SECTION, "body_start", F.flatten(cut).alias("ss"))
    rows = rows.withColumn("fit", F.transform(costs(F.col("ss"), "piece"), lambda c: c <= most))
    if regex or cfg.fragment_words:
        parts = F.zip_with("ss", "fit", lambda s, fit: F.when(fit, F.array(s)).otherwise(F.transform(fragments(s["piece"], words), lambda f: _piece(f, F.lit("fragment"), cost(f)))))
    else:
        rows = rows.withColumn("cuts", all_cut(F.zip_with("ss", "fit", lambda s, fit: F.when(~fit, s["piece"])), cfg))
        parts = F.zip_with("ss", "cuts", lambda s, c: F.when(c.isNull(), F.array(s)).otherwise(F.transform(c, lambda f: _piece(f, F.lit("fragment"), cost(f)))))
    rows = rows.select(*SECTION, "body_start", F.flatten(parts).alias("fs"))
    rows = rows.withColumn("before", running_sums(F.transform("fs", lambda f: F.length(f["piece"]))))
    placed = F.zip_with("fs", "before", lambda f, b: F.struct(f["kind"].alias("kind"), strip_end(f["piece"]).alias("text"), f["cost"].alias("cost"), (F.col("body_start") + b).cast("int").alias("at")))
    rows = rows.select(*SECTION, F.filter(placed, lambda u: F.length(u["text"]) > 0).alias("us"))
    rows = rows.withColumn("tokens", F.transform("us", lambda u: u["cost"]) if regex else all_tokens(F.transform("us", lambda u: u["text"]), cfg))
    unit = lambda u, t: F.struct(
        u["kind"].alias("kind"), u["text"].alias("text"), t.alias("token_count"), u["at"].alias("start_offset"), (u["at"] + F.length(u["text"])).alias("end_offset")
    )
    return rows.select(*SECTION, F.zip_with("us", "tokens", unit).alias("units"))


def units(sections: DataFrame, cfg: Config) -> DataFrame:
    """patent_id, section_idx, section, unit_idx, kind, text, token_count, start_offset, end_offset: a row for each unit."""
    # an inner explode would first test the array's size, in a filter that repeats the whole expression below the projections
    rows = section_units(sections, cfg).select(*SECTION, F.posexplode_outer("units").alias("unit_idx", "unit"))
    return rows.where("unit is not null").select(*SECTION, "unit_idx", "unit.*")
