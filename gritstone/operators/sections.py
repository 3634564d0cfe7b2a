"""Section detection: lines, headings, and one row for each isolated section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.config import Config
from gritstone.functions.text import heading_name, is_heading, running_sums

PREAMBLE = "PREAMBLE"


def lines(patents: DataFrame) -> DataFrame:
    """patent_id, line_no, line; blank lines at the end stay, a null text is one empty line."""
    return patents.select("patent_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))


def sections(patents: DataFrame, cfg: Config) -> DataFrame:
    """patent_id, section_idx, section, body, body_start: text after each heading, and before the first as PREAMBLE.

    Headings are no part of the body; a heading with no line after it opens no section. Sections are cut within a text's
    row. Whole texts are dealt out by patent_id once; what follows by patent needs no other shuffle.
    """
    whole = patents.repartition("patent_id").select("patent_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("ls"))
    rows = whole.withColumn("heads", F.filter(F.sequence(F.lit(0), F.size("ls") - 1), lambda i: is_heading(F.get("ls", i), cfg)))
    none = F.lit(None).cast("int")
    # a section lies between one heading and the next; the first has none before it
    bounds = F.zip_with(F.concat(F.array(none), F.col("heads")), F.concat(F.col("heads"), F.array(F.size("ls"))), lambda a, b: F.struct(a.alias("head"), b.alias("end")))

    def part(x: Column, i: Column) -> Column:
        first = F.coalesce(x["head"] + 1, F.lit(0))
        head = F.get("ls", x["head"])
        return F.struct(
            i.alias("section_idx"), F.when(x["head"].isNull(), PREAMBLE).otherwise(heading_name(head)).alias("section"),
            F.when(x["end"] > first, F.array_join(F.slice("ls", first + 1, x["end"] - first), "\n")).alias("body"),
            F.coalesce(F.length(head) + 1, F.lit(0)).alias("head_chars"),
        )

    rows = rows.select("patent_id", F.transform(bounds, part).alias("parts"))
    rows = rows.withColumn("before", running_sums(F.transform("parts", lambda p: p["head_chars"] + F.coalesce(F.length(p["body"]) + 1, F.lit(0)))))
    placed = F.zip_with("parts", "before", lambda p, b: p.withField("body_start", (p["head_chars"] + b).cast("int")))
    rows = rows.select("patent_id", F.explode(F.filter(placed, lambda p: p["body"].isNotNull())).alias("p"))
    return rows.select("patent_id", "p.section_idx", "p.section", "p.body", "p.body_start")
