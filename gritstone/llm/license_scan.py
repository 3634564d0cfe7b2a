"""License scans: ordered signature rules with a keyword prefilter and interval-containment suppression, row by row.

The prefilter is the rules' own keywords, as words of the normalised text, so it loses no match of any rule.

All of it is column expressions over one text column; no shuffle, join or Python code runs on the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.llm.license_rules import signatures
from gritstone.llm.url_filter import LOWER, UPPER

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased text
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Phrases of the base rules and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
BASE_RE = r"(?<= )(?:mit|apache|general public) license(?= )"


def _pieces(text: Column, regex: Column | str) -> Column:
    """Start (in words), number of words and text of every match of ``regex`` in space-joined words."""
    rx = F.lit(regex) if isinstance(regex, str) else regex
    none = F.array().cast("array<struct<start:int,words:int>>")
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    pairs = F.arrays_zip(F.regexp_extract_all(text, rx, F.lit(0)), F.split(text, rx, -1))  # the last has text only
    return F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, m: F.when(m["0"].isNull(), acc).otherwise(
            F.struct(
                (acc["at"] + spaces(m["1"]) + spaces(m["0"])).alias("at"),
                F.array_append(
                    acc["out"],
                    F.struct((acc["at"] + spaces(m["1"]) - 1).alias("start"), (spaces(m["0"]) + 1).alias("words")),
                ).alias("out"),
            )
        ),
    )["out"]


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Words of a text in either case."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def joined(low: Column) -> Column:
    """The words of a lower-cased text with one space before, between and after them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, SEPARATORS, " ")), F.lit(" "))


def _rules() -> Column:
    """All rules as one constant array; written as SQL so that it is made in one call."""
    rows = [
        f"struct({i} AS rank, '{label}' AS label, '{word}' AS word, {score}D AS score, r'(?<= )(?:{regex})(?= )' AS regex)"
        for i, (label, word, score, regex) in enumerate(signatures())
    ]
    return F.expr(f"array({', '.join(rows)})")


def detections(text: Column) -> Column:
    """Array of (start, stop, rank, label, score) of every rule match in space-joined words, before suppression.

    A rule runs only on texts that hold its keyword as a word.
    """
    keys = F.split(F.lit(" ".join(sorted({r[1] for r in signatures()}))), " ")
    once = F.array(F.struct(F.array_intersect(F.split(text, " "), keys).alias("keys"), text.alias("text")))  # for one evaluation
    return F.flatten(
        F.flatten(
            F.transform(
                once,
                lambda d: F.transform(
                    F.filter(_rules(), lambda r: F.array_contains(d["keys"], r["word"])),
                    lambda r: F.transform(
                        _pieces(d["text"], r["regex"]),
                        lambda m: F.struct(
                            m["start"].alias("start"), (-(m["start"] + m["words"])).alias("neg_stop"), r["rank"].alias("rank"),
                            r["label"].alias("label"), r["score"].alias("score"),
                        ),
                    ),
                ),
            )
        )
    )


def survivors(found: Column) -> Column:
    """Labels and best score of the detections that no other contains.

    Ordered by start, then longest, then rank: a detection whose end is not beyond every earlier end is contained in an
    earlier one (or equals it with a lower priority) and goes.
    """
    empty = F.struct(F.lit(-1).alias("stop"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))
    return F.aggregate(
        F.array_sort(found),
        empty,
        lambda acc, m: F.when(-m["neg_stop"] <= acc["stop"], acc).otherwise(
            F.struct(
                (-m["neg_stop"]).alias("stop"),
                F.array_union(acc["labels"], F.array(m["label"])).alias("labels"),
                F.greatest(acc["score"], m["score"]).alias("score"),
            )
        ),
    )


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, base_places (array of start and words), base_labels, labels (arrays) and license_score to ``docs``.

    A null text counts as empty: no words, no places, no labels, score 0. Rows are treated one by one, so repeated rows
    repeat their result; columns of ``docs`` that bear one of the new names are replaced.
    """
    words = F.col("__words")
    none = F.array().cast("array<string>")
    places = F.when(words.contains(" license "), _pieces(words, BASE_RE))
    labels = [F.when(words.contains(f" {p} "), F.lit(v)) for p, v in BASE]
    return (
        docs.withColumn("__words", joined(lowered(F.col(text))))
        .withColumn("n_words", n_words(F.col(text)))
        .withColumn("base_places", F.coalesce(places, F.array().cast("array<struct<start:int,words:int>>")))
        .withColumn("base_labels", F.array_sort(F.array_compact(F.array(*labels))))
        .withColumn("__method", survivors(detections(words)))
        .withColumn("labels", F.array_sort(F.array_union(F.col("base_labels"), F.coalesce(F.col("__method.labels"), none))))
        .withColumn("license_score", F.coalesce(F.col("__method.score"), F.lit(0.0)))
        .drop("__words", "__method")
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    starts = F.transform("base_places", lambda p: p["start"])
    return scan_licenses(docs).select(
        "doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"),
        F.when(F.size("base_places") > 0, F.greatest("license_score", F.lit(0.5))).otherwise(F.col("license_score")).alias("score"),
    )
