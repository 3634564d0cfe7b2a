"""Connected components of a large edge table by alternating star contraction, all in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.llm.store import Scratch

MAX_ROUNDS = 60


def dealt_again(sums: DataFrame, key: str) -> DataFrame:
    """``sums``, one row for each ``key``, as rows that a join must shuffle by itself.

    A join that shares the shuffle of an aggregate keeps all rows of a key in one task; with shuffles of its own on
    both sides, adaptive execution splits a key that many rows of the other side have.
    """
    return sums.withColumn(key, F.col(key) + F.lit(0).cast("long"))


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    ``edges`` has long columns ``a`` and ``b``; self-loops, repeats and either direction are fine, nulls are ignored.
    Each round points every node's larger neighbours, then its smaller ones, at the least node of its neighbourhood;
    the edge set never grows and the rounds needed grow with the logarithm of the longest path. Each round's edges are
    written to the shared scratch folder. An empty table gives an empty table.
    """
    e = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = None
    for _ in range(MAX_ROUNDS):
        both = e.union(e.select("b", "a"))
        low = dealt_again(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "a")
        large = (
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        least = dealt_again(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
            .select("x.a", "x.b").where("a <> b").distinct()
        )
        new = scratch.keep(small, "edges")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(e)
        e = new
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
