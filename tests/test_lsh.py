"""Pairs of hashed vectors against Spark's own join, and that no candidate is shuffled."""

import random
from dataclasses import replace

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from gritstone.config import Config
from gritstone.operators.lsh import hashed_pairs
from gritstone.plans.queries import QUERIES


def test_pairs_equal_those_of_sparks_join(spark):
    r = random.Random(5)
    data = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    data += [(i + 300, v) for i, v in data[:20]]  # copies, at distance 0
    rows = spark.createDataFrame(data, "id long, v array<double>").select("id", array_to_vector("v").alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="hashes", bucketLength=0.5, numHashTables=3, seed=2).fit(rows)
    asked = rows.where("id % 5 = 0")
    want = model.approxSimilarityJoin(asked, rows, 1.5, "distance").select("datasetA.id", "datasetB.id", "distance").collect()
    hashed = model.transform(rows).select("id", vector_to_array("v").alias("vector"), F.array(*[vector_to_array(F.get("hashes", F.lit(i)))[0] for i in range(3)]).alias("hashes"))
    found = hashed_pairs(hashed.where("id % 5 = 0").withColumnRenamed("id", "query_id"), hashed.repartition(3), 1.5, replace(Config(), pass_queries=50))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want)) and len(want) > 100


def test_no_queries_and_null_vectors(spark):
    rows = spark.createDataFrame([(1, None, None), (2, [0.0], [0.0])], "id long, vector array<double>, hashes array<double>")
    asked = rows.withColumnRenamed("id", "query_id")
    assert hashed_pairs(asked.limit(0), rows, 1.0, Config()).count() == 0
    assert [tuple(r) for r in hashed_pairs(asked, rows, 1.0, Config()).collect()] == [(2, 2, 0.0)]


def test_the_query_joins_no_candidates(spark, capsys):
    QUERIES["lsh_candidates"](spark, "/root/testdata/sf0.001").explain()
    assert "Join" not in capsys.readouterr().out
