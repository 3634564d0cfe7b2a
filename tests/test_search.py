"""Vector search in the scan, and the inverted file, against brute force."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.config import Config
from gritstone.functions.topk import TopK
from gritstone.operators import inverted_file as I
from gritstone.operators import search as Q

CFG = replace(Config(), vector_top_k=4, query_block=3, row_block=5, pass_queries=7)


def made(seed, n, dims, text=False, grid=False):
    r = random.Random(seed)
    value = (lambda: r.choice([-1.0, 0.0, 1.0])) if grid else (lambda: r.gauss(0, 1))
    return [(f"id{i:04d}" if text else i, [value() for _ in range(dims)]) for i in range(n)]


def brute(asked, rows, k):
    out = {}
    for q, a in asked:
        scores = sorted((-round(float(np.dot(a, v)), 6) + 0.0, i) for i, v in rows if v is not None)
        out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def got(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (str(r.query_id), r.vector_rank)):
        out.setdefault(r.query_id, []).append((r.id, r.vector_score))
    return out


@pytest.mark.parametrize(("text", "grid"), [(False, False), (True, True), (False, True)])
def test_search_equals_brute_force_with_ties_and_passes(spark, text, grid):
    asked, rows = made(1, 17, 6, not text, grid), made(2, 90, 6, text, grid)
    q = spark.createDataFrame([*asked, (asked[0][0], None)], f"query_id {'long' if text else 'string'}, query_vector array<float>")
    p = spark.createDataFrame([*rows, ("zz" if text else 999, None)], f"id {'string' if text else 'long'}, vector array<double>").repartition(6)
    f = [(i, np.float32(v).astype(float)) for i, v in asked]
    assert got(Q.vector_search(q, p, CFG)) == brute(f, rows, 4)
    assert Q.vector_search(q.where("false"), p, CFG).count() == 0 and Q.vector_search(q, p.where("false"), CFG).count() == 0


def test_no_row_is_shuffled_before_its_scan(spark, tmp_path):
    spark.createDataFrame(made(3, 50, 6), "id long, vector array<double>").write.parquet(str(tmp_path / "v"))
    q = spark.createDataFrame(made(4, 5, 6), "query_id long, query_vector array<double>")
    plan = Q.vector_search(q, spark.read.parquet(str(tmp_path / "v")), CFG)._jdf.queryExecution().sparkPlan().toString()
    below = plan.split("MapInArrow", 1)[1]
    assert "FileScan" in below and "Exchange" not in below and "Join" not in below
    physical = Q.vector_search(q, spark.read.parquet(str(tmp_path / "v")), CFG)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in physical.split("MapInArrow", 1)[1] and "Exchange" in physical.split("MapInArrow", 1)[0]


def test_vectors_that_cannot_be_compared(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query_vector array<double>")
    rows = spark.createDataFrame([(1, [float("nan"), 1.0]), (2, [0.5, 0.0]), (None, [9.0, 0.0])], "id long, vector array<double>").coalesce(1)
    assert got(Q.vector_search(q, rows, CFG)) == {1: [(2, 0.5)]}
    with pytest.raises(Exception, match="different lengths"):
        Q.vector_search(q, rows.union(spark.createDataFrame([(3, [1.0])], "id long, vector array<double>")).coalesce(1), CFG).count()


def test_running_top_k_stays_small_and_right():
    r = np.random.default_rng(5)
    best, seen = TopK(3, 5), []
    for block in range(60):
        s = r.integers(0, 4, (2, 50)).astype(float)
        ids = r.permutation(50) + 50 * block
        best.add(np.array([0, 2]), s, ids, np.zeros(50, int))
        seen += [(q, -s[k, j], ids[j]) for k, q in enumerate((0, 2)) for j in range(50)]
        assert best.size <= 4 * 15 + 200
    q, s, ids, _ = best.cut()
    assert sorted(zip(q.tolist(), (-s).tolist(), ids.tolist(), strict=True)) == [x for n in (0, 2) for x in sorted(y for y in seen if y[0] == n)[:5]]


def test_statistics_by_group(spark):
    asked, rows = made(6, 9, 4), [(i, v, i % 5 if i % 7 else None) for i, v in made(7, 80, 4)]
    q = spark.createDataFrame(asked, "query_id long, query_vector array<double>")
    p = spark.createDataFrame(rows, "id long, vector array<double>, label int").repartition(5)
    found = {(r.query_id, r.label): (r.points, r.least, round(r.mean, 6), r.most) for r in Q.score_stats(q, p, "label", CFG).collect()}
    want = {}
    for k, a in asked:
        for label in range(5):
            s = [round(float(np.dot(a, v)), 6) for _, v, g in rows if g == label]
            want[k, label] = (len(s), min(s), round(sum(s) / len(s), 6), max(s))
    assert set(found) == set(want) and all(found[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def clustered(seed, n, dims, centres):
    r = np.random.default_rng(seed)
    c = np.random.default_rng(99).normal(0, 1, (centres, dims))
    v = c[r.integers(0, centres, n)] + r.normal(0, 0.25, (n, dims))
    return v / np.sqrt((v**2).sum(1, keepdims=True))


def test_inverted_file_recall_exactness_and_upkeep(spark, tmp_path):
    cfg = replace(Config(), vector_top_k=10, index_lists=12, index_queries=60, index_recall=0.97)
    v = clustered(1, 1500, 16, 12)
    rows = [(i, i % 3, x.tolist(), 0) for i, x in enumerate(v)] + [(5000, 1, None, 0)]
    points = spark.createDataFrame(rows, "chunk_id long, patent_id int, vector array<double>, home int").repartition(5)
    index = I.build_index(spark, points, str(tmp_path / "i"), cfg)
    assert np.all(np.diff(index.recall) >= 0) and index.recall[-1] == 1 and index.probes(0.97) < 12
    asked = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(clustered(2, 80, 16, 12))], "query_id long, query_vector array<double>")
    exact = got(Q.vector_search(asked, points.select(F.col("chunk_id").alias("id"), "vector"), cfg))
    again = I.load_index(spark, str(tmp_path / "i"))
    assert np.allclose(again.centroids, index.centroids) and np.allclose(again.recall, index.recall)
    assert got(I.approximate_search(asked, again, cfg, 12)) == exact
    some = got(I.approximate_search(asked, again, cfg))
    share = sum(len(set(exact[q]) & set(some.get(q, []))) for q in exact) / sum(map(len, exact.values()))
    assert share >= 0.9
    one = I.approximate_search(asked.limit(1), again, cfg, 1)
    assert {f.split("list=")[1].split("/")[0] for f in one.inputFiles()} == {str(again.order(np.array([asked.first().query_vector]))[0, 0])}
    moved = spark.createDataFrame([(3, 0, v[700].tolist(), 0), (9000, 7, v[3].tolist(), 0)], "chunk_id long, patent_id int, vector array<double>, home int")
    I.add_to_index(spark, again, moved, cfg)
    now = [(i, x) for i, _, x, _ in rows if i != 3 and x is not None] + [(3, v[700].tolist()), (9000, v[3].tolist())]
    assert got(I.approximate_search(asked, again, cfg, 12)) == brute([(r.query_id, r.query_vector) for r in asked.collect()], now, 10)


def test_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id long, patent_id int, vector array<double>, home int")
    index = I.build_index(spark, none, str(tmp_path / "i"), Config())
    q = spark.createDataFrame([(1, [1.0])], "query_id long, query_vector array<double>")
    assert I.approximate_search(q, index, Config()).count() == 0
