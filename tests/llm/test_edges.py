"""Empty tables and repeated rows, for the operators whose own tests hold neither."""

from collections import Counter

import pytest

import corpus_pipeline
from gritstone.llm import decontaminate as D
from gritstone.llm import language_id as I
from gritstone.llm import license_scan as L
from gritstone.llm import packing as P
from gritstone.llm import secret_scan as S
from gritstone.llm import sharding as H

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "under the mit license with secret = abcdefgh1234 and one more line of plain words for a window"


@pytest.fixture
def docs(spark):
    """Every row three times, a null text among them."""
    rows = [(1, LINE, "aa", "s", len(LINE)), (2, None, "aa", "s", None), (3, "", None, None, 0), (4, "other words", "aa", "s", 11)]
    return spark.createDataFrame(rows * 3, DOCS).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_scans_of_no_documents_and_a_network_trained_on_none(none, docs):
    net = S.fit(none.select("doc_id", "text"))
    assert S.find_secrets(none, net).count() == 0 and S.redact(none, net).count() == 0
    assert L.scan_licenses(none).count() == 0
    assert all("abcdefgh1234" not in (r.text or "") for r in S.redact(docs, net).collect())


def test_repeated_rows_are_rows_of_their_own(spark, docs):
    thrice = Counter({1: 3, 2: 3, 3: 3, 4: 3})
    net = S.fit(docs.select("doc_id", "text"))
    items = spark.createDataFrame([(7, LINE), (8, None)] * 2, "item_id long, text string")
    for found in S.find_secrets(docs, net), L.scan_licenses(docs), D.find_items(docs, items), H.shard_documents(docs, shards=5):
        assert Counter(r.doc_id for r in found.select("doc_id").collect()) == thrice
    shards = H.shard_documents(docs, shards=5).collect()
    sizes = Counter(r.shard for r in shards)
    assert set(sizes.values()) == {2, 3} and all(sorted(r.slot for r in shards if r.shard == k) == list(range(n)) for k, n in sizes.items())
    packed = P.pack_documents(docs, P.default_tokenizer(), 16).collect()
    for doc in thrice:
        pieces = [r for r in packed if r.doc_id == doc]
        assert sum(r.length for r in pieces) == 3 * pieces[0].doc_tokens


def test_no_items_and_no_documents(spark, none, docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.find_items(docs, items).where(D.is_contaminated()).count() == 0
    assert D.find_items(none, items).count() == 0


def test_a_language_model_of_no_documents_tells_nothing(none, docs):
    model = I.fit(none.select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in I.predict(docs, model).collect()} == {I.UNDETERMINED}
    assert I.predict(none, model).count() == 0


def test_pipeline_of_no_documents(spark, none, tmp_path):
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_keeps_or_drops_all_rows_of_an_id(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(9, text, "aa", "s", len(text)), (5, text, "aa", "s", len(text)), (6, "something else altogether", "aa", "s", 25)]
    docs = spark.createDataFrame(rows * 2, DOCS)
    kept = dict(corpus_pipeline.STAGES)["MinHash near-dedup"](spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [5, 5, 6, 6] and kept.columns == docs.columns
