"""Files, the collection table and the stream, on files written here."""

import json
import os
from dataclasses import replace

import pytest

from gritstone.config import Config
from gritstone.functions import models
from gritstone.plans import jobs
from gritstone.sources.files import load_patents
from gritstone.sources.table import collection, in_batches, read_collection, upsert
from gritstone.streaming.ingest import stream_ingest

WORDS = " ".join(f"word{i}" for i in range(40))
TEXT = f"ABSTRACT\n{WORDS}.\nCLAIMS\n{WORDS} more."


def write(folder, name, text=TEXT, meta=None):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.txt").write_text(text)
    if meta is not None:
        (folder / f"{name}.json").write_text(json.dumps(meta))


def test_text_and_metadata_side_by_side(spark, tmp_path):
    write(tmp_path / "in", "a", meta={"patent_id": "US1", "title": "T", "filing_date": "2020-01-01", "classification_codes": ["B23B"], "inventors": ["I"], "owner": "O"})
    write(tmp_path / "in", "US2")
    write(tmp_path / "in", "US3", meta={"filing_date": "soon"})
    rows = {r.patent_id: r for r in load_patents(spark, str(tmp_path / "in")).collect()}
    assert set(rows) == {"US1", "US2", "US3"} and rows["US2"].metadata is None and rows["US3"].metadata.filing_date is None
    m = rows["US1"].metadata
    assert (m.title, str(m.filing_date), m.classification_codes, m.inventors, m.extra) == ("T", "2020-01-01", ["B23B"], ["I"], {"owner": "O"})
    assert rows["US1"].text == TEXT


def test_ingest_twice_search_and_report(spark, tmp_path):
    cfg = replace(Config(), vector_size=32, table_path=str(tmp_path / "table"), buckets=4)
    write(tmp_path / "in", "US1", meta={"title": "T"})
    write(tmp_path / "in", "US2", text="ABSTRACT\n" + " ".join(f"other{i}" for i in range(30)))
    jobs.ingest(spark, str(tmp_path / "in"), cfg)
    first = sorted(map(repr, read_collection(spark, cfg.table_path).collect()))
    jobs.ingest(spark, str(tmp_path / "in"), cfg)
    assert sorted(map(repr, read_collection(spark, cfg.table_path).collect())) == first and len(first) == 3
    asked = spark.createDataFrame([(1, "other3 other4")], "query_id long, query_text string")
    results = jobs.search(spark, asked, cfg)
    best = max(results.collect(), key=lambda r: r.score)
    assert best.patent_id == "US2" and best.score == max(c.rerank_score for c in best.matching_chunks)
    assert "Patent US2" in jobs.build_prompts(results, asked).first().prompt
    assert {r.patent_id: (r.chunks, r.sections) for r in jobs.report(spark, cfg).collect()} == {"US1": (2, 2), "US2": (1, 1)}
    assert jobs.report(spark, cfg, verbose=True).count() == 3


def test_upsert_replaces_inserts_and_leaves(spark, tmp_path):
    cfg, path = replace(Config(), buckets=2), str(tmp_path / "t")
    make = lambda *rows: spark.createDataFrame(list(rows), "chunk_id string, patent_id string, v int")
    upsert(spark, make(("a::1", "a", 1), ("a::2", "a", 1), ("b::1", "b", 1)), path, cfg)
    upsert(spark, make(("a::1", "a", 2), ("c::1", "c", 2)), path, cfg)
    assert sorted(tuple(r) for r in read_collection(spark, path).select("chunk_id", "v").collect()) == [("a::1", 2), ("a::2", 1), ("b::1", 1), ("c::1", 2)]
    upsert(spark, make(("a::1", "a", 3)), path, cfg, replace_patent=True)
    assert sorted(tuple(r) for r in read_collection(spark, path).select("chunk_id", "v").collect()) == [("a::1", 3), ("b::1", 1), ("c::1", 2)]


def test_names_of_any_kind_and_metadata_before_with_and_after_its_text(spark, tmp_path):
    """Batch then stream gives each patent once; a .json that comes later renames and completes its patent."""
    cfg = replace(Config(), vector_size=16, table_path=str(tmp_path / "table"), buckets=2)
    run = lambda: stream_ingest(spark, str(tmp_path / "in"), str(tmp_path / "checkpoint"), cfg).awaitTermination()
    seen = lambda: {(r.patent_id, r.title) for r in read_collection(spark, cfg.table_path).select("patent_id", "metadata.title").collect()}
    odd = ["p 1", "a+b", "50%25 off", "über", "x[1]{2}"]
    for i, name in enumerate(odd):
        write(tmp_path / "in", name, meta={"patent_id": f"US{i}", "title": name})
    write(tmp_path / "in", "plain name")
    jobs.ingest(spark, str(tmp_path / "in"), cfg)
    want = {(f"US{i}", name) for i, name in enumerate(odd)} | {("plain name", None)}
    assert seen() == want
    number = collection(spark, cfg.table_path, cfg).version().number
    run()
    assert seen() == want and collection(spark, cfg.table_path, cfg).version().number == number  # nothing had changed
    (tmp_path / "in/plain name.json").write_text(json.dumps({"patent_id": "US77", "title": "late"}))
    (tmp_path / "in/early.json").write_text(json.dumps({"patent_id": "US88", "title": "early"}))
    run()
    want = want - {("plain name", None)} | {("US77", "late")}
    assert seen() == want
    (tmp_path / "in/US77.json").write_text(json.dumps({"patent_id": "US99"}))  # of no text: US77 stays
    write(tmp_path / "in", "early")
    run()
    assert seen() == want | {("US88", "early")}


def test_unchanged_chunks_cost_no_model_call(spark, tmp_path):
    log = str(tmp_path / "calls")

    def factory(dim):
        def model(texts):
            with open(log, "a") as f:
                f.write("x" * len(texts))
            return [[1.0, *[len(t) / 1000] * (dim - 1)] for t in texts]

        return model

    calls = lambda: os.path.getsize(log) if os.path.exists(log) else 0
    models.EMBEDDERS["counting"] = factory
    cfg = replace(Config(), vector_size=4, table_path=str(tmp_path / "table"), buckets=2, embedding_model="counting")
    write(tmp_path / "in", "US1")
    write(tmp_path / "in", "US2", text="ABSTRACT\n" + " ".join(f"other{i}" for i in range(30)))
    jobs.ingest(spark, str(tmp_path / "in"), cfg)
    assert calls() == 3
    jobs.ingest(spark, str(tmp_path / "in"), cfg)
    assert calls() == 3 and collection(spark, cfg.table_path, cfg).version().number == 1
    before = {r.chunk_id: r.vector for r in read_collection(spark, cfg.table_path).collect()}
    write(tmp_path / "in", "US2", text="ABSTRACT\n" + " ".join(f"other{i}" for i in range(31)), meta={"title": "T"})
    write(tmp_path / "in", "US1", meta={"title": "new title alone"})
    jobs.ingest(spark, str(tmp_path / "in"), cfg)
    rows = {r.chunk_id: r for r in read_collection(spark, cfg.table_path).collect()}
    assert calls() == 4 and len(rows) == 3 and {r.metadata.title for r in rows.values()} == {"T", "new title alone"}
    assert [k for k, r in rows.items() if r.vector != before[k]] == ["US2::1::0"]
    jobs.ingest(spark, str(tmp_path / "in"), replace(cfg, vector_size=5, table_path=str(tmp_path / "other")))
    assert calls() == 7


def test_approximate_search_follows_the_collection(spark, tmp_path):
    cfg = replace(Config(), vector_size=32, table_path=str(tmp_path / "table"), buckets=4, approximate=True, index_lists=3)
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    for i in range(8):
        write(tmp_path / "in", f"US{i}", text=f"ABSTRACT\n{words(i)}")
    jobs.ingest(spark, str(tmp_path / "in"), cfg)
    index = jobs.build_index(spark, cfg)
    assert len(index.centroids) == 3 and index.recall[-1] == 1.0
    asked = spark.createDataFrame([(1, "w5x1 w5x2 w5x3"), (2, "w9x4 w9x5")], "query_id long, query_text string")
    best = lambda c: {r.query_id: (r.patent_id, r.score) for r in jobs.search(spark, asked, c).where("patent_rank = 1").collect()}
    assert best(cfg)[1][0] == "US5"
    write(tmp_path / "in", "US9", text=f"ABSTRACT\n{words(9)}")
    write(tmp_path / "in", "US5", text=f"ABSTRACT\n{words(77)}")
    jobs.ingest(spark, str(tmp_path / "in"), cfg)
    assert best(cfg)[2][0] == "US9" and best(cfg) == best(replace(cfg, approximate=False)) and best(cfg)[1][1] < 1


def test_batches_for_a_sink(spark, tmp_path):
    folder = str(tmp_path)

    def send(rows):
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").write(str(len(rows)))

    in_batches(spark.range(250).coalesce(1), send, Config())
    assert sorted(int(p.read_text()) for p in tmp_path.iterdir()) == [50, 100, 100]


def test_stream_takes_what_arrives(spark, tmp_path):
    cfg = replace(Config(), vector_size=16, table_path=str(tmp_path / "table"), buckets=2)
    run = lambda: stream_ingest(spark, str(tmp_path / "in"), str(tmp_path / "checkpoint"), cfg).awaitTermination()
    write(tmp_path / "in", "US1")
    run()
    assert read_collection(spark, cfg.table_path).select("patent_id").distinct().count() == 1
    write(tmp_path / "in", "US2")
    run()
    assert read_collection(spark, cfg.table_path).select("patent_id").distinct().count() == 2


def test_batch_then_stream_is_the_same_patent_once(spark, tmp_path):
    cfg = replace(Config(), vector_size=16, table_path=str(tmp_path / "table"), buckets=2)
    meta = {"patent_id": "US7", "title": "T", "owner": "O"}
    write(tmp_path / "in", "a", meta=meta)
    write(tmp_path / "in", "b")
    jobs.ingest(spark, str(tmp_path / "in"), cfg)
    first = sorted(map(repr, read_collection(spark, cfg.table_path).collect()))
    write(tmp_path / "more", "a", meta=meta)
    write(tmp_path / "more", "c", meta={"patent_id": "US8", "title": "U"})
    stream_ingest(spark, str(tmp_path / "more"), str(tmp_path / "checkpoint"), cfg).awaitTermination()
    rows = read_collection(spark, cfg.table_path)
    assert sorted(map(repr, rows.where("patent_id <> 'US8'").collect())) == first
    assert {(r.patent_id, r.title) for r in rows.select("patent_id", "metadata.title").collect()} == {("US7", "T"), ("b", None), ("US8", "U")}


def test_equal_ids_give_one_row_whatever_the_order(spark, tmp_path):
    rows = [("a::1", "a", "x", 1), ("a::1", "a", "y", 2), ("a::1", "a", "y", 1)]
    for i, r in enumerate((rows, rows[::-1])):
        upsert(spark, spark.createDataFrame(r, "chunk_id string, patent_id string, text string, v int").coalesce(1), str(tmp_path / str(i)), Config())
        assert [tuple(x) for x in read_collection(spark, str(tmp_path / str(i))).collect()] == [("a::1", "a", "y", 2)]


def test_upsert_leaves_no_scratch_tables(spark, tmp_path):
    from gritstone.sources.scratch import scratch_dir

    count = lambda: sum("gritstone-upsert" in n for n in os.listdir(scratch_dir(spark).removeprefix("file:")))
    before = count()
    for v in (1, 2):
        upsert(spark, spark.createDataFrame([("a::1", "a", v)], "chunk_id string, patent_id string, v int"), str(tmp_path / "t"), Config())
    assert count() == before


def test_scratch_space_of_one_machine_is_refused_on_a_cluster():
    from types import SimpleNamespace

    from gritstone.sources.scratch import scratch_dir

    made = lambda master: SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch_dir(made(master))
