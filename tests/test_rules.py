"""Rules that the tables cannot trigger, on rows written here."""

import time
from dataclasses import replace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gritstone.config import Config
from gritstone.functions import text as T
from gritstone.functions.vectors import norm, unit
from gritstone.operators.chunks import chunk_starts, chunks, section_chunks
from gritstone.operators.embed import check_dimension, embed
from gritstone.operators.prompts import prompts
from gritstone.operators.report import collection_report, section_breakdown
from gritstone.operators.search import by_patent, ranked, vector_search
from gritstone.operators.sections import sections
from gritstone.operators.units import section_units, units
from gritstone.operators.validate import indexed, judged

CFG = Config()


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "line, heading",
    [
        ("ABSTRACT", True), ("Field of use:", True), ("Claims", True), ("2. B.", False), ("UND.", False), ("plain words", False), ("AB", False),
        ("A" * 81, False), ("", False), ("12:", False), ("SUMMARY OF THE INVENTION", True),
    ],
)
def test_headings(spark, line, heading):
    assert one(spark, line, lambda c: T.is_heading(c, CFG)) is heading


def test_terminal_punctuation_may_be_allowed(spark):
    assert one(spark, "UND.", lambda c: T.is_heading(c, replace(CFG, allow_terminal_punct=True)))


def test_text_before_any_heading_is_a_preamble(spark):
    df = spark.createDataFrame([("p", "intro\nABSTRACT\nx\ny\nCLAIMS"), ("q", None)], "patent_id string, text string")
    rows = {(r.patent_id, r.section): (r.body, r.body_start) for r in sections(df, CFG).collect()}
    assert rows == {("p", "PREAMBLE"): ("intro", 0), ("p", "ABSTRACT"): ("x\ny", 15), ("q", "PREAMBLE"): ("", 0)}


def test_blank_lines_part_paragraphs_and_offsets_point_at_the_source(spark):
    text = "ABSTRACT\na b\n\n \nc d"
    df = spark.createDataFrame([("p", text)], "patent_id string, text string")
    rows = units(sections(df, CFG), CFG).orderBy("unit_idx").collect()
    assert [r.text for r in rows] == ["a b", "c d"]
    assert all(text[r.start_offset : r.end_offset] == r.text for r in rows)


def test_a_long_sentence_is_cut_into_fragments_within_the_budget(spark):
    text = " ".join(f"w{i}" for i in range(600)) + "."
    df = spark.createDataFrame([("p", text)], "patent_id string, text string")
    rows = units(sections(df, CFG), CFG).orderBy("unit_idx").collect()
    assert {r.kind for r in rows} == {"fragment"} and max(r.token_count for r in rows) <= 256
    assert " ".join(r.text for r in rows) == text
    assert all(text[r.start_offset : r.end_offset] == r.text for r in rows)


def greedy(tokens, carried, most):
    out, size = [], 0
    for i, t in enumerate(tokens):
        if i and size + t <= most:
            size += t
            continue
        over = carried[i - 1] if i and carried[i - 1] + t <= most else 0
        out.append((i, over))
        size = over + t
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 256), st.integers(0, 256)), max_size=40))
def test_fold_equals_a_plain_greedy_packer(spark, pairs):
    tokens, carried = [p[0] for p in pairs], [min(p) for p in pairs]
    df = spark.createDataFrame([(tokens, carried)], "t array<int>, c array<int>")
    got = df.select(chunk_starts(F.col("t"), F.col("c"), CFG)).first()[0]
    assert [tuple(x) for x in got] == greedy(tokens, carried, 256)


def test_sections_units_and_chunks_are_cut_in_the_row(spark):
    """One shuffle of whole texts, no windows, and no expression copied into a filter below the projections."""
    df = spark.createDataFrame([("p", "ABSTRACT\na")], "patent_id string, text string")
    for rows in units(sections(df, CFG), CFG), section_chunks(section_units(sections(df, CFG), CFG), CFG):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Window" not in plan and "Sort" not in plan and "Filter (size" not in plan
        assert max(map(len, plan.split("\n"))) < 6000


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 9), max_size=1500))
def test_running_sums(spark, values):
    df = spark.createDataFrame([(values,)], "v array<int>")
    assert df.select(T.running_sums(F.col("v"))).first()[0] == [sum(values[:i]) for i in range(len(values))]


def test_a_very_long_text_is_no_square(spark):
    """60,000 lines, 3,000 headings, a section of 30,000 sentences: a few seconds, and offsets that point at the source."""
    text = "\n".join(("HEAD:" if i % 10 == 0 else f"line {i} ends.") for i in range(30_000)) + "\nCLAIMS\n" + "\n\n".join(f"Say {i} now." for i in range(30_000))
    df = spark.createDataFrame([("p", text)], "patent_id string, text string")
    began = time.time()
    rows = section_chunks(section_units(sections(df, CFG), CFG), replace(CFG, overlap_strategy="none")).collect()
    assert time.time() - began < 60 and len({r.section_idx for r in rows}) == 3001
    squeezed = lambda t: "".join(t.split())
    assert all(squeezed(text[r.start_offset : r.end_offset]) == squeezed(r.text) for r in rows)


def made_units(spark, sizes):
    rows = [("p", 1, "S", i, "paragraph", " ".join([f"u{i}"] * n), n, 1000 * i, 1000 * i + 10) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "patent_id string, section_idx int, section string, unit_idx int, kind string, text string, token_count int, start_offset int, end_offset int")


def test_overlap_that_does_not_fit_is_left_out(spark):
    rows = chunks(made_units(spark, [200, 100]), replace(CFG, overlap_strategy="last_unit")).orderBy("chunk_no").collect()
    assert [(r.token_count, r.overlap_tokens) for r in rows] == [(200, 0), (100, 0)]
    rows = chunks(made_units(spark, [200, 50, 100]), replace(CFG, overlap_strategy="last_unit")).orderBy("chunk_no").collect()
    assert [(r.token_count, r.overlap_tokens) for r in rows] == [(250, 0), (150, 50)]


def made_chunks(spark, texts):
    rows = [("p", 1, "S", i, f"p::1::{i}", t, 0, 1, 0, 0, 0, 0, 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows,
        "patent_id string, section_idx int, section string, chunk_no int, chunk_id string, text string, first_unit int, unit_count int, overlap_tokens int, token_count int, word_count int, start_offset int, end_offset int",
    )


def test_reasons(spark):
    words = " ".join(f"alpha{i}" for i in range(30))
    other = " ".join(f"beta{i}" for i in range(30))
    texts = ["----- 12 | 34 | 56 -----", "DETAILED DESCRIPTION OF PREFERRED EMBODIMENTS", words, words + " ", other, words, "too few words", "a\t\tb  \n c"]
    rows = judged(made_chunks(spark, texts), CFG).orderBy("chunk_no").collect()
    assert [r.reject_reason for r in rows] == ["low_information", "heading_only", None, "degenerate_overlap", None, "duplicate", "too_short", "too_short"]
    assert rows[-1].text == "a b c"
    kept = indexed(judged(made_chunks(spark, texts), CFG)).orderBy("chunk_no").collect()
    assert [(r.section_chunk_index, r.document_chunk_index, r.total_chunks) for r in kept] == [(0, 0, 2), (1, 1, 2)]
    off = judged(made_chunks(spark, texts), replace(CFG, reject_heading_only=False)).orderBy("chunk_no").collect()
    assert off[1].reject_reason == "too_short"


def test_a_loop_of_period_two_adds_nothing_to_its_section(spark):
    a, b = (" ".join(f"{x}word{i}" for i in range(30)) for x in "ab")
    texts = [a, b, a + " aword1", b + " bword1", a + " " + " ".join(f"cword{i}" for i in range(10)), "", "12 -"]
    near = judged(made_chunks(spark, texts), CFG).orderBy("chunk_no").collect()
    assert [r.reject_reason == "degenerate_overlap" for r in near[:5]] == [False] * 5
    rows = judged(made_chunks(spark, texts).repartition(3), replace(CFG, novelty_against="section")).orderBy("chunk_no").collect()
    assert [r.reject_reason for r in rows[:5]] == [None, None, "degenerate_overlap", "degenerate_overlap", None]
    assert [r.novelty for r in rows] == [None, 1.0, 0.0, 0.0, 0.25, None, 1.0] and rows[0].asDict().keys() == near[0].asDict().keys()
    seen: set = set()
    for t, r in zip(texts, rows, strict=True):
        words = set(t.split()) - {"-"}
        assert r.text == t and (r.chunk_no == 0 or not words or r.novelty == len(words - seen) / len(words))
        seen |= words
    with pytest.raises(ValueError):
        judged(made_chunks(spark, texts), replace(CFG, novelty_against="all"))
    assert judged(made_chunks(spark, texts).where("false"), replace(CFG, novelty_against="section")).count() == 0


def test_collection_report_equals_summary_and_breakdown(spark):
    rows = [("p", "A", 5), ("p", "A", 7), ("p", None, 2), ("q", "A", 1), (None, "B", 4), ("p", "C", None)]
    df = spark.createDataFrame(rows, "patent_id string, section string, token_count int")
    found = collection_report(df)
    plain = lambda d: sorted(map(repr, d.collect()))
    assert plain(found.where("level = 'section'").drop("level", "sections")) == plain(section_breakdown(df))
    totals = {r.patent_id: (r.chunks, r.sections, r.tokens) for r in found.where("level = 'patent'").collect()}
    assert totals == {"p": (4, 3, 14), "q": (1, 1, 1), None: (1, 1, 4)}
    assert [(r.chunks, r.sections, r.tokens, r.avg_tokens) for r in found.where("level = 'collection'").collect()] == [(6, 5, 19, 3.8)]
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan") == 1


def test_three_letters_in_ten_characters_are_enough(spark):
    assert one(spark, "abc1234567", T.alpha_ratio) == 0.3
    assert one(spark, "", T.alpha_ratio) == 0.0


def test_zero_vectors_stay_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    rows = df.select(unit(F.col("v")).alias("u"), norm(F.col("v")).alias("n")).collect()
    assert [list(r.u) for r in rows] == [[0.0, 0.0], [0.6, 0.8]] and [r.n for r in rows] == [0.0, 5.0]


def test_embedding_has_the_contracts_dimension_and_length_one(spark):
    cfg = replace(CFG, vector_size=32)
    df = embed(spark.createDataFrame([("a b a",), (None,), ("",)], "text string"), cfg)
    rows = df.collect()
    assert check_dimension(df, cfg).count() == 0
    assert [round(sum(x * x for x in r.vector), 5) for r in rows] == [1.0, 0.0, 0.0]


def test_ties_go_by_id_and_blocks_change_nothing(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)] + [(9, None)], "id long, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, query_vector array<double>")
    want = [(q, i, float(q == 1), i + 1) for q in (1, 2) for i in range(3)]
    for cfg in (replace(CFG, vector_top_k=3), replace(CFG, vector_top_k=3, query_block=1, row_block=2)):
        assert sorted(tuple(r) for r in vector_search(asked, rows, cfg).collect()) == want
    empty = vector_search(asked.where("false"), rows, CFG)
    assert empty.count() == 0


def test_patent_results_and_prompt(spark):
    rows = spark.createDataFrame(
        [(1, "A", "A::1::0", "S", "one", 0.9, 1, 1), (1, "B", "B::1::0", "S", "two", 0.8, 2, 2), (1, "A", "A::1::1", "S", "three", 0.7, 3, 3)],
        "query_id long, patent_id string, chunk_id string, section string, text string, rerank_score double, vector_rank int, rerank_rank int",
    )
    results = by_patent(rows)
    got = {r.patent_id: (r.score, r.best_chunk.chunk_id, [c.chunk_id for c in r.matching_chunks]) for r in results.collect()}
    assert got == {"A": (0.9, "A::1::0", ["A::1::0", "A::1::1"]), "B": (0.8, "B::1::0", ["B::1::0"])}
    asked = spark.createDataFrame([(1, "why?"), (2, None)], "query_id long, query_text string")
    text = {r.query_id: r.prompt for r in prompts(results, asked).collect()}
    assert text[1].index("Patent A (score 0.9000)") < text[1].index("[S | A::1::1]\nthree") < text[1].index("Patent B") < text[1].index("Question: why?\nAnswer:")
    assert text[2].endswith("Question: \nAnswer:")


def test_ranked_keeps_k(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (1, "c", 0.9)], "query_id long, id string, s double")
    assert [(r.id, r.rank) for r in ranked(df, "s", 2, "rank", ["id"]).orderBy("rank").collect()] == [("c", 1), ("a", 2)]


def test_models_registered_in_the_driver_reach_the_tasks(spark, monkeypatch):
    import numpy as np

    from gritstone.functions import models
    from gritstone.operators.search import rerank

    monkeypatch.setitem(models.EMBEDDERS, "lengths", lambda dim: lambda texts: np.array([[len(t)] + [0] * (dim - 2) + [1] for t in texts]))
    cfg = replace(CFG, embedding_model="lengths", vector_size=4)
    got = embed(spark.createDataFrame([("abc",), (None,)], "text string"), cfg).collect()
    assert [[round(x, 4) for x in r.vector] for r in got] == [[0.9487, 0, 0, 0.3162], [0, 0, 0, 1]]
    monkeypatch.setitem(models.RERANKERS, "shortest", lambda: lambda queries, texts, scores: np.array([-float(len(t)) for t in texts]))
    pairs = spark.createDataFrame([(1, "c1", "q", "long text", 0.9, 1), (1, "c2", "q", "text", 0.1, 2)], "query_id int, chunk_id string, query_text string, text string, vector_score double, vector_rank int")
    assert [r.chunk_id for r in rerank(pairs, replace(CFG, reranker_model="shortest")).orderBy("rerank_rank").collect()] == ["c2", "c1"]
    monkeypatch.setitem(models.TOKEN_COUNTERS, "letters", lambda: lambda texts: [len(t.replace(" ", "")) for t in texts])
    text = "ABSTRACT\n" + " ".join(["abcd"] * 100) + "."
    small = replace(CFG, token_counter="letters", max_chunk_tokens=64, fragment_words=16)
    cut = units(sections(spark.createDataFrame([("p", text)], "patent_id string, text string"), small), small)
    rows, made = cut.collect(), chunks(cut, small).collect()
    assert {r.kind for r in rows} == {"fragment"} and max(r.token_count for r in rows) <= 65
    assert all(r.token_count == len(r.text.replace(" ", "")) for r in made)


def test_a_model_of_another_size_is_refused(spark, monkeypatch):
    import numpy as np

    from gritstone.functions import models

    monkeypatch.setitem(models.EMBEDDERS, "wide", lambda dim: lambda texts: np.ones((len(texts), 2 * dim)))
    with pytest.raises(Exception, match="dimensions are asked for"):
        embed(spark.createDataFrame([("abc",), ("d",)], "text string"), replace(CFG, embedding_model="wide", vector_size=4)).collect()


def test_patents_of_a_query_are_ranked(spark):
    rows = [(1, "p", "p::0", "S", "t", 0.5, 3), (1, "q", "q::0", "S", "t", 0.9, 1), (1, "o", "o::0", "S", "t", 0.5, 2), (2, "p", "p::0", "S", "t", 0.1, 1)]
    df = spark.createDataFrame(rows, "query_id int, patent_id string, chunk_id string, section string, text string, rerank_score double, rerank_rank int")
    assert {(r.query_id, r.patent_id): r.patent_rank for r in by_patent(df).collect()} == {(1, "q"): 1, (1, "o"): 2, (1, "p"): 3, (2, "p"): 1}


def test_novelty_in_a_section_makes_no_row_of_a_word(spark, capsys):
    texts = ["a b c", "b c d", None, "", "a d e", "e e f"]
    rows = judged(made_chunks(spark, texts), replace(CFG, novelty_against="section"))
    assert [r.novelty for r in rows.orderBy("chunk_no").collect()] == [None, 1 / 3, None, None, 1 / 3, 0.5]
    rows.explain()
    assert "explode" not in capsys.readouterr().out


def test_counts_of_chunks_are_those_of_their_texts(spark):
    texts = ["One two.  Three, four! \n" * 90 + "end  ", "Ünï 12 \u0085\n\nA b. " + "word, " * 700, "  \n \t", None]
    df = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "patent_id string, text string")
    for strategy in "last_sentence", "last_unit", "none":
        rows = section_chunks(section_units(sections(df, CFG), CFG), replace(CFG, overlap_strategy=strategy))
        again = judged(rows, CFG).select("chunk_id", "token_count", "word_count", "reject_reason").collect()
        assert sorted(again) == sorted(judged(rows, CFG, counted=True).select("chunk_id", "token_count", "word_count", "reject_reason").collect())
        assert rows.count() > 4 and rows.where(T.token_count(F.col("text")) != F.col("token_count")).count() == 0
    ends = spark.createDataFrame([(t,) for t in ("a \n", "a  ", "a  \n", "a \u0085", "a  \n", "a\xa0 ", " ", "", "a b", None)], "t string")
    assert ends.where(~T.strip_end(F.col("t")).eqNullSafe(F.regexp_replace("t", r"\s+$", ""))).count() == 0
