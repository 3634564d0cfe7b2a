"""Words by numpy against the regular expression, and novelty against plain sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gritstone.config import Config
from gritstone.functions import models
from gritstone.functions import text as T
from gritstone.functions.words import in_text_before, words
from gritstone.operators.validate import indexed, judged
from gritstone.plans import jobs

WORD = re.compile(r"[^\W_]+")
TEXT = st.text(st.sampled_from(list("ab1Éß_ .-\n日本🙂²Ⅷ́")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=6), st.integers(0, 2))
def test_words_are_those_of_the_regular_expression(texts, skipped):
    found, counts, letters = words(pa.array(texts, pa.string()).slice(skipped))
    want = [WORD.findall(t or "") for t in texts[skipped:]]
    assert found.to_pylist() == [w for own in want for w in own] and counts.tolist() == [len(own) for own in want]
    assert letters.tolist() == [sum(c.isalpha() for c in t or "") for t in texts[skipped:]]


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_words_of_the_text_before(texts):
    sets = [set(WORD.findall(t)) for t in texts]
    distinct, again = in_text_before(*[words(pa.array(texts[:1]))[0], *words(pa.array(texts[1:], pa.string()))[:2]])
    assert distinct.tolist() == [len(x) for x in sets[1:]]
    assert again.tolist() == [len(a & b) for a, b in zip(sets, sets[1:], strict=False)]


def test_no_regular_expression_finds_the_words_of_chunks(spark):
    """Validation and embedding read a chunk's words in one pass over its bytes; the sets of words are no columns."""
    df = spark.createDataFrame([("p", "ABSTRACT\na")], "patent_id string, text string")
    rows = judged(jobs.built_chunks(df, Config()), Config(), counted=True)
    for found, shuffles in (rows, 1), (indexed(rows), 2):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == shuffles and not any(f in plan for f in ("array_except", "lag(", "array_distinct"))


def test_novelty_is_that_of_sets(spark):
    r = random.Random(3)
    rows = [(f"p{p}", s, "S", c, f"p{p}::{s}::{c}", r.choice([None, "", "--", *(" ".join(r.choices("Ab ab É1 x_y zz Q".split(), k=r.randint(1, 9))) for _ in range(9))])) for p in range(40) for s in range(2) for c in range(r.randint(1, 60))]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "patent_id string, section_idx int, section string, chunk_no int, chunk_id string, text string").repartition(5)
    texts = {(p, s, c): t for p, s, _, c, _, t in rows}
    own = lambda t: set(WORD.findall(t.lower()))
    for row in judged(df, Config()).where("chunk_no <> 1").collect():
        t, before = (texts.get((row.patent_id, row.section_idx, row.chunk_no - k)) for k in (0, 1))
        want = None if t is None or before is None or not own(t) else len(own(t) - own(before)) / len(own(t))
        assert row.novelty == want and row.alpha_ratio == (sum(c.isalpha() for c in t or "") / len(t) if t else 0.0)


@pytest.mark.parametrize("only_chunk", [False, True])
@pytest.mark.parametrize("counter", ["regex", "thirds"])
def test_sections_stay_whole_whatever_counts_their_tokens(spark, monkeypatch, counter, only_chunk):
    monkeypatch.setitem(models.TOKEN_COUNTERS, "thirds", lambda: lambda texts: [-(-len(t) // 3) for t in texts])
    r = random.Random(5)
    line = lambda: " ".join(r.choices("ab cd ef gh ij kl mn op".split(), k=r.randint(3, 30))) + "."
    docs = spark.createDataFrame([(f"p{i}", "ABSTRACT\n" + "\n\n".join(line() for _ in range(40))) for i in range(30)], "patent_id string, text string")
    cfg = Config(token_counter=counter, max_chunk_tokens=40, keep_only_chunk=only_chunk)
    rows = {(x.patent_id, x.chunk_no): x for x in judged(jobs.built_chunks(docs, cfg), cfg, counted=True).collect()}
    own = lambda x: set(WORD.findall(x.text.lower()))
    for (patent, no), x in rows.items():
        assert x.novelty == (len(own(x) - own(rows[patent, no - 1])) / len(own(x)) if no else None)
    assert len(rows) > 300


def test_white_space_with_and_without_single_spaces(spark):
    texts = ["", " ", "a", " a b ", "a  b", "a\tb", "a\n", "\x0b", "a b c", "a b", "a\r\nb c"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.word_count(F.col("t")), T.collapse_whitespace(F.col("t"))).collect()
    space = re.compile(r"[ \t\n\x0b\f\r]+")
    assert [tuple(x) for x in got] == [(len(space.sub(" ", t).strip(" ").split(" ")) if space.sub("", t) else 0, space.sub(" ", t).strip(" ")) for t in texts]


def test_paragraphs_of_single_lines(spark):
    from gritstone.operators.units import paragraphs

    texts = ["", "\n", "a\nb", "\n\na\n\n\nb\n", "a\n\n", " \na\u0085\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    one = df.select(paragraphs(F.col("t"), Config(paragraph_separator=r"\n")), paragraphs(F.col("t"), Config(paragraph_separator=r"(?:\n)"))).collect()
    assert all(a == b for a, b in one)


def test_a_word_that_was_forgotten_has_its_bucket_again(monkeypatch):
    monkeypatch.setattr(models, "HELD_WORDS", 3)
    texts = ["a b c d e", "a e a", ""]
    got = models.hash_embedder(32)(texts)
    want = np.zeros((3, 32))
    for i, t in enumerate(texts):
        for w in t.split():
            want[i, models.bucket_of(w, 32)] += 1
    assert np.allclose(got, want / np.maximum(np.sqrt((want**2).sum(1, keepdims=True)), 1e-9))
