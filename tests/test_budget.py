"""The token budget of chunks with real tokenizers, and cuts at their tokens."""

import random
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gritstone.config import Config
from gritstone.functions import models
from gritstone.functions.text import cut_text
from gritstone.plans import jobs

tokenizers = pytest.importorskip("public_tokenizers")
NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
COUNTERS = {n: models.FileTokens(tokenizers.path(n)) for n in NAMES}
TEXT = st.text(st.sampled_from(list("aeiou stnrl.ÄßX1 \n日本🙂é-")), max_size=120)


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=150, deadline=None)
@given(text=TEXT, most=st.integers(8, 30))
def test_pieces_rejoin_and_fit(name, text, most):
    pieces = cut_text(text, most, COUNTERS[name])
    assert "".join(pieces) == text and all(pieces)
    for p in pieces:
        assert max(COUNTERS[name]([p.strip(), " " + p.strip()])) <= most


@settings(max_examples=100, deadline=None)
@given(text=TEXT, most=st.integers(1, 9))
def test_a_counter_that_says_no_starts(text, most):
    counter = lambda texts: [len(t.split()) + t.count("x") + len(t) // 3 for t in texts]
    pieces = cut_text(text, most, counter)
    assert "".join(pieces) == text
    assert all(max(counter([p.strip(), " " + p.strip()])) <= most or len(p) == 1 for p in pieces)


def test_pieces_are_long_and_end_between_words():
    text = " ".join(f"word{i}" for i in range(400))
    pieces = cut_text(text, 64, COUNTERS[NAMES[1]])
    assert all(p.endswith(" ") for p in pieces[:-1]) and len(pieces) <= 2 * COUNTERS[NAMES[1]]([text])[0] / 64


@pytest.mark.parametrize("overlap", ["last_sentence", "last_unit"])
@pytest.mark.parametrize("name", NAMES)
def test_no_chunk_exceeds_the_budget(spark, name, overlap):
    r = random.Random(8)
    models.TOKEN_COUNTERS[name] = models.file_token_counter(tokenizers.path(name))
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyzäöüß日本", k=r.randint(1, 14)))
    line = lambda: " ".join(word() + r.choice(["", "", ",", ". ", "!"]) for _ in range(r.choice([3, 30, 200])))
    rows = [(f"US{i}", "ABSTRACT\n" + "\n\n".join(line() for _ in range(r.randint(1, 8)))) for i in range(25)]
    rows += [("US90", "x" * 3000), ("US91", "日本語" * 500), ("US92", None), ("US93", "")]
    cfg = replace(Config(), token_counter=name, max_chunk_tokens=64, overlap_strategy=overlap)
    found = jobs.built_chunks(spark.createDataFrame(rows, "patent_id string, text string").repartition(4), cfg).collect()
    counts = COUNTERS[name]([c.text for c in found])
    assert len(found) > 100 and max(counts) <= 64 and counts == [c.token_count for c in found]
    assert sum(counts) / len(counts) > 25
    squeezed = lambda t: "".join((t or "").split())
    for patent, text in rows:
        if overlap == "last_unit" or not text:
            continue
        body = squeezed(text.removeprefix("ABSTRACT\n"))
        own = sorted((c for c in found if c.patent_id == patent), key=lambda c: c.chunk_no)
        assert own[0].start_offset >= 0 and body.startswith(squeezed(own[0].text)) and body.endswith(squeezed(own[-1].text))
