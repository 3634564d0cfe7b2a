"""Vector codes, fill-in-the-middle and token counts, against brute force."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gritstone.llm import fill_middle as M
from gritstone.llm import token_counts as T
from gritstone.llm import vector_codes as V

VECTORS = "vec_id long, embedding array<double>, label int, code string"


def plain_codes(rows, parts, entries, rounds):
    """Codes, errors and codebooks by comparing each part with each entry, in Python integers."""
    kept = [(k, [math.floor(Fraction(x) * 4096) for x in v], lab) for k, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(k, v + [0] * (width * parts - len(v)), lab) for k, v, lab in kept]
    firsts = {}
    for k, v, _ in sorted((x for x in kept if x[0] is not None), key=lambda x: x[:2]):
        firsts.setdefault(k, v)
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in list(firsts.values())[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((far(cut(v, p), e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v, _ in kept:
            for p in range(parts):
                members[p, near(v, p)[1]].append(cut(v, p))
        books = [[[sum(x) // len(m) for x in zip(*m, strict=True)] if (m := members.get((p, i))) else e for i, e in enumerate(own)] for p, own in enumerate(books)]
    out = [(k, "".join(f"{near(v, p)[1]:02x}" for p in range(parts)), sum(near(v, p)[0] for p in range(parts)), lab) for k, v, lab in kept]
    totals = Counter()
    for r in out:
        totals[r[3]] += r[2]
    return sorted(((k, c, min(e, V.MOST), min(totals[lab], V.MOST)) for k, c, e, lab in out), key=repr), books


def coded(spark, rows, parts, entries, rounds, partitions=3):
    df = spark.createDataFrame([(*r, "x") for r in rows], VECTORS).repartition(partitions)
    found, books = V.compress(df, parts=parts, entries=entries, rounds=rounds)
    return sorted((tuple(r) for r in V.with_label_error(found).select("key", "code", "error", "label_error").collect()), key=repr), books


@pytest.mark.parametrize("width", [1, 2, 3, 5, 8, 16])
def test_transform_scales_distances_and_orders_by_sign_changes(width):
    x = np.random.default_rng(width).integers(-5000, 5000, (20, width))
    y = V.transform(x)
    size = y.shape[1]
    assert size >= width and all((((y[0] - y[i]) ** 2).sum()) == size * ((x[0] - x[i]) ** 2).sum() for i in range(20))
    rows = V.transform(np.eye(size, dtype=np.int64)).T  # the transform's own rows
    assert [int((r[1:] != r[:-1]).sum()) for r in rows] == list(range(size))


@pytest.mark.parametrize("kind", [np.int64, object])
def test_nearest_entry_with_ties(kind):
    r = np.random.default_rng(7)
    x, e = r.integers(-3, 4, (400, 8)).astype(kind), r.integers(-3, 4, (16, 8)).astype(kind)
    e[9] = e[2]  # an entry that never wins
    entry, d = V.nearest(V.transform(x), V.transform(e))
    full = ((x[:, None] - e[None]) ** 2).sum(2)
    assert entry.tolist() == [min(range(16), key=lambda i: (row[i], i)) for row in full.tolist()] and d.tolist() == [8 * min(row) for row in full.tolist()]


def test_codes_equal_brute_force(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(16)], i % 3 or None) for i in range(120)]
    rows += [(5, rows[5][1], 1), (5, [0.0] * 16, 1), (None, rows[7][1], None), (200, None, 1), (201, [1.0, None], 1), (202, [float("nan")] * 16, 2), (203, [float("inf")] * 16, 2)]
    rows += [(204, [], 2), (205, [0.5] * 7, 2), (206, [-0.25] * 13, None)]
    want, books = plain_codes(rows, 4, 6, 3)
    got, own = coded(spark, rows, 4, 6, 3)
    assert got == want and own.entries == books
    assert coded(spark, rows[::-1], 4, 6, 3, 1)[0] == want  # whatever the partitions


def test_codes_of_numbers_of_any_size(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) * 10.0 ** r.choice([-3, 0, 6, 20, 300]) for _ in range(5)], 1) for i in range(40)]
    want, books = plain_codes(rows, 2, 4, 2)
    got, own = coded(spark, rows, 2, 4, 2)
    assert own.entries == books and got == want and max(x[2] for x in got) == V.MOST


def test_codes_of_few_and_of_no_vectors(spark):
    assert coded(spark, [(3, [0.1] * 8, 1)], 8, 16, 6)[0] == [(3, "00" * 8, 0, 0)]
    for none in [], [(1, None, 1)], [(None, [0.1] * 8, 1)]:
        assert coded(spark, none, 8, 16, 6) == ([], None)


def test_integers_round_down_and_pad():
    got = V.integers(pa.array([[0.1, -0.1], [-1 / 4096]], pa.list_(pa.float32())), 3)
    assert got.tolist() == [[409, -410, 0], [-1, 0, 0]]


UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = ["", " ", "a", " a", "a ", "äö  ü\n\tß ", "　x y z", "word " * 5000, "é" * 9000, " " * 9000, "x" * 4095 + " y", "x" * 4096 + " y", "日本 語 " * 3000]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 4096])
def test_cuts_are_those_of_the_list_of_units(block):
    for text in TEXTS:
        data, units = text.encode()[:20000].decode("utf-8", "ignore").encode(), UNITS.findall(text.encode()[:20000].decode("utf-8", "ignore"))
        tree = M.BlockTree(data, block)
        assert tree.total == len(units)
        for k in {0, len(units), len(units) // 2, len(units) // 3, min(1, len(units))}:
            assert tree.cut(k) == (len("".join(units[:k]).encode()), len("".join(units[:k])))


def test_fill_in_middle_and_back(spark):
    r = random.Random(5)
    rows = [(i, "".join(r.choice(["ab", "ü", " ", "\n", "<", "P>", "S", ">", "日"]) for _ in range(r.randint(0, 60))), "k", 7) for i in range(400)]
    rows += [(1000 + i, t, "k", 7) for i, t in enumerate(TEXTS)] + [(2000, None, "k", 7), (None, "some more words", "k", 7), (1, rows[1][1], "k", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    found = M.fill_in_middle(df, ["doc_id", "text", "form"]).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    assert len(found) == len(rows) and Counter(x.form for x in found)["spm"] > Counter(x.form for x in found)["psm"] > 0
    for x in found:
        text, (h1, h2, h3, h4) = x.text or "", M.draws(x.doc_id)
        units = UNITS.findall(text)
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        plain = not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50
        assert x.n == len(units) and x.back == text and x.form == ("plain" if plain else "spm" if h4 % 100 < 80 else "psm")
        assert (x.prefix_chars, x.middle_chars) == ((None, None) if plain else (len(p), len(m)))
        assert x.output == (text if plain else f"<S>{s}<P>{p}<M>{m}" if x.form == "spm" else f"<P>{p}<S>{s}<M>{m}")
    assert M.fill_in_middle(df.where("false")).count() == 0


def reference_count(text):
    from tokenizers import Tokenizer

    if not hasattr(reference_count, "t"):
        reference_count.t = Tokenizer.from_file(T.default_tokenizer())
    return len(reference_count.t.encode(text, add_special_tokens=False).ids)


ODD = ["", " ", "it's 2024!", "a <|endoftext|> b<|startoftext|>c", "\x1c\x1d \x85a b c", "ΣΑΣ Ɓƕ Ⱥ İ", "é ́x", "日本語のテキスト" * 50, "x" * 5000, "🙂🙂 👩‍👩‍👧", "A\tb\x0bc\x0cd\re\n" * 30]


def test_token_counts_equal_the_library_s(spark, monkeypatch):
    monkeypatch.setattr(T, "SEGMENT", 200)  # in the driver; the tasks' own is covered by the long text
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(["the", "The", "token", "tok-en,", "größe", "1234", "…"]) for _ in range(r.randint(0, 80))), 1) for i in range(300)]
    rows += [(1000 + i, t, 1) for i, t in enumerate(ODD)] + [(2000, None, 1), (2001, "long text, with words " * 120_000, 1), (1, rows[1][1], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(20)
    for frequent in 3, 8192:
        got = sorted((x.doc_id, x.n_bytes, x.n_tokens) for x in T.count_tokens(df, T.default_tokenizer(), ["doc_id"], frequent=frequent).collect())
        assert got == sorted((k, len((t or "").encode()), reference_count(t or "")) for k, t, _ in rows)
    assert T.count_tokens(df.where("false"), T.default_tokenizer()).count() == 0


def test_counts_do_not_depend_on_what_stands_next_to_a_pre_token():
    """Each code point up to U+2100 in four contexts, alone and between white space."""
    texts = [s for c in range(1, 0x2100) for ch in [chr(c)] for s in (f"ab {ch} cd", f"ab{ch} cd", f"ab {ch}cd", f"A{ch}b")]
    for size in 50, 1 << 20:
        tiers = T.TwoTiers(T.packed_table([b"ab", b"cd"], T.default_tokenizer()), T.default_tokenizer(), cache=size)
        assert tiers.count(t.encode() for t in texts) == T.lengths_of([t.encode() for t in texts], T.default_tokenizer())


def test_segments_rejoin_and_end_where_pre_tokens_end():
    data = ("some words, " * 100 + "y" * 700 + " end").encode()
    parts = list(T.segments(data, 64))
    assert b"".join(parts) == data and [u for p in parts for u in p.split()] == data.split() and max(map(len, parts)) < 800


def test_frequent_pre_tokens_come_from_all_tasks(spark):
    rows = [(i, " ".join(["hot"] * 20 + [f"rare{i}x{j}" for j in range(30)])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    found = T.frequent_units(df, 64)
    assert found[0] == b"hot" and len(found) <= 64
    counts = T.summary((t.encode() for _, t in rows), 64)
    assert 8000 - 400 * 50 / 64 <= counts[b"hot"] <= 8000


def test_ids_of_every_code_point_are_the_tokenizer_s():
    """Packing's words give the library's ids for each code point up to U+2100 in five contexts."""
    from gritstone.llm import packing

    encoder = packing.WordTokenizer(packing.default_tokenizer())
    texts = [s for c in range(1, 0x2100) for ch in [chr(c)] for s in (f"ab {ch} cd", f"ab{ch} cd", f"ab {ch}cd", f"A{ch}b", ch)]
    want = encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert encoder.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in want]
