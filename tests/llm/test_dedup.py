"""Near-duplicate search in texts and vectors, components and sharding against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.llm import near_dedup as N
from gritstone.llm import sharding as H
from gritstone.llm import vector_dedup as V
from gritstone.llm.graph import components
from gritstone.llm.shingles import shingle_sets
from gritstone.llm.store import Scratch


def lowest(pairs, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5), (7, None)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {x.node: x.component for x in components(spark, df, Scratch(spark, "test")).collect()}
    want = lowest([p for p in pairs if None not in p], range(500))
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] and None not in p for p in pairs)}
    assert components(spark, df.where("false"), Scratch(spark, "test")).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def texts():
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghij", k=4))
    out = []
    for _ in range(12):
        base = [word() for _ in range(r.randint(30, 120))]
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.randint(0, len(base) // 12)):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    common = " ".join(word() for _ in range(60))
    out += [f"{' '.join(word() for _ in range(50))} {common}" for _ in range(40)]  # one passage in many documents
    hub = [word() for _ in range(100)]
    for _ in range(40):  # many near copies, about half of them near each other
        copy = list(hub)
        for _ in range(r.randint(0, 6)):
            copy[r.randrange(100)] = word()
        out.append(" ".join(copy))
    return out + [None, "", " \n ", "one two", "ONE\ttwo", "one two three", "x " * 3000, out[0], out[0].upper(), "É a b c d e", "é a b c d e"]


def crowds(size=100):
    """Two groups of near copies that are less alike between them, but for one pair, and share their buckets."""
    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(400)]
    other = base[:330] + [f"v{r.randrange(10**6)}" for _ in range(70)]
    out = []
    for text in (base, other):
        for i in range(size):
            out.append(" ".join([*text[:200], f"{text[0]}{i}", *text[200:]]))
    return [*out, " ".join([*base[:200], "odd", *base[200:345], *other[345:]])]


@pytest.mark.parametrize("best", [N.BEST, 1])
@pytest.mark.parametrize("make", ["texts", "crowds"])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, make, best):
    monkeypatch.setattr(N, "BEST", best)
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "SET_BLOCK", 4000)
    monkeypatch.setattr(N, "PAIRS_AT_ONCE", 500)
    data = dict(enumerate(texts() if make == "texts" else crowds(40)))
    sets = {i: shingles(t) for i, t in data.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = lowest(pairs, data)
    df = spark.createDataFrame([(i, t, -1, True) for i, t in data.items()], "doc_id long, text string, component_id long, kept boolean")
    rows = N.near_duplicates(df).collect()
    assert len(rows) == len(data)
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_crowded_components_give_few_pairs(spark, monkeypatch):
    """Two groups that share their buckets pass fine sketches pair by pair, but don't leave the tasks so."""
    made = {}
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: made.setdefault(name, keep(self, df, name)) if name.startswith("across") else keep(self, df, name))
    monkeypatch.setattr(Scratch, "drop", lambda self, *tables: None)
    counts = {}
    for size in (50, 200):
        made.clear()
        rows = crowds(size)[:-1]
        df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
        got = Counter(r.component_id for r in N.near_duplicates(df).collect())
        assert got == {0: size, size: size}
        counts[size] = made["across"].count(), made["across-near"].count()
    assert counts[200][1] <= 10 * N.BEST  # of 40,000
    assert counts[200][0] <= 4 * max(counts[50][0], 40)


def test_one_id_with_two_texts_is_one_document(spark):
    r = random.Random(4)
    a, b = (" ".join(f"w{r.randrange(10**6)}" for _ in range(80)) for _ in range(2))
    rows = [(1, a + " x"), (2, a), (2, b), (2, b), (3, b + " y")]
    got = {(x.doc_id, x.component_id) for x in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}


def test_a_very_long_text(spark):
    r = random.Random(6)
    words = [f"w{r.randrange(10**6)}" for _ in range(60_000)]
    rows = [(5, " ".join(words)), (6, " ".join([*words[:30_000], "new", *words[30_000:]])), (7, " ".join(words[::-1]))]
    got = {(x.doc_id, x.component_id) for x in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 5), (6, 5), (7, 7)}


def test_null_ids_repeated_rows_and_no_rows(spark):
    long = "a b c d e f g h"
    df = spark.createDataFrame([(None, long), (4, long), (4, long), (2, long), (9, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 4, None, False), (4, 4, 2, False), (4, 4, 2, False), (2, 4, 2, True), (9, 0, 9, True)], key=str)
    assert N.near_duplicates(df.where("false")).count() == 0


def test_shingle_sets_have_the_right_sizes_and_overlaps():
    data = texts()
    ours = shingle_sets(data)
    assert [len(s) for s in ours] == [len(shingles(t)) for t in data]
    for a, b in zip(data[:40], data[1:41], strict=True):
        i, j = data.index(a), data.index(b)
        assert len(np.intersect1d(ours[i], ours[j])) == len(shingles(a) & shingles(b))


def test_odd_sketch_estimates_similarity():
    r = np.random.default_rng(5)
    for j in (0.6, 0.75, 0.9):
        n = 2000
        shared = r.integers(0, 2**63, int(n * 2 * j / (1 + j)), dtype=np.uint64)
        x, y = (np.unique(np.concatenate((shared, r.integers(0, 2**63, n - len(shared), dtype=np.uint64)))) for _ in range(2))
        m = N.signatures([x, y], N.FINE_MINHASHES)
        s = N.odd_sketch(m, N.FINE_WORDS)
        ones = int(np.bitwise_count(s[0] ^ s[1]).sum())
        bits = 64 * N.FINE_WORDS
        assert abs(1 + bits / (4 * N.FINE_MINHASHES) * np.log(1 - 2 * ones / bits) - j) < 0.08


def vectors():
    r = np.random.default_rng(7)
    rows = []
    for label in (0, 1, None):
        for c in r.normal(size=(20, 16)):
            rows += [(c + r.normal(size=16) * s, label) for s in r.choice([0.0, 0.1, 0.25], r.integers(1, 6))]
    hub = r.normal(size=16)
    rows += [(hub + r.normal(size=16) * 0.12, 1) for _ in range(60)]
    out = [(i, [float(x) for x in np.float32(v)], label) for i, (v, label) in enumerate(rows)]
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    return out + [(1000 + i, v, 1) for i, v in enumerate(bad)]


def test_vector_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 16)
    data = vectors()
    unit = {}
    for i, v, label in data:
        if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v):
            unit[i] = (label, np.array(v) / np.linalg.norm(v))
    pairs = [(a, b) for a in unit for b in unit if a < b and unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= 0.93]
    want, links = lowest(pairs, [d[0] for d in data]), Counter(x for p in pairs for x in p)
    df = spark.createDataFrame([(*d, 5) for d in data], "vec_id long, embedding array<float>, label int, n_links int")
    rows = V.near_duplicate_vectors(df).collect()
    assert len(rows) == len(data)
    for r in rows:
        assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id)


@pytest.mark.parametrize("block", [V.CROSS_BLOCK, 16])
def test_tight_groups_joined_by_weaker_links_are_one_component(spark, monkeypatch, block):
    monkeypatch.setattr(V, "CROSS_BLOCK", block)
    monkeypatch.setattr(V.VectorSearch, "audit", lambda self, *a: self.spark.createDataFrame([], "a long, b long"))  # no help from it
    r = np.random.default_rng(11)
    one, two, far = np.eye(16)[0], 0.93 * np.eye(16)[0] + np.sqrt(1 - 0.93**2) * np.eye(16)[1], np.eye(16)[2]
    data = [v + r.normal(size=16) * 0.004 for v in (one, two, far) for _ in range(40)]
    unit = [np.float32(v) / np.linalg.norm(np.float32(v)) for v in data]
    pairs = [(a, b) for a in range(120) for b in range(a) if unit[a] @ unit[b] >= 0.93]
    assert min(unit[a] @ unit[b] for a in range(40) for b in range(40)) > max(unit[a] @ unit[b] for a in range(40) for b in range(40, 80))
    want, links = lowest(pairs, range(120)), Counter(x for p in pairs for x in p)
    assert set(want.values()) == {0, 80}
    df = spark.createDataFrame([(i, [float(x) for x in np.float32(v)], 1) for i, v in enumerate(data)], "vec_id long, embedding array<float>, label int")
    assert {x.vec_id: (x.n_links, x.component_id) for x in V.near_duplicate_vectors(df).collect()} == {i: (links[i], want[i]) for i in want}


def test_a_failed_audit_searches_until_the_found_edges_suffice_or_fails(spark, monkeypatch):
    df = spark.createDataFrame([x for x in vectors() if x[0] < 1000], "vec_id long, embedding array<float>, label int")
    want = sorted(map(tuple, V.near_duplicate_vectors(df).collect()))
    real, calls = V.VectorSearch.orders, []

    def late(self, trees):
        calls.append(trees)
        return real(self, trees) if len(calls) > 2 else spark.createDataFrame([], V.EDGE)

    with monkeypatch.context() as m:
        m.setattr(V.VectorSearch, "orders", late)
        assert sorted(map(tuple, V.near_duplicate_vectors(df).collect())) == want and len(calls) == 3
    monkeypatch.setattr(V, "MORE", 1)
    monkeypatch.setattr(V, "ROUNDS", 0)
    monkeypatch.setattr(V.VectorSearch, "orders", lambda self, trees: spark.createDataFrame([], V.EDGE))
    with pytest.raises(RuntimeError, match="finds 0.0000 of the audited links"):
        V.near_duplicate_vectors(df)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert V.near_duplicate_vectors(df).count() == 0


@pytest.mark.parametrize("shards", [3, 24])
def test_shards_are_even_and_groups_together(spark, shards):
    r = random.Random(2)
    data = [f"text {i}" for i in range(300)] + [f"copy {i % 40}" for i in range(120)] + ["hot"] * 150 + [None] * 5 + ["", "é"]
    r.shuffle(data)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(data)], "doc_id long, text string, shard int")
    rows = H.shard_documents(df, shards).collect()
    by = Counter(x.shard for x in rows)
    assert len(rows) == len(data) and set(by) == set(range(shards)) and max(by.values()) - min(by.values()) <= 1
    for s in by:
        assert sorted(x.slot for x in rows if x.shard == s) == list(range(by[s]))
    assert all(x["size"] == len((data[x.doc_id] or "").encode()) + 8 for x in rows)
    places = {}
    for x in rows:
        places.setdefault(data[x.doc_id], set()).add(x.shard)
    small = [t for t in places if t and t.startswith("copy")]
    assert sum(len(places[t]) > 1 for t in small) <= len(small) // 4


@pytest.mark.parametrize("hot", [240, 20])
def test_hot_groups_fill_as_few_shards_as_hold_them(spark, hot):
    data = [f"hot {i}" for i in range(480 // hot) for _ in range(hot)] + [f"copy {i % 60}" for i in range(120)] + [f"text {i}" for i in range(120)]
    random.Random(6).shuffle(data)
    rows = H.shard_documents(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")).collect()
    assert len(rows) == 720 and set(Counter(x.shard for x in rows).values()) == {30}
    places = {t: {x.shard for x in rows if data[x.doc_id] == t} for t in set(data)}
    assert all(len(p) <= -(-hot // 30) + 1 for t, p in places.items() if t.startswith("hot"))


def planted_graph(r, groups=3, size=24):
    """Sparse edges, nearly all within a planted group of rows whose ids are mixed."""
    ids = list(range(groups * size))
    r.shuffle(ids)
    of = {x: i // size for i, x in enumerate(ids)}
    edges = set()
    for g in range(groups):
        own = ids[g * size : (g + 1) * size]
        edges |= {(own[i], own[(i + d) % size]) for i in range(size) for d in (1, 2)}
    edges |= {tuple(r.sample(ids, 2)) for _ in range(6)}
    return of, sorted(edges)


def cut_links(shard, edges):
    return sum(shard[a] != shard[b] for a, b in {tuple(sorted(e)) for e in edges})


def test_edges_pull_rows_together_and_counts_stay_even(spark, monkeypatch):
    r = random.Random(8)
    of, edges = planted_graph(r)
    n = len(of)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(n)] + [(n + i, "same") for i in range(6)], "doc_id long, text string")
    messy = [*edges, *[(b, a) for a, b in edges[:9]], (3, 3), (None, 4), (5, None), (10**6, 2), (n, edges[0][0])]
    table = spark.createDataFrame([(a, b, 1) for a, b in messy], "a long, b long, shard int")
    shards = lambda rows: {x.doc_id: x.shard for x in rows.collect()}
    before, after = shards(H.shard_documents(docs, 3)), shards(H.shard_documents(docs, 3, table))
    assert set(Counter(after.values()).values()) == {(n + 6) // 3}
    every = [*edges, (n, edges[0][0])]
    assert cut_links(after, every) < 0.6 * cut_links(before, every)
    assert len({after[n + i] for i in range(6)}) == len({before[n + i] for i in range(6)})  # groups of equal texts have settled
    monkeypatch.setattr(H, "HUB", 2)
    assert shards(H.shard_documents(docs, 3, table)) == after
    none = spark.createDataFrame([], "a long, b long")
    assert shards(H.shard_documents(docs, 3, none)) == before


def test_settling_moves_keeps_counts():
    r = random.Random(4)
    for _ in range(50):
        k = r.randint(2, 6)
        wish = [[0 if i == j else r.randint(0, 9) for j in range(k)] for i in range(k)]
        free = [r.randint(0, 12) for _ in range(k)]
        move, fill = H.settle(wish, free)
        for j in range(k):
            into = sum(move[i][j] + fill[i][j] for i in range(k))
            assert into == sum(move[j]) + sum(fill[j]) and sum(fill[j]) <= free[j]
            assert all(0 <= move[i][j] <= wish[i][j] for i in range(k))


def test_no_documents_to_shard(spark):
    assert H.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_are_numbered_without_gaps(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    rows = H.numbered(df, ["g"], ["id"], "n").collect()
    for g in range(3):
        assert sorted(r.n for r in rows if r.g == g) == list(range(sum(r.g == g for r in rows)))
