"""Language identification, packing, main text of pages and the pipeline."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gritstone.llm import html_main as W
from gritstone.llm import language_id as L
from gritstone.llm import packing as P

WORDS = {"aa": "kiva nolu sare timo pelu", "bb": "zwart krijg strom pfalz grund", "cc": "niño año señal español mañana"}


def speech(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join(r.choice(WORDS[lang].split()) for _ in range(n))


def labelled(spark):
    rows = [(i, speech(lang, 30, i), lang) for k, lang in enumerate(WORDS) for i in range(k * 100, k * 100 + 40)]
    rows += [(900, None, "aa"), (901, "123", "bb"), (902, "kiva", None), (None, "zwart", "bb")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def plain_length(model_counts, order, text):
    """Bits of a text in one language, byte by byte."""
    data, bits = L.PAD * order + text, 0.0
    for at in range(order, len(data)):
        for o in range(order, -1, -1):
            after = model_counts[o].get(data[at - o : at])
            if after is None:
                continue
            total = sum(after.values()) + len(after)
            if data[at] in after:
                bits -= np.log2(after[data[at]] / total)
                break
            bits -= np.log2(len(after) / total)
        else:
            bits += 8
    return bits


def test_code_lengths_are_those_of_the_trees(spark, monkeypatch):
    docs = labelled(spark)
    model = L.fit(docs, order=3)
    assert model.langs == ["aa", "bb", "cc"]
    counts = {lang: [defaultdict(lambda: defaultdict(int)) for _ in range(4)] for lang in model.langs}
    for r in docs.where("lang is not null and doc_id is not null and text is not null and text <> '123'").collect():
        data = L.PAD * 3 + L.folded(r.text)
        for at in range(3, len(data)):
            for o in range(4):
                counts[r.lang][o][data[at - o : at]][data[at]] += 1
    monkeypatch.setattr(L, "SEGMENT", 64)
    some = [L.folded(t) for t in ("kiva nolu", "zwart", "x", "señal y más", "kiva " * 50, "")]
    got = model.score(some)
    for i, t in enumerate(some):
        for k, lang in enumerate(model.langs):
            assert got[i, k] == pytest.approx(plain_length(counts[lang], 3, t), rel=1e-4, abs=1e-3)


def test_held_out_texts_are_told_apart(spark):
    model = L.fit(labelled(spark))
    rows = [(i, speech(lang, 6, 7000 + i), lang, "z", 0.5) for i, lang in enumerate(list(WORDS) * 20)]
    rows += [(100, None, "aa", "z", 0.5), (101, "", "aa", "z", 0.5), (102, "42 !?", "aa", "z", 0.5), (103, "kiva " * 200_000, "aa", "z", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    got = {r.doc_id: r for r in L.predict(df, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (100, 101, 102, 103)] == ["und", "und", "und", "aa"]
    assert sum(got[i].lang_pred == got[i].lang for i in range(60)) >= 58
    none = L.fit(labelled(spark).where("false"))
    assert {r.lang_pred for r in L.predict(df, none).collect()} == {"und"}


def test_predictions_are_the_same_whether_the_text_is_kept_or_not(spark):
    model = L.fit(labelled(spark))
    texts = [None, "42 é!", "", "kiva é nolu", "señal y más", "ü"]
    rows = [(i, texts[i % 6] if i % 4 else speech("aa", 5, i)) for i in range(3 * L.BATCH_ROWS + 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    kept, alone = L.predict(df, model), L.predict(df, model, ["doc_id"])
    assert {(r.doc_id, r.text) for r in kept.collect()} == set(rows)
    assert sorted(kept.drop("text").collect()) == sorted(alone.collect())


def test_long_texts_train_and_texts_without_letters_take_no_place(spark):
    words = {"aa": "kiva lomu ", "bb": "strech glypt "}
    rows = [(i, words["aa"] * 20_000, "aa") for i in range(4)] + [(10 + i, words["bb"] * 5 if i == 30 else "12 !", "bb") for i in range(40)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=3)
    assert model.langs == ["aa", "bb"]
    got = L.predict(spark.createDataFrame([(1, "lomu kiva"), (2, "glypt strech")], "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "aa", 2: "bb"}
    text = bytes(range(256)) * 1000
    parts = L.slices(L.PAD * 4 + text, 4)
    assert sum(len(p) - 4 for p in parts) == L.TRAIN_BYTES and parts[0][4:] == text[: len(parts[0]) - 4] and parts[-1] == text[-len(parts[-1]) :]
    assert L.slices(L.PAD * 4 + b"short", 4) == [L.PAD * 4 + b"short"]


def test_held_out_ids(spark):
    rows = spark.range(200).select("id", L.is_held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_tables_find_every_key():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 2**40, 5000, dtype=np.uint64))
    t = L.Table(keys)
    assert (t.find(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(r.integers(0, 2**40, 5000, dtype=np.uint64), keys)
    assert (t.find(other) == len(keys)).all()


TEXTS = [None, "", "Hello, World! It's 2024.", "naïve café — “quoted”", "漢字 and more", "<|endoftext|> special", "x" * 3000, "a b " * 9000, "İstanbul ſ K", "tabs\tand\nlines", "don't!!?..'s"]


def test_words_have_the_tokenizers_ids():
    enc = P.WordTokenizer(P.default_tokenizer())
    some = [t for t in TEXTS if t is not None] * 2
    want = [np.array(e.ids, "<u4").tobytes() for e in enc.tokenizer.encode_batch(some, add_special_tokens=False)]
    assert enc.encode(some) == want


def test_words_encoded_together_have_the_ids_of_each_alone():
    enc = P.WordTokenizer(P.default_tokenizer())
    words = ["'s", "'", "..'", "s", "7", "¼", "ǆ", "ñandú", "x" * 3000, "‐‑", "\x00", "°", "antidisestablishmentarianism"] * 3
    assert enc.word_ids(words) == enc._ids(words)
    assert enc.word_ids(["two words", "s"]) == enc._ids(["two words", "s"])  # more ends than words: one by one


@pytest.mark.parametrize("window", [16, 64, 4096])
def test_packing_is_an_exact_cover(spark, window):
    texts = TEXTS + [speech("aa", random.Random(i).randint(0, 300), i) for i in range(150)]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, length long").repartition(3)
    rows = P.pack_documents(df, P.default_tokenizer(), window).collect()
    tok = P.WordTokenizer(P.default_tokenizer()).tokenizer
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length and r.length > 0
    assert set(docs) == set(range(len(texts)))
    for i, parts in docs.items():
        ids = [*tok.encode(texts[i] or "", add_special_tokens=False).ids, P.END_ID]
        parts.sort(key=lambda r: r.start)
        assert [x for r in parts for x in np.frombuffer(r.ids, "<u4").tolist()] == ids and {r.doc_tokens for r in parts} == {len(ids)}
        assert [r.start for r in parts] == np.cumsum([0] + [r.length for r in parts[:-1]]).tolist()
    for parts in seqs.values():
        parts.sort(key=lambda r: r.offset)
        fill = sum(r.length for r in parts)
        assert [r.offset for r in parts] == np.cumsum([0] + [r.length for r in parts[:-1]]).tolist()
        unit = 16 if window == 4096 else 1  # the tokens of a level: padding is less than one for each piece
        assert fill > window - max(1, (unit - 1) * len(parts) + 1) or fill & (fill - 1) == 0 and fill < window
    assert P.pack_documents(df.where("false"), P.default_tokenizer()).count() == 0


def test_placement_minimises_the_sum_of_squares():
    r = random.Random(6)
    s, counts, level, fresh = P.SumOfSquares(20), [0] * 21, {}, 0
    for _ in range(400):
        n = r.randint(1, 19)

        def after(h):
            c = list(counts)
            c[h] -= h > 0
            c[h + n] += h + n < 20
            return sum(x * x for x in c)

        best = min(after(h) for h in range(0, 21 - n) if h == 0 or counts[h])
        number, h = s.place(n, fresh)
        assert after(h) == best and level.get(number, 0) == h
        fresh += h == 0
        counts[h] -= h > 0
        counts[h + n] += h + n < 20
        level[number] = h + n


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li>Home</li></ul></nav>'
    '<div class="cookie-notice">We use cookies</div>{0}<aside>Side</aside><div id="comments"><p>Nice!</p></div><form><p>Mail</p></form><footer>&copy; 2024</footer></body></html>'
)


@pytest.mark.parametrize(
    "html, text",
    [
        (PAGE.format("<article><h1>Head</h1><p>One <b>bo</b>ld &amp; two<br>three\n\n four<p>Last &lt;p&gt;</article>"), "Head One bold & two three four Last <p>"),
        (PAGE.format('<article><p>a</p><div class="ad">buy</div><p>b</p><div class="share">x</div></article>'), "a b"),
        ("<article><p>cut off", "cut off"),
        ("<article><p>x<footer>no</footer>", "x"),
        ('<main role="main"><p>in main</p></main>', "in main"),
        ('<div class="layout has-sidebar"><article><p>a</p></article></div>', "a"), ('<div class="no-sidebar"><p>a</p></div>', "a"),
        ('<div class="content-sidebar-wrap page with-banner"><main>a</main></div>', "a"), ('<div class="widget"><article>a<p class="ad">b</p></article></div>', "a"),
        ('<article><p id="related-work">a</p><p aria-label="Share of the market">b</p><p aria-label="Share">c</p></article>', "a b"),
        ('<article>a</article><article class="comment">b</article><div id="comments"><article>c</article></div><div class="sidebar"><article>d</article></div>', "a"),
        ('<div>a</div><div id="comments"><article>c</article></div><article class="comment-body">d</article><div class="cookie-notice">e</div>', "a"),
        ('<div>a<span class="ad">b<p>c</p></span></div>', "a"),
        (None, ""), ("", ""), ("just text", "just text"), ("<!-- <article>no</article> -->", ""), ("<article>" + "<p>w</p>" * 5000 + "</article>", " ".join(["w"] * 5000)),
    ],
)
def test_main_text(html, text):
    main, loose = W.lines_of(html or "")
    assert " ".join(main or loose) == text


def test_pages_without_article_lose_what_they_share_with_their_neighbour(spark):
    page = lambda body: f"<body><div>Our site</div><div>Top offers</div>{body}<div>About us</div></body>"
    rows = [(1, "http://h/a/1", page("<p>first</p><p>own</p>"), 1), (2, "http://h/a/2", page("<p>second</p>"), 1), (3, "http://other/x", page("<p>alone</p>"), 1), (4, None, None, 1), (5, "http://h/a/3", "<article>x</article>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int").coalesce(1)
    got = {r.page_id: r.text for r in W.main_text(df).collect()}
    assert got == {1: "first own", 2: "second", 3: "Our site Top offers alone About us", 4: "", 5: "x"}
    assert W.main_text(df.where("false")).count() == 0


def test_copies_without_article_do_not_delete_each_other(spark):
    page = lambda body: f"<div>Our site</div>{body}<div>About us</div>"
    long = f"<p>{'some own words ' * 20}</p>"
    rows = [(i, f"http://h/a/x?id={i}", page(long)) for i in range(3)] + [(3, "http://h/a/x", page(long + "<p>17 views</p>")), (4, "http://h/b/y", page("<p>other</p>")), (5, "http://h/b/yz", page("<p>more</p>"))]
    rows += [(i, None, "<p>copy</p>") for i in (6, 7)] + [(8, "http://k/z", page("<p>one</p>")), (9, "http://k/z", page("<p>one</p>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    own = " ".join(("some own words " * 20).split())
    want = {0: own, 1: own, 2: own, 3: f"{own} 17 views", 4: "other", 5: "more", 6: "copy", 7: "copy", 8: "Our site one About us", 9: "Our site one About us"}
    assert {r.page_id: r.text for r in W.main_text(df).collect()} == want


def test_shared_lines_are_a_longest_common_subsequence():
    r = random.Random(8)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = sorted(W.shared_lines(a, b))
        it = iter(b)
        assert len(got) == best[-1][-1] and all(a[i] in it for i in got)


def test_shared_lines_of_long_pages_with_many_equal_lines():
    r = random.Random(9)
    a, b = ["x"] * 20_000 + ["a"], ["b"] + ["x"] * 19_000 + ["y"] * 1000
    assert len(W.shared_lines(a, b)) == 19_000
    a, b = ([r.choice("abc") for _ in range(5000)] for _ in range(2))
    got = sorted(W.shared_lines(a, b))
    it = iter(b)
    assert len(got) == W._lengths(a, b)[-1] > 3000 and all(a[i] in it for i in got)


@pytest.mark.parametrize("n, most", [(10_000, 0.02), (600, 0.2)])
def test_sum_of_squares_places_whole_documents(n, most):
    """Of documents of about a thousand tokens few are cut, little is padded, and little is left to a task's end."""
    r = random.Random(2)
    lengths = [(i, 1 + int(r.expovariate(1 / 900))) for i in range(n)]
    whole, by, seen, cut, padded = sum(x for _, x in lengths), {}, {}, defaultdict(int), 0
    for number, pieces, kind in P.pack_stream(iter(lengths)):
        assert number not in seen
        seen[number] = size = sum(p[2] for p in pieces)
        assert size == 4096 or kind == "levels" and size > 4096 - 16 * len(pieces) or kind == "rest" and size & (size - 1) == 0
        by[kind] = by.get(kind, 0) + size
        padded += 4096 - size if kind == "levels" else 0
        for p in pieces:
            cut[p[0]] += 1
    assert sum(by.values()) == whole and padded < 0.02 * whole
    assert by["rest"] <= most * whole and sum(cut[i] > 1 for i, x in lengths if x <= 4096) < 0.1 * n


def test_pipeline_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    item = " ".join(f"item{i}" for i in range(20))
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    clean = [(i, speech(lang, 60, i), lang) for i, lang in enumerate(list(WORDS) * 10)]
    rows = [*clean, (50, clean[3][1], "aa"), (51, clean[4][1] + " tail", "bb"), (52, f"{speech('aa', 20, 1)} {item}", "aa"), (53, f"{speech('aa', 40, 2)} token = {key} end", "aa"), (54, None, "aa"), (55, "12 34", None)]
    spark.createDataFrame([(*r, f"s{r[0]}", len(r[1] or ""), "more") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, extra string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, sizes = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns
        after.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        sizes.append({r.doc_id for r in docs.select("doc_id").collect()})
    ids = {r[0] for r in rows}
    assert sizes == [ids - {54, 55}, ids - {50, 51, 54, 55}, ids - {50, 51, 52, 54, 55}, ids - {50, 51, 52, 54, 55}]
    text = docs.where("doc_id = 53").first()
    assert key not in text.text and text.n_chars == len(text.text)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == sizes[-1]


def open_page(i, own, shared):
    return (i, f"http://h{i % 2}.example/dir{i // 10}/page{i:03d}", f"<html><body><div><p>{own}</p><p>{shared}</p></div></body></html>")


def test_neighbours_do_not_depend_on_partitions(spark):
    """Pages without an article, among them copies and repeated rows, dealt to 1, 4 and 40 tasks, in blocks of any size."""
    rows = [open_page(i, f"story {speech('bb', 12, i)}", "the line that all pages of the host share") for i in range(60)]
    rows += [open_page(100 + i, "one copy of many", "the line that all pages of the host share") for i in range(8)] + rows[3:5] + [(900, None, rows[0][2]), (901, None, rows[1][2])]
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    seen = []
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in 1, 4, 40:
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            df = spark.createDataFrame(rows if n != 4 else rows[::-1], "page_id long, url string, html string").repartition(n)
            seen.append(sorted(map(repr, W.main_text(df).collect())))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == len(rows)
    assert not any("that all pages" in r for r in seen[0])


def test_blocks_number_the_pages_of_a_host(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 7)
    rows = [(i, f"http://h{i % 3}.example/{i:03d}", f"h{i % 3}.example", f"/{i:03d}", [f"line {i}"], True) for i in range(90)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, path string, open array<string>, lacks boolean").repartition(9)
    got = {r.page_id: (r.host, r.block) for r in W._numbered(W.Scratch(spark, "t"), df).collect()}
    assert got == {i: (f"h{i % 3}.example", i // 3 // 7) for i in range(90)}


@pytest.mark.parametrize("name", ["ad-slot", "advert_top", "promo-box", "newsletter-signup", "sidebar-left", "post-comment", "user-comments", "comment-thread", "hidden"])
def test_marked_parts_go_inside_an_article(name):
    for mark in f'class="x {name}"', f"id='{name}'":
        main, _ = W.lines_of(f"<body><article><p>kept</p><div {mark}><p>gone</p></div><p>too</p></article></body>")
        assert main == ["kept", "too"]


def test_other_classes_stay_and_wrappers_of_articles_too():
    for name in "no-sidebar", "related-work", "with-banner", "headline", "adapter", "commentary":
        assert W.lines_of(f'<body><div class="layout has-sidebar"><article><section class="{name}"><p>kept</p></section></article></div></body>')[0] == ["kept"]


@pytest.mark.parametrize("broken", ['<a "', "<script ", '<div class="', "<!x ", "<a '\"<", "<i>"])
def test_a_megabyte_of_broken_tags_takes_no_longer_than_its_length(broken):
    import time

    began = time.process_time()
    W.lines_of(broken * (500_000 // len(broken)) + "</b>" * 125_000)
    assert time.process_time() - began < 2
