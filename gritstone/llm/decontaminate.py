"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items scans every text once.

Texts and items are lower-cased (A-Z) and cut into words; runs of separators become one space. A window is 13 consecutive
item words (a shorter item is one window); windows are automaton keys with a space at either end, so a match is a match
of whole words. Each match's place in the normalised text gives word numbers, and those give spans of the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.llm.store import Scratch, let_workers_import

WINDOW = 13
CONTAMINATED_SHARE = 20  # contaminated if one word in 20 or more is hit
#: Windows that one automaton holds, some 5 KB each at most; a larger set of items is scanned in blocks of this size.
BLOCK_WINDOWS = 60_000
BATCH_ROWS = 500

_FOLD = bytes(i if 48 <= i < 58 or 97 <= i < 123 or i >= 128 else i + 32 if 65 <= i < 91 else 32 for i in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_automata: dict[str, object] = {}


def words_of(text: str) -> list[bytes]:
    """Lower-cased words of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows_of(items: list[tuple[str, str]], window: int = WINDOW) -> dict[bytes, list[str]]:
    """Window, with a space at either end, to the sorted ids of the items that hold it."""
    out: dict[bytes, set[str]] = {}
    for item, text in items:
        words = words_of(text or "")
        for i in range(max(1, len(words) - window + 1) if words else 0):
            out.setdefault(b" " + b" ".join(words[i : i + window]) + b" ", set()).add(item)
    return {k: sorted(v) for k, v in sorted(out.items())}


def window_blocks(items: Iterator[tuple[str, str]], window: int = WINDOW) -> Iterator[dict[bytes, list[str]]]:
    """``windows_of`` the items in blocks of at most BLOCK_WINDOWS (a longer item is a block of its own)."""
    held, size = [], 0
    for item, text in items:
        n = max(1, len(words_of(text or "")) - window + 1)
        if held and size + n > BLOCK_WINDOWS:
            yield windows_of(held, window)
            held, size = [], 0
        held.append((item, text))
        size += n
    if held:
        yield windows_of(held, window)


def _automaton(windows: dict[bytes, list[str]], tag: str):
    """The automaton of a block of windows, kept for the worker's later batches and tasks."""
    import ahocorasick

    if tag not in _automata:
        _automata.clear()
        a = ahocorasick.Automaton()
        for k, v in windows.items():
            a.add_word(k.decode("latin-1"), (k.count(b" ") - 1, v))
        a.make_automaton()
        _automata[tag] = a
    return _automata[tag]


def spans_of(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as (start, end) in code points of the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    found = [m.span() for m in _WORD.finditer(raw)]
    code = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) if raw else np.zeros(0, int)
    out: list[list[int]] = []
    last = -2
    for w in np.flatnonzero(hit):
        a, b = found[w]
        start, end = int(code[a]) - 1, int(code[b - 1])
        if w == last + 1:
            out[-1][1] = end
        else:
            out.append([start, end])
        last = w
    return [(a, b) for a, b in out]


def _scan(texts: list[str | None], windows: dict[bytes, list[str]], tag: str) -> Iterator[tuple[list[tuple[int, int]], list[str]]]:
    """(runs of hit words as (first, number), sorted item ids) of each text."""
    automaton = _automaton(windows, tag) if windows else None
    for text in texts:
        x = b" ".join(words_of(text)) if text and automaton else b""
        ends, hit, items = None, None, set()
        for stop, (n, ids) in automaton.iter(f" {x.decode('latin-1')} ") if x else ():
            if ends is None:  # word number by the position of the space after it
                ends = np.flatnonzero(np.frombuffer(b" " + x + b" ", np.uint8) == 32)
                hit = np.zeros(len(ends) + 1, np.int8)
            last = int(np.searchsorted(ends, stop)) - 1
            hit[last - n + 2 : last + 2] = 1  # with a zero before the first word
            items.update(ids)
        edge = np.flatnonzero(np.diff(hit)) if hit is not None else np.zeros(0, int)
        yield list(zip(edge[0::2].tolist(), (edge[1::2] - edge[0::2]).tolist(), strict=True)), sorted(items)


def _counted(text: str | None, runs: list[tuple[int, int]]) -> tuple[int, int, list[tuple[int, int]]]:
    """(words, hit words, spans) of a text by its runs of hit words, which may overlap."""
    n = len(words_of(text)) if text else 0
    if not runs:
        return n, 0, []
    hit = np.zeros(n, bool)
    for first, length in runs:
        hit[first : first + length] = True
    return n, int(hit.sum()), spans_of(text, hit)


RUN = pa.struct([("first", pa.int32()), ("length", pa.int32())])
SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
NEW = ("n_words", "n_hit", "items", "hit_spans")
FOUND = "n_words long, n_hit long, items array<string>, hit_spans array<struct<start:int,end:int>>"


def _judged(batch: pa.RecordBatch, at: int, runs: list, ids: list) -> pa.RecordBatch:
    """``batch`` with the new columns, for the texts in column ``at``."""
    found = [_counted(t, r) for t, r in zip(batch.column(at).to_pylist(), runs, strict=True)]
    spans = pa.array([[{"start": a, "end": b} for a, b in f[2]] for f in found], pa.list_(SPAN))
    new = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array(ids, pa.list_(pa.string())), spans]
    return pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *NEW])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, BATCH_ROWS):
            yield whole.slice(start, BATCH_ROWS)


def _sent(spark: SparkSession, windows: dict[bytes, list[str]]):
    return spark.sparkContext.broadcast(windows), hashlib.sha256(b"\n".join(k + ",".join(v).encode() for k, v in windows.items())).hexdigest()


def _found_by_blocks(docs: DataFrame, blocks: Iterator[dict[bytes, list[str]]]) -> DataFrame:
    """``find_items`` for more windows than a block: one pass over all texts for each block, then the runs put together."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    rows = scratch.keep(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    passes = []
    for windows in blocks:
        sent, tag = _sent(spark, windows)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent, tag=tag) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches):
                hits = [(k, r, i) for k, (r, i) in zip(batch.column(0).to_pylist(), _scan(batch.column(1).to_pylist(), sent.value, tag), strict=True) if r]
                runs = pa.array([[{"first": a, "length": n} for a, n in h[1]] for h in hits], pa.list_(RUN))
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.int64()), runs, pa.array([h[2] for h in hits], pa.list_(pa.string()))], ["__row", "runs", "ids"])

        found = rows.select("__row", "text").mapInArrow(scan, "__row long, runs array<struct<first:int,length:int>>, ids array<string>")
        passes.append(scratch.keep(found, "pass"))
        sent.destroy()
    found = passes[0]
    for p in passes[1:]:
        found = found.union(p)
    found = found.groupBy("__row").agg(
        F.flatten(F.collect_list("runs")).alias("__runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("__ids")
    )
    whole = rows.join(found, "__row", "left").drop("__row")
    at, width = whole.columns.index("text"), len(docs.columns)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            runs = [[(x["first"], x["length"]) for x in r or []] for r in batch.column(width).to_pylist()]
            yield _judged(batch.select(range(width)), at, runs, [i or [] for i in batch.column(width + 1).to_pylist()])

    return whole.mapInArrow(judge, _fields(docs))


def _fields(docs: DataFrame) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), FOUND])


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds n_words, n_hit, items (ids as sorted strings) and hit_spans (code points) to ``docs`` (which needs ``text``).

    ``items`` has ``item_id`` and ``text``; its windows are the stated query set that goes to every task. The driver and
    the tasks hold one block of BLOCK_WINDOWS at a time; more windows cost one pass over the texts for each block. Items
    without words or with a null id are left out; a null or wordless document has no words and no hits, and without items
    nothing is hit. Windows that overlap or that several items share count each word once and name every item. Texts of
    any length are scanned whole, in memory that grows with the text. Repeated rows repeat their result; columns of
    ``docs`` that bear one of the new names are replaced.
    """
    spark = docs.sparkSession
    let_workers_import(spark)
    docs = docs.drop(*NEW)
    rows = ((str(r[0]), r[1]) for r in items.where("item_id is not null").select("item_id", "text").toLocalIterator())
    blocks = window_blocks(rows, window)
    first, second = next(blocks, {}), next(blocks, None)
    if second is not None:
        return _found_by_blocks(docs, chain([first, second], blocks))
    sent, tag = _sent(spark, first)
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            runs, ids = zip(*_scan(batch.column(at).to_pylist(), sent.value, tag), strict=True)
            yield _judged(batch, at, runs, ids)

    return docs.mapInArrow(scan, _fields(docs))


def is_contaminated(share: int = CONTAMINATED_SHARE):
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_items(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )
