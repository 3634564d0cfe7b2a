"""Token counts by a map-side lookup in two tiers, without a shuffle of pre-tokens.

The tokenizer splits at white space before anything else, so a text's count is the sum over its pre-tokens, the runs
between ASCII white space, whatever stands next to them. A first pass over all texts finds the frequent pre-tokens: each
task keeps a summary of bounded size (Misra and Gries), and only summaries are merged, a few at a time. Their token
counts are the first tier, a packed table sent to every task; the rest is the second tier: each worker looks in caches of
bounded size, of pre-tokens and of the words they consist of, and encodes the words it does not know, many together. Table
and caches decide where a count is looked up, never what it is.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.llm.packing import PLAIN, SPLIT, tokenizer_at
from gritstone.llm.store import Scratch, let_workers_import

VOCABULARY = "word_bpe_49k.json"
FREQUENT = 8192  # pre-tokens of the first tier, and of each summary
FAN = 16  # summaries merged at a time
CACHE = 400_000  # pre-tokens, and words, that a worker remembers
LONGEST = 64  # bytes of a pre-token that is kept in either tier
SEGMENT = 1 << 20  # bytes of texts handled at once
BATCH_WORDS = 512  # new words encoded together
LIMIT = 2048

_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def segments(data: bytes, size: int | None = None) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes that end where a pre-token ends."""
    size, at = size or SEGMENT, 0
    while len(data) - at > size and (m := _BLANK.search(data, at + size)):
        yield data[at : m.start()]
        at = m.start()
    yield data[at:]


def pruned(counts: Counter, k: int) -> Counter:
    """A summary of at most ``k`` pre-tokens: the count of the next one is taken off all (Misra and Gries)."""
    if len(counts) <= k:
        return counts
    n = np.fromiter(counts.values(), np.int64, len(counts))
    off = int(np.partition(n, len(n) - k - 1)[len(n) - k - 1])
    return Counter({u: c - off for u, c in counts.items() if c > off})


def summary(texts: Iterable[bytes | None], k: int) -> Counter:
    """Pre-tokens of ``texts`` with counts that fall short by a k-th of all pre-tokens at most."""
    counts: Counter = Counter()
    for data in texts:
        for part in segments(data or b""):
            counts.update(part.split())
            if len(counts) > 8 * k:
                counts = pruned(Counter({u: c for u, c in counts.items() if len(u) <= LONGEST}), k)
    return pruned(Counter({u: c for u, c in counts.items() if len(u) <= LONGEST}), k)


_SUMMARY = pa.schema([("part", pa.int32()), ("units", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))])


def _summary_row(part: int, counts: Counter) -> dict:
    return {"part": part, "units": list(counts), "counts": list(counts.values())}


def _merged(rows: Iterable[dict], k: int) -> Counter:
    counts: Counter = Counter()
    for r in rows:
        counts.update(dict(zip(r["units"], r["counts"], strict=True)))
    return pruned(counts, k)


def frequent_units(docs: DataFrame, k: int = FREQUENT, text: str = "text") -> list[bytes]:
    """At most ``k`` pre-tokens of all texts, by falling count; any that is more than a k-th of them all is there."""
    let_workers_import(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "pre-tokens")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (t for b in batches for t in b.column(0).cast(pa.binary()).to_pylist())
        yield pa.RecordBatch.from_pylist([_summary_row(TaskContext.get().partitionId(), summary(texts, k))], _SUMMARY)

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        return pa.Table.from_pylist([_summary_row(rows[0]["part"], _merged(rows, k))], _SUMMARY)

    fields = "part int, units array<binary>, counts array<bigint>"
    try:
        rows = scratch.keep(docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(summarise, fields), "summaries")
        while rows.count() > FAN:
            grouped = rows.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("part")
            rows = scratch.keep(grouped.applyInArrow(merge, fields), "merged")
        last = _merged(({"units": [bytes(u) for u in r.units], "counts": r.counts} for r in rows.collect()), k)  # FAN rows at most
    finally:
        scratch.clear()
    return [u for u, _ in sorted(last.items(), key=lambda x: (-x[1], x[0]))]


def lengths_of(units: list[bytes], path: str) -> list[int]:
    """Tokens of each pre-token by the library; bytes that are no UTF-8 count as the replacement character."""
    encoder, out = tokenizer_at(path).tokenizer, []
    for i in range(0, len(units), 1024):
        texts = [u.decode("utf-8", "replace") for u in units[i : i + 1024]]
        out += [len(e.ids) for e in encoder.encode_batch_fast(texts, add_special_tokens=False)]
    return out


def packed_table(units: list[bytes], path: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The first tier as one buffer of keys, their ends, and a byte for each count (a key has LONGEST bytes at most)."""
    ends = np.cumsum([len(u) for u in units], dtype=np.uint32) if units else np.zeros(0, np.uint32)
    return b"".join(units), ends, np.array(lengths_of(units, path), np.uint8)


class TwoTiers:
    """Counts tokens of UTF-8 texts: frequent pre-tokens by the table, others by the caches, new words by the library."""

    def __init__(self, table: tuple[bytes, np.ndarray, np.ndarray], path: str, cache: int = CACHE):
        keys, ends, n = table
        starts = [0, *ends.tolist()[:-1]]
        self.frequent = {keys[a:b]: c for a, b, c in zip(starts, ends.tolist(), n.tolist(), strict=False)}
        self.path, self.most, self.units, self.words = path, cache, {}, {}

    def _encoded(self, units: list[bytes]) -> dict[bytes, int]:
        """Counts of new pre-tokens: by their words, or by the library where it might split or fold in another way."""
        split, odd, words = {}, [], set()
        for u in units:
            text = u.decode("utf-8", "replace")
            if "<|" in text or not PLAIN.fullmatch(text):
                odd.append(u)
            else:
                split[u] = SPLIT.findall(text.lower())
                words.update(split[u])
        fresh = list(words.difference(self.words))
        size = {}
        for i in range(0, len(fresh), BATCH_WORDS):
            some = fresh[i : i + BATCH_WORDS]
            size.update((w, len(ids) // 4) for w, ids in zip(some, tokenizer_at(self.path).word_ids(some), strict=True))
        known = self.words
        out = {u: sum(size[w] if w in size else known[w] for w in own) for u, own in split.items()}
        out.update(zip(odd, lengths_of(odd, self.path), strict=True))
        if len(self.words) + len(size) > self.most:
            self.words = {}
        self.words.update((w, n) for w, n in size.items() if len(w) <= LONGEST)
        return out

    def _add(self, held: list[tuple[int, list[bytes]]], out: list[int]) -> None:
        rare: list[tuple[int, list[bytes]]] = []
        get = self.frequent.get
        for i, units in held:
            n = list(map(get, units))
            out[i] += sum(filter(None, n))
            if None in n:
                rare.append((i, [u for u, c in zip(units, n, strict=True) if c is None]))
        fresh = self._encoded(list({u for _, units in rare for u in units}.difference(self.units)))
        known = self.units
        for i, units in rare:
            out[i] += sum(fresh[u] if u in fresh else known[u] for u in units)
        if len(known) + len(fresh) > self.most:
            self.units = {}
        self.units.update((u, c) for u, c in fresh.items() if len(u) <= LONGEST)

    def count(self, texts: Iterable[bytes]) -> list[int]:
        held, size, out = [], 0, []
        for data in texts:
            out.append(0)
            for part in segments(data):
                held.append((len(out) - 1, part.split()))
                size += len(part)
                if size >= SEGMENT:
                    self._add(held, out)
                    held, size = [], 0
        self._add(held, out)
        return out


_opened: dict[str, TwoTiers] = {}


def _tiers(sent: Broadcast, tag: str, path: str) -> TwoTiers:
    if tag not in _opened:
        _opened.clear()
        _opened[tag] = TwoTiers(sent.value, path)
    return _opened[tag]


def count_tokens(docs: DataFrame, tokenizer: str, keep: list[str] | None = None, text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all, if not given) with n_bytes (UTF-8) and n_tokens of the whole text.

    ``tokenizer`` is the path of a vocabulary file, which every executor can read, of a tokenizer that splits at white
    space first. Special strings inside texts count as that tokenizer takes them by default. A null text counts as
    empty: 0 and 0. Repeated rows repeat their result, ties do not arise, and columns named n_bytes or n_tokens are
    replaced. A very long text is handled in segments of SEGMENT bytes, cut at white space.
    """
    let_workers_import(docs.sparkSession)
    table = packed_table(frequent_units(docs, frequent, text), tokenizer)
    sent, tag = docs.sparkSession.sparkContext.broadcast(table), uuid.uuid4().hex
    keep = [c for c in keep or docs.columns if c not in ("n_bytes", "n_tokens")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiers = _tiers(sent, tag, tokenizer)
        for batch in batches:
            texts = [t or b"" for t in batch.column(len(keep)).cast(pa.binary()).to_pylist()]
            sizes = [pa.array([len(t) for t in texts], pa.int64()), pa.array(tiers.count(texts), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *sizes], [*keep, "n_bytes", "n_tokens"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    return rows.mapInArrow(count, f"{fields}n_bytes long, n_tokens long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, default_tokenizer(), ["doc_id"]).withColumn("over_limit", F.col("n_tokens") > LIMIT)
