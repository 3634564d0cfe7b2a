"""Language identification by prediction by partial matching.

For each language a context tree over bytes, of order up to ORDER, counts which byte followed each context in a bounded
sample of labelled documents. The statistics are then frozen. The code length of a byte is -log2 n(s | c) / (n(c) + d(c))
in the longest context where it was seen; every longer context that was seen without it costs an escape, -log2
d(c) / (n(c) + d(c)), with d the number of different bytes after c. A text goes to the language with the shortest exact
code length over all its bytes.

Trees of all languages are held together: one table for each order, from context and byte to a code length for each
language, so that a text is scored for all languages in one pass of array lookups.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gritstone.llm.store import let_workers_import

ORDER = 4
TRAIN_ROWS = 300  # documents for each language, at most
TRAIN_BYTES = 1 << 16  # of one of them, at most
SLICES = 16  # of a longer one, spread over its whole length
SEGMENT = 1 << 17  # bytes scored at once
BATCH_ROWS = 500
UNDETERMINED = "und"
PAD = b"\n"  # stands before a text as often as the order


class Table:
    """Unsigned keys to row numbers, as an open-addressing hash table for whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys.astype(np.uint64), np.uint64(0xFFFFFFFFFFFFFFFF))
        n = len(keys)
        self.shift = np.uint64(64 - max(4, int(4 * n + 1).bit_length()))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.slots = np.full(self.mask + 1, n, np.int32)
        todo = np.arange(n, dtype=np.int32)
        at = self._hash(self.keys[:n])
        while len(todo):
            free = self.slots[at] == n
            self.slots[at[free]] = todo[free]  # of several for one slot the last stays
            left = self.slots[at] != todo
            todo, at = todo[left], (at[left] + 1) & self.mask

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or the number of rows where there is none."""
        none = len(self.keys) - 1
        at = self._hash(keys)
        row = self.slots[at]
        wrong = np.flatnonzero((self.keys[row] != keys) & (row != none))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            row[wrong] = self.slots[at[wrong]]
            wrong = wrong[(self.keys[row[wrong]] != keys[wrong]) & (row[wrong] != none)]
        return row


def folded(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """The n bytes that end at each position from n - 1 on, as numbers."""
    out = np.zeros(max(0, len(data) - n + 1), np.uint64)
    for i in range(n):
        out = (out << np.uint64(8)) | data[i : len(data) - n + 1 + i]
    return out


class Model:
    """Frozen context trees of several languages; ``counts`` maps (language number, gram) to occurrences."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, count: np.ndarray, order: int = ORDER):
        self.langs, self.order = langs, order
        k = len(langs)
        self.lengths: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        self.grams: list[Table] = []
        self.contexts: list[Table] = []
        below_keys, below = np.arange(256, dtype=np.uint64), np.full((256, k), 8.0)  # order -1: uniform
        for o in range(order + 1):
            keys, at = np.unique(gram & np.uint64((1 << (8 * (o + 1))) - 1), return_inverse=True)
            seen = np.zeros((len(keys), k))
            np.add.at(seen, (at, lang), count)
            contexts, where = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), k)), np.zeros((len(contexts), k))
            np.add.at(total, where, seen)
            np.add.at(kinds, where, seen > 0)
            whole = np.maximum(total + kinds, 1)
            escape = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / whole), 0.0)
            shorter = below[np.searchsorted(below_keys, keys & np.uint64((1 << (8 * max(o, 1))) - 1))]
            length = np.where(seen > 0, -np.log2(np.maximum(seen, 1) / whole[where]), escape[where] + shorter)
            self.grams.append(Table(keys))
            self.contexts.append(Table(contexts))
            self.lengths.append(np.vstack([length, np.zeros((1, k))]).astype(np.float32))
            self.escapes.append(np.vstack([escape, np.zeros((1, k))]).astype(np.float32))
            below_keys, below = keys, length

    def _cost(self, data: np.ndarray) -> np.ndarray:
        """Code lengths for each byte from the ORDER-th on, and language."""
        o = self.order
        key = grams(data, o + 1)
        row = self.grams[o].find(key)
        cost = self.lengths[o][row]
        todo = np.flatnonzero(row == len(self.grams[o].keys) - 1)
        while len(todo) and o >= 0:
            cost[todo] += self.escapes[o][self.contexts[o].find(key[todo] >> np.uint64(8))]
            key[todo] &= np.uint64((1 << (8 * o)) - 1) if o else np.uint64(255)
            o -= 1
            if o < 0:
                cost[todo] += 8.0
                break
            row = self.grams[o].find(key[todo])
            cost[todo] += self.lengths[o][row]
            todo = todo[row == len(self.grams[o].keys) - 1]
        return cost

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Bits that each text takes in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        i = 0
        while i < len(texts):
            group, size = [], 0
            while i < len(texts) and (not group or size + len(texts[i]) <= SEGMENT):
                group.append(i)
                size += len(texts[i])
                i += 1
            if len(group) == 1:
                whole = PAD * self.order + texts[group[0]]
                for a in range(0, size, SEGMENT):
                    cost = self._cost(np.frombuffer(whole[a : a + SEGMENT + self.order], np.uint8))
                    out[group[0]] += cost.sum(0, dtype=np.float64)
                continue
            cost = self._cost(np.frombuffer(b"".join(PAD * self.order + texts[j] for j in group), np.uint8))
            # a text's bytes begin where its padding ends; the padding's own cost is left out
            starts = np.cumsum([0] + [len(texts[j]) + self.order for j in group[:-1]])
            total = np.vstack([np.zeros((1, len(self.langs))), np.cumsum(cost, 0, dtype=np.float64)])
            for j, s in zip(group, starts, strict=True):
                out[j] = total[s + len(texts[j])] - total[s]
        return out


def slices(padded: bytes, order: int) -> list[bytes]:
    """A padded text, or SLICES parts of a long one from its start to its end, each with the context of its first byte."""
    size, width = len(padded) - order, TRAIN_BYTES // SLICES
    if size <= TRAIN_BYTES:
        return [padded]
    return [padded[a : a + order + width] for a in ((size - width) * i // (SLICES - 1) for i in range(SLICES))]


def fit(labelled: DataFrame, order: int = ORDER, rows: int = TRAIN_ROWS) -> Model:
    """Trees from at most ``rows`` documents of each language, those of the smallest hash of doc_id.

    ``labelled`` has doc_id, text and lang. Rows without label, id or letters are not counted among them; of a text of more
    than TRAIN_BYTES, SLICES slices train, spread over its whole length and that long together. Grams are counted by Spark; their number is bounded by the sample's bytes.
    """
    let_workers_import(labelled.sparkSession)
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = labelled.where("lang is not null and doc_id is not null").where(has_letter(F.col("text"))).select("doc_id", "lang")
    chosen = chosen.withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= rows).select("doc_id", F.col("lang").alias("__l"))
    sample = labelled.join(F.broadcast(chosen.distinct()), "doc_id").where(F.col("lang") == F.col("__l"))
    sample = sample.where(has_letter(F.col("text"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = [grams(np.frombuffer(p, np.uint8), order + 1) for p in slices(PAD * order + folded(text), order)]
                key, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(key)), pa.array(key.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"]
                )

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = counts.column("lang").to_pylist()
    langs = sorted(set(names))
    number = {x: i for i, x in enumerate(langs)}
    return Model(
        langs, np.array([number[x] for x in names], np.int64), counts.column("gram").to_numpy().astype(np.uint64),
        counts.column("n").to_numpy(), order,
    )


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


_models: dict[str, Model] = {}


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all, if not given) with lang_pred, score (0 to 1) and bits_per_byte.

    A null text, one without a letter, and any text if the model knows no language, is ``und`` with score 0. The score is
    the best language's share of the probability that all the models give the text. Only ``text`` is read to predict.
    """
    spark = docs.sparkSession
    let_workers_import(spark)
    docs = docs.drop("lang_pred", "score", "bits_per_byte", "__letter")
    keep = [c for c in (keep or docs.columns)]
    sent, tag = spark.sparkContext.broadcast(pickle.dumps(model)), uuid.uuid4().hex
    own = keep.index("text") if "text" in keep else None  # then the text is not sent twice
    letter = has_letter(F.col("text")) if own is not None else F.when(has_letter(F.col("text")), F.col("text"))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], letter.alias("__letter"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tag not in _models:
            _models.clear()
            _models[tag] = pickle.loads(sent.value)
        m = _models[tag]
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                texts = batch.column(len(keep)).to_pylist()
                if own is not None:
                    texts = [t if k else None for k, t in zip(texts, batch.column(own).to_pylist(), strict=True)]
                texts = [folded(t) if t else b"" for t in texts]
                bits = m.score(texts) if m.langs else np.zeros((len(texts), 1))
                best = bits.argmin(1)
                share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                size = np.array([len(t) for t in texts], float)
                known = (size > 0) & bool(m.langs)
                names = [m.langs[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
                rate = np.where(known, bits.min(1) / np.maximum(size, 1), 0.0)
                new = [pa.array(names, pa.string()), pa.array(np.where(known, share, 0.0)), pa.array(rate)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], [*keep, "lang_pred", "score", "bits_per_byte"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(label, f"{fields}, lang_pred string, score double, bits_per_byte double")


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~is_held_out(F.col("doc_id"))))
    found = predict(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")
