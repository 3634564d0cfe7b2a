"""Sum-of-squares online packing of token sequences into windows of 4096.

Each task tokenises its documents and packs them as they come: full windows are cut off long documents, and what is left,
for most documents the whole, is placed in one window, at the fill level whose choice keeps the sum of squared counts of
partially filled windows smallest. The counts are a level array: a level is 1 / LEVELS of a window, and a document takes
whole levels, so a closed window has a few tokens of padding for each document in it. With so few levels windows close
soon, and few are open at a task's end. Nothing is shuffled: a task's windows hold its own rows, and a lost task packs
the same rows the same way again.

At the end of a task the windows still open are placed into each other by the same rule; what remains is joined and cut
at 4096, and the last rest into powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.llm.store import let_workers_import

WINDOW = 4096
LEVELS = 256  # of a window's filling
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS = 400_000  # words kept with their ids in each worker
BATCH_ROWS = 512
BATCH_WORDS = 512  # new words encoded at a time

#: Characters that split as the tokenizer splits them and fold alike one by one: those below U+0250 whose lower case is one
#: character below U+0250 too, without the separators U+001C to U+001F (no white space to the tokenizer), and some marks.
_FOLDING = "".join(c for c in map(chr, range(0x250)) if c not in "\x1c\x1d\x1e\x1f" and len(c.lower()) == 1 and c.lower() < "\u0250")
PLAIN = re.compile(f"[{re.escape(_FOLDING)}‐-‧]*")
SPLIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zA-ZªµºÀ-ÖØ-öø-ɏ]+|[0-9²³¹¼½¾]|[^\sa-zA-ZªµºÀ-ÖØ-öø-ɏ0-9²³¹¼½¾]+")


class WordTokenizer:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes, through a cache of words.

    The vocabulary splits a text into words before it merges letters, so a word's ids depend on the word alone. Texts
    with letters beyond U+024F or a special token's mark go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path, self.tokenizer, self.cache = path, Tokenizer.from_file(path), {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of each word, encoded as one text, which is cut where words end, or one by one where the count differs."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        at = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(at) != len(words) or at[-1] != 4 * len(ids):
            return self._ids(words)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        words: list[list[str] | None] = [None] * len(texts)
        odd = [i for i, t in enumerate(texts) if "<|" in t or not PLAIN.fullmatch(t)]
        for i in range(0, len(odd), 64):
            for k, ids in zip(odd[i : i + 64], self._ids([texts[k] for k in odd[i : i + 64]]), strict=True):
                out[k] = ids
        new: set[str] = set()
        for i, t in enumerate(texts):
            if out[i] is None:
                words[i] = SPLIT.findall(t.lower())
                new.update(words[i])
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        todo = list(new.difference(self.cache))
        for i in range(0, len(todo), BATCH_WORDS):
            self.cache.update(zip(todo[i : i + BATCH_WORDS], self.word_ids(todo[i : i + BATCH_WORDS]), strict=True))
        get = self.cache.__getitem__
        return [b"".join(map(get, w)) if x is None else x for x, w in zip(out, words, strict=True)]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class SumOfSquares:
    """Open windows by fill level; ``place`` returns the window a piece goes to.

    Putting a piece of n at level h turns one window at h into one at h + n, which changes the sum of squares by
    2 (count[h + n] - count[h]) + 2; a new window changes it by 2 count[n] + 1, and closing one at full by
    1 - 2 count[h].
    """

    def __init__(self, window: int = WINDOW):
        self.window, self.count = window, np.zeros(window + 1, np.int64)
        self.open: dict[int, list[int]] = {}

    def place(self, n: int, fresh: int) -> tuple[int, int]:
        """(window, level it had); ``fresh`` is the number that a new window gets."""
        c, w = self.count, self.window
        levels = np.flatnonzero(c[1 : w - n + 1]) + 1
        best, level = 2 * int(c[n]) + 1, 0
        if len(levels):
            to = levels + n
            change = np.where(to == w, 1 - 2 * c[levels], 2 * (c[to] - c[levels]) + 2)
            k = len(change) - 1 - int(np.argmin(change[::-1]))  # of equal ones the fullest
            if change[k] <= best:
                best, level = int(change[k]), int(levels[k])
        number = fresh
        if level:
            number = self.open[level].pop()
            c[level] -= 1
        if level + n < w:
            self.open.setdefault(level + n, []).append(number)
            c[level + n] += 1
        return number, level


def cut_rest(pieces: list[tuple], window: int = WINDOW) -> Iterator[list[tuple]]:
    """Pieces (row, start, length) laid end to end and cut into full windows, then powers of two."""
    left = sum(p[2] for p in pieces)
    todo = list(reversed(pieces))
    while left:
        room = window if left >= window else 1 << (left.bit_length() - 1)
        left, part = left - room, []
        while room:
            row, start, n = todo.pop()
            take = min(n, room)
            part.append((row, start, take))
            if take < n:
                todo.append((row, start + take, n - take))
            room -= take
        yield part


def pack_stream(lengths: Iterator[tuple[int, int]], window: int = WINDOW) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    """(sequence, [(row, start, length) ...], kind) from (row, tokens) pairs, each sequence once, when it is closed.

    The kind says how it came about: ``long`` (part of one document), ``levels`` (by sum of squares, pieces not cut) or
    ``rest`` (cut at the end).
    """
    unit = max(1, window // LEVELS) if window % LEVELS == 0 else 1  # tokens of a level
    full, fresh = window // unit, 0
    steps = lambda pieces: sum(-(-p[2] // unit) for p in pieces)
    levels, held = SumOfSquares(full), {}
    for row, n in lengths:
        start = 0
        while n - start >= window:
            yield fresh, [(row, start, window)], "long"
            fresh, start = fresh + 1, start + window
        if n > start:
            own = (row, start, n - start)
            number, level = levels.place(steps([own]), fresh)
            fresh += number == fresh and level == 0
            held.setdefault(number, []).append(own)
            if level + steps([own]) == full:
                yield number, held.pop(number), "levels"
    left, levels, held = sorted(((steps(x), k, x) for k, x in held.items()), reverse=True), SumOfSquares(full), {}
    for n, own, pieces in left:
        number, level = levels.place(n, own)
        held.setdefault(number, []).extend(pieces)
        if level + n == full:
            yield number, held.pop(number), "levels"
    for part in cut_rest([p for number in sorted(held) for p in held[number]], window):
        yield fresh, part, "rest"
        fresh += 1


PIECES = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, key: str = "doc_id") -> DataFrame:
    """One row for each piece: ``key``, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32 bytes).

    ``tokenizer`` is the path of a vocabulary file that every executor can read. A null text counts as empty: one piece
    that holds the end id alone. Repeated rows are packed each for itself; other columns of ``docs`` are not read.
    sequence_id numbers a task's windows from its partition number times 2^32.
    """
    let_workers_import(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, base = tokenizer_at(tokenizer), TaskContext.get().partitionId() << 32
        names: dict[int, object] = {}  # of rows with pieces not yet given out
        ids: dict[int, bytes] = {}
        missing: dict[int, int] = {}
        keys_type = None

        def lengths() -> Iterator[tuple[int, int]]:
            nonlocal keys_type
            row = 0
            for batch in batches:
                keys_type = batch.schema.field(0).type
                for at in range(0, batch.num_rows, BATCH_ROWS):
                    part = batch.slice(at, BATCH_ROWS)
                    texts = [t or "" for t in part.column(1).to_pylist()]
                    for k, tokens in zip(part.column(0).to_pylist(), encoder.encode(texts), strict=True):
                        names[row], ids[row] = k, tokens + end
                        missing[row] = n = len(tokens) // 4 + 1
                        yield row, n
                        row += 1

        out: list[tuple] = []
        size = 0

        def given() -> pa.RecordBatch:
            k, start, n, whole, seq, offset, data = zip(*out, strict=True)
            cols = [pa.array(k, keys_type), *(pa.array(x, pa.int64()) for x in (start, n, whole, seq, offset)), pa.array(data, pa.binary())]
            return pa.RecordBatch.from_arrays(cols, [key, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        whole: dict[int, int] = {}
        for number, pieces, _ in pack_stream(lengths(), window):
            offset = 0
            for row, start, n in pieces:
                total = whole.setdefault(row, len(ids[row]) // 4)
                out.append((names[row], start, n, total, base + number, offset, ids[row][4 * start : 4 * (start + n)]))
                offset, size, missing[row] = offset + n, size + n, missing[row] - n
                if not missing[row]:
                    for x in (names, ids, missing, whole):
                        del x[row]
            if size > 500_000:
                yield given()
                out, size = [], 0
        if out:
            yield given()

    return docs.select(key, "text").mapInArrow(pack, f"`{key}` {kind}, {PIECES}")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(pack_documents(docs, default_tokenizer()))
