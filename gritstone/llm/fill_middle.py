"""Fill-in-the-middle transformation: texts cut at two places between words and put in another order.

A text is cut into units, each a word with the white space before it, or the white space at the end. Its UTF-8 bytes are
taken in fixed blocks; a Fenwick tree over the blocks holds how many units end and how many code points begin in each.
A descent by halving steps finds the block where a cut's unit ends, with the code points before it; the boundary itself
is found inside that block. So no list of a text's units is made, however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.llm.sql import BLANK
from gritstone.llm.store import let_workers_import

BLOCK = 4096  # bytes
SEED = 42
#: Marks of prefix, suffix and middle; a text that holds one stays as it is.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_SHARE, SPM_SHARE = 50, 80  # of 100: texts left plain, and of the others those with the suffix first

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _ends(data: np.ndarray, start: int, stop: int) -> np.ndarray:
    """For each byte from start to stop, whether a unit ends with it: a word's last byte, and the last byte of all."""
    blank = _SPACE[data[start : stop + 1]]
    if stop < len(data):
        return ~blank[:-1] & blank[1:]
    return np.append(~blank[:-1] & blank[1:], True)


def _starts(data: np.ndarray) -> np.ndarray:
    """Whether a code point starts with a byte."""
    return (data & 0xC0) != 0x80


class BlockTree:
    """Fenwick tree over a text's blocks, with sums of units and code points."""

    def __init__(self, data: bytes, block: int = BLOCK):
        self.data, self.block = np.frombuffer(data, np.uint8), block
        self.n = -(-len(data) // block)
        self.units, self.points = [0] * (self.n + 1), [0] * (self.n + 1)
        for i in range(self.n):
            a, b = i * block, min(len(data), (i + 1) * block)
            self._add(i + 1, int(np.count_nonzero(_ends(self.data, a, b))), int(np.count_nonzero(_starts(self.data[a:b]))))
        self.total = self._sum(self.units, self.n)

    def _add(self, i: int, units: int, points: int) -> None:
        while i <= self.n:
            self.units[i] += units
            self.points[i] += points
            i += i & -i

    @staticmethod
    def _sum(tree: list[int], i: int) -> int:
        s = 0
        while i:
            s += tree[i]
            i -= i & -i
        return s

    def cut(self, k: int) -> tuple[int, int]:
        """(bytes, code points) of the first ``k`` units."""
        if not k:
            return 0, 0
        at, points, left = 0, 0, k
        step = 1 << self.n.bit_length()
        while step:
            if at + step <= self.n and self.units[at + step] < left:
                at += step
                left -= self.units[at]
                points += self.points[at]
            step >>= 1
        a = at * self.block
        own = np.flatnonzero(_ends(self.data, a, min(len(self.data), a + self.block)))
        end = a + int(own[left - 1]) + 1
        return end, points + int(np.count_nonzero(_starts(self.data[a:end])))


def draws(key: object, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits from the SHA-256 of seed and key; a null key counts as no text."""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transformed(data: bytes, key: object, seed: int = SEED, block: int = BLOCK) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix and of middle, output) of a text as UTF-8."""
    tree = BlockTree(data, block)
    h1, h2, h3, h4 = draws(key, seed)
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    if not data or p in data or s in data or m in data or h3 % 100 >= PLAIN_SHARE:
        return tree.total, "plain", None, None, data
    first, second = sorted((h1 % (tree.total + 1), h2 % (tree.total + 1)))
    (a, chars_a), (b, chars_b) = tree.cut(first), tree.cut(second)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    spm = h4 % 100 < SPM_SHARE
    out = b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle))
    return tree.total, "spm" if spm else "psm", chars_a, chars_b - chars_a, out


_NEW = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def fill_in_middle(docs: DataFrame, keep: list[str] | None = None, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all, if not given) with n (units), form, prefix_chars, middle_chars and output.

    ``form`` is ``plain`` (the text as it is), ``psm`` or ``spm``; the code points of prefix and middle are null for plain
    texts. A null text counts as empty, which is plain. Choices depend on the key and the seed alone, so repeated rows
    repeat their result; a null key is one key. Ties do not arise. Columns of ``docs`` with a new column's name are
    replaced. Nothing is shuffled.
    """
    let_workers_import(docs.sparkSession)
    keep = [c for c in keep or docs.columns if c not in _NEW.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep) + 1).cast(pa.binary()).to_pylist()
            rows = [transformed(t or b"", k, seed) for k, t in zip(batch.column(len(keep)).to_pylist(), texts, strict=True)]
            new = [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _NEW, strict=True)] if rows else [pa.array([], f.type) for f in _NEW]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], [*keep, *_NEW.names])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").cast("string").alias("__text"))
    return rows.mapInArrow(run, f"{fields}n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``fill_in_middle`` was made from; marks are looked for in the output alone."""
    at = lambda mark: F.instr(output, mark)
    between = lambda a, b: F.substring(output, a, b - a)
    size, first = len(PREFIX), F.lit(len(PREFIX) + 1)
    middle = F.substring(output, at(MIDDLE) + size, F.length(output))
    psm = F.concat(between(first, at(SUFFIX)), middle, between(at(SUFFIX) + size, at(MIDDLE)))
    spm = F.concat(between(at(PREFIX) + size, at(MIDDLE)), middle, between(first, at(PREFIX)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = fill_in_middle(docs, ["doc_id"])
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '{BLANK.replace("[^", "[").replace("+", "*")}{BLANK}|{BLANK.replace("[^", "[")}') AS u,
  CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2, CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM t),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {PLAIN_SHARE} THEN 'plain'
    WHEN h4 % 100 < {SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('{PREFIX}', p, '{SUFFIX}', s, '{MIDDLE}', m) ELSE concat('{SUFFIX}', s, '{PREFIX}', p, '{MIDDLE}', m) END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
