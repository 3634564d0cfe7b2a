"""Secret scans: fixed base patterns, and a character convolutional network over every other candidate in its context.

A candidate is a run of key-like characters with letters and digits, or a value assigned to a name. The network, in numpy,
reads the characters before, in and after it (of a long one in overlapping windows, of which the best counts). It is
trained on labelled findings of all documents: what the base patterns find, candidates that consist of words and short
numbers, and a secret or a look-alike planted in each document's own context. Any other candidate may be a secret that the
base does not know, so it has no label and trains nothing. Tasks train on shards of the findings and the driver averages
their weights after each round. Scores are calibrated on findings kept apart, counted by score, and each kind of candidate
gets the highest threshold that keeps the recall asked for in every family of planted secrets.
"""

from __future__ import annotations

import pickle
import random
import re
import string
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.llm.store import Scratch, let_workers_import

# Fixed base patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that are long enough

PLANTED = 2000  # planted secrets, and as many planted look-alikes, where a list of findings trains
APART = 5000  # planted secrets, and look-alikes, that calibrate there
LEAST_PLANTED = 20_000  # planted in a corpus: one in each document, more of them where documents are fewer
FOUND_APART, PLANTED_APART = 3, 6  # tenths of the findings, and of what is planted, that calibrate
SHARD_ROWS = 8192  # findings that a task trains on in a round
STEPS, BATCH, MOST_ROUNDS = 500, 128, 16  # of a shard in all rounds; findings of a step; rounds at most
SCORE_BINS = 50  # of one unit of a score (logit), in which held-apart findings are counted
RECALL = 0.98
BEFORE, INSIDE, TAIL, AFTER = 24, 44, 16, 12
WIDTH = BEFORE + INSIDE + AFTER
MOST_THRESHOLD, LEAST_FAMILY = 0.9, 25  # of any kind; findings from which a family has a say
RUN_CHARS, VALUE_CHARS = 12, 8
BATCH_ROWS = 500

_RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
_KEYLIKE = frozenset(string.ascii_letters + string.digits + "+/_.=-")
_DIGIT = re.compile(r"[0-9]")
_LONG, _HUMP = re.compile(r"[A-Za-z0-9+/_.=-]{20,}"), re.compile(r"[a-z][A-Z]")
_VALUE = re.compile(r"[A-Za-z_][\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{8,})")
#: Words of one case or capitalised, with a number of four digits at most, and numbers of eight, joined by marks: no secret.
_BENIGN = re.compile(r"(?:[/_.=+-]*(?:[A-Z]?[a-z]{1,14}[0-9]{0,4}|[A-Z]{1,8}|[0-9]{1,8}))(?:[/_.=+-]+(?:[A-Z]?[a-z]{1,14}[0-9]{0,4}|[A-Z]{1,8}|[0-9]{1,8}))*[/_.=+-]*")
KINDS = ("assign", "access", "hex", "cnn")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of runs of 12 or more with a letter and a digit, or of 20 or more in mixed case (0), and of other
    assigned values (1)."""
    out, at = [], 0
    while m := _DIGIT.search(text, at):
        end = _RUN.match(text, m.start()).end()
        start = m.start()
        while start > at and text[start - 1] in _KEYLIKE:
            start -= 1
        if end - start >= RUN_CHARS and re.search(r"[A-Za-z]", text[start:end]):
            out.append((start, end, 0))
        at = end
    out += [(*m.span(), 0) for m in _LONG.finditer(text) if not _DIGIT.search(m[0]) and len(_HUMP.findall(m[0])) >= 3]
    if ":" in text or "=" in text:
        taken = {s for s, _, _ in out}
        out += [(*m.span(1), 1) for m in _VALUE.finditer(text) if m.start(1) not in taken and not text.startswith("//", m.start(1))]
    return sorted(out)


def _codes() -> np.ndarray:
    """Character to code: printable ASCII by itself, then other white space, other letters, all else; 0 pads."""
    table = np.full(0x250, 98, np.int64)
    for i in range(0x250):
        c = chr(i)
        table[i] = i - 31 if 32 <= i < 127 else 96 if c.isspace() else 97 if c.isalpha() else 98
    return table


_CODES = _codes()
N_CODES = 99


def encode(windows: list[tuple[str, str, str]]) -> np.ndarray:
    """Codes of (before, inside, after); a long inside keeps its head and its tail, the rest is padding."""
    out = np.zeros((len(windows), WIDTH), np.int64)
    for i, (a, b, c) in enumerate(windows):
        b = b if len(b) <= INSIDE else b[: INSIDE - TAIL] + b[-TAIL:]
        for text, at in ((a[-BEFORE:], BEFORE - len(a[-BEFORE:])), (b, BEFORE), (c[:AFTER], BEFORE + INSIDE)):
            p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            out[i, at : at + len(p)] = np.where(p < len(_CODES), _CODES[np.minimum(p, len(_CODES) - 1)], 98)
    return out


def window_of(text: str, start: int, end: int) -> tuple[str, str, str]:
    return text[max(0, start - BEFORE) : start], text[start:end], text[end : end + AFTER]


def windows_of(text: str, start: int, end: int) -> Iterator[tuple[str, str, str]]:
    """What the network reads of a candidate: all of it, or head and tail and then overlapping windows over all of it."""
    yield window_of(text, start, end)
    if end - start > INSIDE:
        for a in [*range(start, end - INSIDE, INSIDE // 2), end - INSIDE]:
            yield window_of(text, a, a + INSIDE)


def _union(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What spans (by start) cover, as intervals that do not overlap."""
    out: list[tuple[int, int]] = []
    for _, s, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def uncovered(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that no base span touches, and the parts of others that base spans leave, if they are long enough."""
    out: dict[tuple[int, int], int] = {}
    cover = _union(base)
    ends = [e for _, e in cover]
    for start, end, kind in candidates(text):
        at, touched, parts = start, False, []
        i = bisect_right(ends, start)
        while i < len(cover) and cover[i][0] < end:
            touched = True
            parts.append((at, cover[i][0]))
            at, i = cover[i][1], i + 1
        for a, b in [*parts, (at, end)]:
            part = text[a:b]
            if a < b and (not touched or len(part) >= VALUE_CHARS and (kind == 1 or re.search("[0-9]", part) and re.search("[A-Za-z]", part))):
                out.setdefault((a, b), kind if not touched or len(part) >= RUN_CHARS else 1)
    return sorted((a, b, k) for (a, b), k in out.items())


def labelled(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, kind, label) of the candidates whose label is known: 1 if a base finding touches it, 0 if it is benign."""
    cover = _union(base_spans(text))
    ends = [e for _, e in cover]
    for a, b, kind in candidates(text):
        i = bisect_right(ends, a)
        if i < len(cover) and cover[i][0] < b:
            yield a, b, kind, 1
        elif kind == 0 and b - a <= WIDTH and _BENIGN.fullmatch(text, a, b):
            yield a, b, kind, 0


class CharCnn:
    """Embedding, one convolution of width 5, the greatest of each filter before and inside the candidate, one logit."""

    def __init__(self, seed: int = 1, dims: int = 10, filters: int = 24, span: int = 5):
        r = np.random.default_rng(seed)
        self.span = span
        self.w = {
            "embed": r.normal(0, 0.3, (N_CODES, dims)),
            "conv": r.normal(0, 1 / np.sqrt(span * dims), (span * dims, filters)),
            "bias": np.zeros(filters),
            "out": r.normal(0, 0.2, 2 * filters),
            "shift": np.zeros(1),
        }
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        self.a, self.b, self.thresholds = 1.0, 0.0, [0.5, 0.5]

    def _forward(self, codes: np.ndarray):
        x = self.w["embed"][codes] * (codes > 0)[..., None]
        n, width, d = x.shape
        cols = np.lib.stride_tricks.sliding_window_view(x, self.span, axis=1).transpose(0, 1, 3, 2).reshape(n, width - self.span + 1, -1)
        z = cols @ self.w["conv"] + self.w["bias"]
        cut = BEFORE - self.span + 1
        at = np.stack([z[:, :cut].argmax(1), z[:, cut:].argmax(1) + cut], 1)  # n, 2, filters
        top = np.maximum(np.take_along_axis(z, at.reshape(n, -1, z.shape[2]), 1), 0).reshape(n, -1)
        return cols, at, top, top @ self.w["out"] + self.w["shift"][0]

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(codes[i : i + 512])[3] for i in range(0, len(codes), 512)]) if len(codes) else np.zeros(0)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return self._calibrated(self.logits(codes))

    def _calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * z + self.b, -30, 30)))

    def state(self) -> np.ndarray:
        """Weights and moments in one row."""
        return np.concatenate([x.ravel() for k, w in self.w.items() for x in (w, *self.moments[k])])

    def put(self, state: np.ndarray) -> None:
        at = 0
        for k, w in self.w.items():
            size = w.size
            self.w[k], *own = (state[at + i * size : at + (i + 1) * size].reshape(w.shape).copy() for i in range(3))
            self.moments[k] = tuple(own)
            at += 3 * size

    def _gradients(self, codes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        cols, at, top, logit = self._forward(codes)
        n, f = len(y), self.w["bias"].size
        d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / n
        g = {"out": top.T @ d, "shift": np.array([d.sum()])}
        back = ((d[:, None] * self.w["out"]) * (top > 0)).reshape(n, 2, f)
        picked = cols[np.arange(n)[:, None, None], at]  # n, 2, f, span * dims
        g["conv"] = np.einsum("nkf,nkfs->sf", back, picked)
        g["bias"] = back.sum((0, 1))
        into = back[..., None] * self.w["conv"].T  # n, 2, f, span * dims
        dims = self.w["embed"].shape[1]
        g["embed"] = np.zeros_like(self.w["embed"])
        for s in range(self.span):
            where = np.take_along_axis(codes[:, None, :].repeat(2, 1), at + s, 2)
            np.add.at(g["embed"], where, into[..., s * dims : (s + 1) * dims])
        g["embed"][0] = 0
        return g

    def train(self, codes: np.ndarray, y: np.ndarray, rounds: int = MOST_ROUNDS, batch: int = BATCH, rate: float = 0.01, seed: int | list[int] = 2, t: int = 0) -> None:
        """Adam on shuffled batches. Its moments stay with the weights, so that training goes on after ``t`` steps."""
        r = np.random.default_rng(seed)
        for _ in range(rounds):
            for part in np.array_split(r.permutation(len(y)), max(1, len(y) // batch)):
                t += 1
                for k, g in self._gradients(codes[part], y[part]).items():
                    a, b = self.moments[k]
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    self.w[k] -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, codes: np.ndarray, y: np.ndarray, kind: np.ndarray, family: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling, then for each kind the highest threshold that finds ``recall`` of its secrets in every family."""
        self.calibrate_scores(self.logits(codes), y, kind, family, np.ones(len(y)), recall)

    def calibrate_scores(self, z: np.ndarray, y: np.ndarray, kind: np.ndarray, family: np.ndarray, n: np.ndarray, recall: float = RECALL) -> None:
        """``calibrate`` by scores before calibration, each of which stands for ``n`` findings."""
        yes, no = (n * y).sum(), (n * (1 - y)).sum()
        target = np.where(y > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
        a, b = 1.0, 0.0
        loss = lambda a, b: (n * (np.logaddexp(0, a * z + b) - target * (a * z + b))).sum()
        for _ in range(50):  # Newton's method on two parameters, steps halved until they gain
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w = n * np.maximum(p * (1 - p), 1e-6)
            grad = np.array([(n * (p - target) * z).sum(), (n * (p - target)).sum()])
            hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(hess, grad)
            while loss(a - step[0], b - step[1]) > loss(a, b) and np.abs(step).max() > 1e-9:
                step = step / 2
            a, b = a - step[0], b - step[1]
        self.a, self.b = float(a), float(b)
        p, self.thresholds = self._calibrated(z), [MOST_THRESHOLD] * 2
        for k in (0, 1):
            own = (y > 0) & (kind == k)
            for f in np.unique(family[own]):
                found = np.flatnonzero(own & (family == f))
                found = found[np.argsort(p[found], kind="stable")]
                up_to = np.cumsum(n[found])
                if up_to[-1] >= LEAST_FAMILY:
                    place = np.searchsorted(up_to, np.floor((1 - recall) * up_to[-1]), "right")
                    self.thresholds[k] = min(self.thresholds[k], float(p[found[place]]))


def planter(r: random.Random) -> Callable[[tuple[str, str], int], tuple[tuple[str, str, str], int, int, int]]:
    """A function of a context and a label that writes a secret (1) or a look-alike (0) there, and gives (window, kind,
    label, family); those assigned to a name are a family of their own."""
    some = lambda alphabet, a, b: "".join(r.choices(alphabet, k=r.randint(a, b)))
    alnum, low, digits, hexes = string.ascii_letters + string.digits, string.ascii_lowercase, string.digits, "0123456789abcdef"
    word = lambda: some(low, 3, 9)
    names = ["aws_secret_access_key", "client_secret", "auth", "bearer", "private_key", "passphrase", "pwd", "credential", "access_key", "signing_key", "db_pass"]
    plain = ["title", "name", "file", "path", "version", "date", "note", "ref", "city", "author", "page", "id", "host", "build"]
    secrets = [
        lambda: "ghp_" + some(alnum, 36, 36), lambda: "sk_live_" + some(alnum, 24, 32), lambda: "xoxb-" + some(digits, 11, 12) + "-" + some(alnum, 24, 24),
        lambda: "AIza" + some(alnum + "_-", 35, 35), lambda: "eyJ" + some(alnum, 20, 40) + "." + some(alnum, 30, 60), lambda: some(alnum + "+/", 38, 44),
        lambda: some(hexes, 32, 64), lambda: "AKIA" + some(string.ascii_uppercase + digits, 16, 16), lambda: some(alnum, 20, 32), lambda: "glpat-" + some(alnum, 20, 20),
    ]
    benign = [
        lambda: f"{word()}.{some(digits, 1, 3)}.{word()}.com", lambda: f"{some(digits, 4, 4)}-{some(digits, 2, 2)}-{some(digits, 2, 2)}T{some(digits, 2, 2)}",
        lambda: f"{word()}-{word()}-{some(digits, 2, 5)}", lambda: f"{word()}/{word()}/{word()}{some(digits, 1, 3)}.html", lambda: f"v{some(digits, 1, 2)}.{some(digits, 1, 2)}.{some(digits, 1, 2)}-{word()}",
        lambda: f"{word()}_{word()}_{some(digits, 1, 2)}", lambda: f"SKU-{some(digits, 5, 6)}-{some(string.ascii_uppercase, 1, 2)}", lambda: f"{word()}{word()}{some(digits, 1, 2)}",
        lambda: "".join(word().capitalize() for _ in range(r.randint(4, 6))),
    ]

    def plant(context: tuple[str, str], label: int) -> tuple[tuple[str, str, str], int, int, int]:
        (before, after), assigned = context, r.random() < 0.5
        family = r.randrange(len(secrets if label else benign))
        value = (secrets if label else benign)[family]()
        if label and assigned and r.random() < 0.3:
            family, value = len(secrets), some(alnum + "_-.", 8, 20)
        if not label and assigned and r.random() < 0.5:
            family, value = len(benign), "-".join(word() for _ in range(r.randint(2, 3)))
        if assigned:
            quote = r.choice(['"', "'", ""])
            before += r.choice(names if label else plain) + r.choice([" = ", "=", ": ", ":"]) + quote
            after = quote + after
        else:
            before += r.choice([" ", "\n", " key ", " Bearer "] if label else [" ", "\n", " see ", " at "])
        return (before[-BEFORE:], value, after[:AFTER]), int(not candidates(value)), label, 2 * family + assigned

    return plant


def planted(contexts: list[tuple[str, str]], n: int, seed: int = 3) -> list[tuple[tuple[str, str, str], int, int, int]]:
    """(window, kind, label, family) of n secrets and n look-alikes written into contexts of the corpus."""
    r = random.Random(seed)
    plant = planter(r)
    return [plant(r.choice(contexts) if contexts else ("", ""), int(i < n)) for i in range(2 * n)]


def trained(data: list[tuple[tuple[str, str, str], int, int]], contexts: list[tuple[str, str]]) -> CharCnn:
    """A network from labelled (window, kind, label) of a corpus, and from what is planted in ``contexts``."""
    found = [(*x, -1) for x in data]
    apart = np.random.default_rng(4).random(len(found)) < 0.3
    learn = [x for x, a in zip(found, apart, strict=True) if not a] + planted(contexts, PLANTED)
    held = [x for x, a in zip(found, apart, strict=True) if a] + planted(contexts, APART, 5)
    columns = lambda rows: (encode([x[0] for x in rows]), *(np.array([x[i] for x in rows]) for i in (2, 1, 3)))
    net = CharCnn()
    codes, y, _, _ = columns(learn)
    net.train(codes, y.astype(float))
    codes, y, kind, family = columns(held)
    net.calibrate(codes, y.astype(float), kind, family)
    return net


def training_findings(docs: DataFrame, plants: int) -> DataFrame:
    """Every labelled finding of ``docs`` (doc_id long, text) and ``plants`` planted in each text that is not empty: doc, at, kind, label,
    family (-1: not planted), apart (calibrates, does not train) and codes, what the network reads.

    What is planted and what is kept apart depends on ids alone.
    """
    let_workers_import(docs.sparkSession)

    def tenth(doc: int | None, at: int) -> int:
        return zlib.crc32(f"{doc}:{at}".encode()) % 10

    def of(doc: int | None, text: str) -> Iterator[tuple]:
        for a, b, kind, label in labelled(text):
            yield window_of(text, a, b), doc, a, kind, label, -1, tenth(doc, a) < FOUND_APART
        r = random.Random(f"{doc}")
        plant = planter(r)
        for i in range(1, plants + 1) if text else ():
            p, q = r.randrange(len(text)), r.randrange(len(text))
            window, kind, label, family = plant((text[p : p + BEFORE], text[q : q + AFTER]), r.randrange(2))
            yield window, doc, -i, kind, label, family, tenth(doc, -i) < PLANTED_APART

    types = pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()
    names = ["doc", "at", "kind", "label", "family", "apart", "codes"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            found = (x for doc, text in texts for x in of(doc, text or ""))
            while some := list(islice(found, 4096)):
                windows, *columns = zip(*some, strict=True)
                codes = [c.tobytes() for c in encode(windows).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), pa.array(codes, pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(rows, "doc long, at long, kind int, label int, family int, apart boolean, codes binary")


def _codes_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDTH).astype(np.int64)


def _shards(findings: DataFrame, n: int) -> DataFrame:
    """``findings`` in about n shards by hash, a row each: shard, codes and labels of its findings by id."""

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("doc", "at", "codes")])
        labels = bytes(rows.column("label").to_pylist())
        return pa.table({"shard": rows.column("shard")[:1], "codes": pa.array([b"".join(rows.column("codes").to_pylist())]), "labels": pa.array([labels])})

    shard = F.pmod(F.xxhash64("doc", "at"), F.lit(n)).cast("int")
    return findings.select("doc", "at", "label", "codes", shard.alias("shard")).groupBy("shard").applyInArrow(packed, "shard int, codes binary, labels binary")


def _one_round(shards: DataFrame, net: CharCnn, number: int, steps: int) -> np.ndarray:
    """The mean, by findings, of the states that one pass over each shard makes of that of ``net``, after ``steps`` steps."""
    start = net.state()

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = CharCnn()
        for batch in batches:
            for shard, codes, labels in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own.put(start)
                y = np.frombuffer(labels, np.uint8).astype(float)
                own.train(_codes_of(pa.array([codes])), y, rounds=1, seed=[number, shard], t=steps)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(y)], pa.int64()), pa.array([own.state().tobytes()])], ["shard", "n", "state"])

    got = sorted(shards.mapInArrow(passed, "shard int, n long, state binary").collect())
    return np.average([np.frombuffer(r.state) for r in got], 0, [r.n for r in got])


def _score_counts(findings: DataFrame, net: CharCnn) -> DataFrame:
    """kind, label, family, bin (of the score, lower end) and n, the findings there."""

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.floor(np.clip(net.logits(_codes_of(batch.column(3))), -40, 40) * SCORE_BINS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bins, pa.int32())], ["kind", "label", "family", "bin"])

    rows = findings.select("kind", "label", "family", "codes").mapInArrow(binned, "kind int, label int, family int, bin int")
    return rows.groupBy("kind", "label", "family", "bin").agg(F.count("*").alias("n"))


def fit(docs: DataFrame) -> CharCnn:
    """A network trained and calibrated on the labelled findings of all ``docs``.

    Findings are written once to scratch space, so each text is read twice: to count the texts and to find. A round is one
    job, whose tasks pass over a shard each; the driver holds a state of the network (54 KB) for each SHARD_ROWS findings, and
    then counts of scores by bin.
    """
    session = docs.sparkSession
    scratch = Scratch(session, "secrets")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = docs.where("text <> ''").count()
    if not texts:  # nothing to learn from but what is planted in no context
        docs, texts = session.createDataFrame([(0, " ")], docs.schema), 1
    findings = scratch.keep(training_findings(docs, -(-LEAST_PLANTED // texts)), "findings")
    learn = findings.where("not apart")
    n = learn.count()
    parts = max(1, round(n / SHARD_ROWS))
    shards = scratch.keep(_shards(learn, parts).repartition(parts), "shards")  # as many files, for as many tasks
    net, steps = CharCnn(), max(1, n // parts // BATCH)  # of a shard in a round
    for i in range(min(MOST_ROUNDS, -(-STEPS // steps))):
        net.put(_one_round(shards, net, i, i * steps))
    rows = _score_counts(findings.where("apart"), net).orderBy("kind", "label", "family", "bin").collect()
    kind, label, family, bins, counts = np.array(rows, np.int64).reshape(-1, 5).T
    net.calibrate_scores(bins / SCORE_BINS, label, kind, family, counts)
    scratch.clear()
    return net


_nets: dict[str, CharCnn] = {}


def findings(text: str, net: CharCnn) -> tuple[list, list]:
    """(base spans, spans the network adds with their scores) of one text."""
    base = base_spans(text)
    best: dict[tuple[int, int, int], float] = {}
    asked = ((c, w) for c in uncovered(text, base) for w in windows_of(text, *c[:2]))
    while some := list(islice(asked, 4096)):
        for (c, _), q in zip(some, net.probability(encode([w for _, w in some])), strict=True):
            best[c] = max(best.get(c, 0.0), float(q))
    return base, [(a, b, q) for (a, b, k), q in best.items() if q >= net.thresholds[k]]


def secrets_in(text: str | None, net: CharCnn) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of all findings in a text, by start, then kind."""
    base, more = findings(text, net) if text else ((), ())
    spans = [(k, a, b, 1.0) for k, a, b in base] + [("cnn", a, b, p) for a, b, p in more]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _loaded(sent: Broadcast, tag: str) -> CharCnn:
    if tag not in _nets:
        _nets.clear()
        _nets[tag] = pickle.loads(sent.value)
    return _nets[tag]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def find_secrets(docs: DataFrame, net: CharCnn, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all, if not given) with ``secrets``: kind, start, end, score, by start then kind.

    Spans are in code points, end exclusive. Base findings have score 1; the network (kind ``cnn``) judges the candidates
    that no base finding touches, and what base findings leave of the others. A null or empty text has none; repeated rows repeat their result.
    """
    let_workers_import(docs.sparkSession)
    docs = docs.drop("secrets")
    keep = keep or docs.columns
    sent, tag = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net)), uuid.uuid4().hex
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _loaded(sent, tag)
        for batch in _slices(batches):
            out = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in secrets_in(t, known)] for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, kind)], [*keep, "secrets"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    return rows.mapInArrow(scan, f"{fields}, secrets array<struct<kind:string,start:int,end:int,score:double>>")


MARK = "[SECRET]"


def redact_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with each run of overlapping spans replaced by MARK."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], MARK]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, net: CharCnn) -> DataFrame:
    """``docs`` with all secrets in ``text`` replaced by MARK; null and clean texts stay as they are."""
    let_workers_import(docs.sparkSession)
    sent, tag = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net)), uuid.uuid4().hex
    at = docs.columns.index("text")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _loaded(sent, tag)
        for batch in _slices(batches):
            texts = batch.column(at).to_pylist()
            spans = [[s[1:3] for s in secrets_in(t, known)] for t in texts]
            columns = list(batch.columns)
            columns[at] = pa.array([redact_text(t, s) if s else t for t, s in zip(texts, spans, strict=True)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(replace, docs.schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs, fit(docs), ["doc_id"])
    base = F.filter("secrets", lambda s: s["kind"] != "cnn")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
