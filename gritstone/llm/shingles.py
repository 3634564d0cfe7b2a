"""Word shingles as 64-bit hashes, for whole batches of texts at once with numpy."""

from __future__ import annotations

import re

import numpy as np

SHINGLE = 5
BATCH_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GAP = re.compile(rb"[\x20\t-\r]")
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64 over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) <= n:
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n + 1, 1 << 16), b, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of A-Z lower-cased bytes; words are what stands between ASCII white space.

    A long text is read in segments that end at white space, so that what is held besides the hashes doesn't grow with it.
    """
    parts, at = [], 0
    while at < len(raw) or not parts:
        gap = _GAP.search(raw, at + BATCH_BYTES) if len(raw) - at > BATCH_BYTES else None
        end = gap.start() if gap else len(raw)
        hashes, starts = _segment_hashes(raw[at:end])
        parts.append((hashes, starts + at))
        at = end
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _segment_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(raw.lower(), np.uint8)
    gap = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _upto(len(data))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)))
    return mix((total[ends] - total[starts]) * down[starts]), starts


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A text of fewer than five words is one shingle of all its words; one without words (or null) has none.
    """
    out: list[np.ndarray] = []
    raws = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    i = 0
    while i < len(raws):
        j, size = i, 0
        while j < len(raws) and (j == i or size + len(raws[j]) < BATCH_BYTES):
            size += len(raws[j]) + 1
            j += 1
        hashes, starts = word_hashes(b"\n".join(raws[i:j]))
        begin = np.cumsum([0] + [len(r) + 1 for r in raws[i:j]])
        cut = np.searchsorted(starts, begin)
        n = len(hashes) - SHINGLE + 1
        runs = mix(sum(hashes[k : k + n] * _PLACE[k] for k in range(SHINGLE))) if n > 0 else np.zeros(0, np.uint64)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b - a >= SHINGLE:
                s = np.sort(runs[a : b - SHINGLE + 1])
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif b > a:
                whole = np.array([b - a], np.uint64)
                for k in range(a, b):
                    whole = mix(whole * _PLACE[0] + hashes[k : k + 1] * _PLACE[1])
                out.append(whole)
            else:
                out.append(np.zeros(0, np.uint64))
        i = j
    return out
