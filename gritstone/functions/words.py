"""Words of many texts at once, in numpy and Arrow buffers: no Python object is made for a word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Texts looked at together.
BLOCK = 2048
_ALNUM, _LETTER = 1, 2


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """For each code point whether it is a letter or number, and whether it is a letter."""
    chars = [chr(c) for c in range(0x110000)]
    alnum, letter = (np.fromiter((f(c) for c in chars), np.uint8, len(chars)) for f in (str.isalnum, str.isalpha))
    return alnum * _ALNUM + letter * _LETTER


def words(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """All words (runs of letters and numbers) of ``texts`` in order, their number in each text, and its letters."""
    texts = texts.cast(pa.string()).fill_null("")
    _, ends, held = texts.buffers()
    at = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held else np.zeros(0, np.uint8)
    at = at - at[0]
    first = (data & 0xC0) != 0x80  # of a character's bytes
    if data.size and data.max() > 127:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        kinds = _classes()[points][np.cumsum(first) - 1]
    else:
        kinds = _classes()[:128][data]
    inside = (kinds & _ALNUM) > 0
    after = np.concatenate([[False], inside[:-1]]) if data.size else inside
    after[at[:-1][at[:-1] < data.size]] = False  # a word ends with its text
    starts = np.flatnonzero(inside & ~after)
    # between two starts there are no bytes of other words, so without the bytes between words the starts are their bounds
    bounds = np.append(np.cumsum(inside)[starts] - 1, np.count_nonzero(inside)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data[inside]))
    letters = np.append(0, np.cumsum((kinds & _LETTER > 0) & first))[at]
    return found, np.diff(np.searchsorted(starts, at)), np.diff(letters)


def blocks(*columns: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    for at in range(0, len(columns[0]), BLOCK):
        yield tuple(c.slice(at, BLOCK) for c in columns)


def in_text_before(carried: pa.StringArray, found: pa.StringArray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of each text, and how many of them the text before has; ``carried`` are the words of the one before the first."""
    n = len(counts) + 1
    codes = pa.concat_arrays([carried, found]).dictionary_encode().indices.to_numpy().astype(np.int64)
    pairs = np.unique(codes * n + np.repeat(np.arange(n), [len(carried), *counts]))
    word, text = pairs // n, pairs % n
    again = (word[1:] == word[:-1]) & (text[1:] == text[:-1] + 1)
    return np.bincount(text, minlength=n)[1:], np.bincount(text[1:][again], minlength=n)[1:]
