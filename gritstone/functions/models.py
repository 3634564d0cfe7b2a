"""Model adapters: factories of embedders, rerankers and token counters, loaded once per Python worker.

The defaults need no weights: a feature-hashing embedder, a lexical reranker and a regular expression for tokens. They are
stand-ins, not equal to any trained model. A factory that loads one is registered in the driver under a name, which a
Config then carries; operators send the factory itself to their tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from gritstone.functions.words import blocks, words

HELD_WORDS = 1 << 17
_WORD = re.compile(r"[^\W_]+")
Embedder = Callable[[list[str]], np.ndarray]
Reranker = Callable[[list[str], list[str], np.ndarray], np.ndarray]


def bucket_of(token: str, dim: int) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:6], 16) % dim


class _Buckets(dict):
    """Buckets of words seen, forgotten when there are too many of them."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, token: str) -> int:
        if len(self) >= HELD_WORDS:
            self.clear()
        self[token] = found = bucket_of(token, self.dim)
        return found


def hash_embedder(dim: int) -> Embedder:
    """Counts of a text's lower-cased words by bucket of their hash, at length 1; zero for a text without words."""
    known = _Buckets(dim)

    def embed(texts: list[str]) -> np.ndarray:
        counts = [np.zeros((0, dim))]
        for (block,) in blocks(pa.array([t.lower() for t in texts], pa.string())):
            found, own, _ = words(block)
            coded = found.dictionary_encode()
            buckets = np.array([known[w] for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()], np.int64)
            cells = buckets[coded.indices.to_numpy()] + np.repeat(np.arange(len(block)) * dim, own)
            counts.append(np.bincount(cells, minlength=len(block) * dim).reshape(-1, dim))
        out = np.concatenate(counts)
        n = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(n == 0, 1, n)

    return embed


def lexical_reranker() -> Reranker:
    """Share of the query's words that the text holds, plus a thousandth of the vector score."""

    def score(queries: list[str], texts: list[str], vector_scores: np.ndarray) -> np.ndarray:
        out = []
        for q, t in zip(queries, texts, strict=True):
            words = set(_WORD.findall(q.lower()))
            out.append(len(words & set(_WORD.findall(t.lower()))) / len(words) if words else 0.0)
        return np.array(out) + 0.001 * vector_scores

    return score


TokenCounter = Callable[[list[str]], list[int]]


class FileTokens:
    """Counts tokens by a tokenizer's vocabulary file, and says where tokens start."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def __call__(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def starts(self, text: str) -> list[int]:
        return [a for a, _ in self.tokenizer.encode(text, add_special_tokens=False).offsets]


def file_token_counter(path: str) -> Callable[[], TokenCounter]:
    """A factory of counters by the tokenizer in ``path``, a vocabulary file that every executor can read."""

    def load() -> TokenCounter:
        return FileTokens(path)

    return load


EMBEDDERS: dict[str, Callable[[int], Embedder]] = {"hash": hash_embedder}
RERANKERS: dict[str, Callable[[], Reranker]] = {"lexical": lexical_reranker}
#: Besides ``regex``, which is a column expression.
TOKEN_COUNTERS: dict[str, Callable[[], TokenCounter]] = {}
_loaded: dict = {}


def loaded(factory: Callable, *args):
    """What ``factory`` makes of ``args``, once in each Python worker."""
    key = (getattr(factory, "__module__", ""), getattr(factory, "__qualname__", repr(factory)), hash(getattr(factory, "__code__", None)), _held(factory), args)
    if key not in _loaded:
        if len(_loaded) >= 8:
            _loaded.clear()
        _loaded[key] = factory(*args)
    return _loaded[key]


def _held(factory: Callable) -> str:
    """The values that a factory closes over, so that factories of one function for different files stay apart."""
    return repr([c.cell_contents for c in getattr(factory, "__closure__", None) or ()])
