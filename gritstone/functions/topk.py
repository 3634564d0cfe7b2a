"""What a task keeps of the scores it has seen: the best rows of each query, or sums by group. Numpy only."""

from __future__ import annotations

import numpy as np

PLACES = 6  # of a score
SLACK = 100_000  # rows that are held besides, so that few queries are not cut back at each block


class TopK:
    """The best ``k`` rows of each of ``n`` queries, of equal scores those with the smallest ids.

    Rows come in blocks. Of a block only scores count that reach a query's k-th best so far; what is held is cut back to
    ``k`` a query when it has grown to twice that and a block's share, so memory depends on n, k and the block alone. A score that is
    not a number counts for nothing.
    """

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.floor = np.full(n, -np.inf)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, parts: np.ndarray) -> None:
        """``scores`` has a row for each of ``queries`` (their numbers) and a column for each id."""
        floor = self.floor[queries]
        scores = np.where(np.isnan(scores), -np.inf, scores)
        if scores.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(scores, scores.shape[1] - self.k, 1)[:, scores.shape[1] - self.k])
        q, r = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
        if len(q):
            self.held.append((queries[q], scores[q, r], ids[r], parts[r]))
            self.size += len(q)
            if self.size > min(2 * self.n * self.k + SLACK, 4 * self.n * self.k + scores.size):
                self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        """(queries, scores, ids, parts) held, at most ``k`` of a query."""
        if not self.held:
            return (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
        q, s, ids, parts = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids, -s, q))
        ordered = q[order]
        place = np.arange(len(q)) - np.searchsorted(ordered, ordered)
        order, last = order[place < self.k], order[place == self.k - 1]
        self.floor[q[last]] = s[last]
        self.held = [(q[order], s[order], ids[order], parts[order])]
        self.size = len(order)
        return self.held[0]


class Stats:
    """Number, sum, least and greatest of scores by query and group; sums are of whole millionths, so their order is no matter."""

    def __init__(self):
        self.seen: dict = {}

    def add(self, queries: np.ndarray, scores: np.ndarray, groups: np.ndarray) -> None:
        names, at = np.unique(groups, return_inverse=True)
        order = np.argsort(at, kind="stable")
        first = np.searchsorted(at[order], np.arange(len(names)))
        s = scores[:, order]
        n = np.diff(np.append(first, len(order)))
        sums = np.add.reduceat(np.rint(s * 10**PLACES).astype(np.int64), first, 1)
        least, most = np.minimum.reduceat(s, first, 1), np.maximum.reduceat(s, first, 1)
        for i, g in enumerate(names.tolist()):
            own = self.seen.get(g)
            if own is None:
                own = self.seen[g] = [{}, {}, {}, {}]
            for k, q in enumerate(queries.tolist()):
                if q in own[0]:
                    own[0][q] += int(n[i])
                    own[1][q] += int(sums[k, i])
                    own[2][q], own[3][q] = min(own[2][q], least[k, i]), max(own[3][q], most[k, i])
                else:
                    own[0][q], own[1][q], own[2][q], own[3][q] = int(n[i]), int(sums[k, i]), least[k, i], most[k, i]

    def rows(self) -> list[tuple]:
        """(query, group, number, sum in millionths, least, greatest)."""
        return [(q, g, c[0][q], c[1][q], c[2][q], c[3][q]) for g, c in self.seen.items() for q in c[0]]
