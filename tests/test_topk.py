"""What a running top-k holds, and that it is the top-k of all rows."""

import numpy as np

from gritstone.functions.topk import SLACK, TopK


def test_little_is_held_and_nothing_is_lost():
    n, k, r = 400, 50, np.random.default_rng(3)
    best, seen, most = TopK(n, k), [], 0
    for b in range(20):
        scores = np.round(np.sort(r.normal(size=(n, 600)), 1), 2) + b * 0.01  # later rows are better, many are equal
        best.add(np.arange(n), scores, np.arange(b * 600, (b + 1) * 600), np.zeros(600, np.int32))
        seen.append(scores)
        most = max(most, best.size)
    assert most <= 2 * n * k + SLACK
    scores = np.concatenate(seen, 1)
    q, s, ids, _ = best.cut()
    for i in range(n):
        want = np.lexsort((np.arange(scores.shape[1]), -scores[i]))[:k]
        assert ids[q == i].tolist() == want.tolist() and s[q == i].tolist() == scores[i][want].tolist()


def test_embedder_counts_words_by_bucket():
    from gritstone.functions.models import bucket_of, hash_embedder

    found = hash_embedder(16)(["b a b", "", "...", "c"])
    want = np.zeros((4, 16))
    for i, words in enumerate(["bab", "", "", "c"]):
        for w in words:
            want[i, bucket_of(w, 16)] += 1
    n = np.sqrt((want * want).sum(1, keepdims=True))
    assert np.array_equal(found, want / np.where(n == 0, 1, n))
