"""The kernel that ranks documents of a block: its bound and its terms of either kind against plain sums."""

import numpy as np
import pytest

from millrace.operators import retrieval


@pytest.mark.parametrize("k", [1, 5, 20])
@pytest.mark.parametrize("columns", [3, 64, 1000, 9491])
def test_bound_keeps_the_best_and_few_others(k, columns):
    random = np.random.default_rng(columns + k)
    scores = np.round(random.gamma(0.3, size=(40, columns)), 2)
    scores[:3], scores[3, 1:] = 0, 0
    kept = scores >= retrieval.least_of_best(scores, k)
    assert not (kept & (scores <= 0)).any()
    for row, own in zip(scores, kept):
        best = np.sort(row[row > 0])[::-1][:k]
        assert (np.sort(row[own])[::-1][: len(best)] == best).all()
    if columns > 4 * k * retrieval.GROUP:
        assert kept[4:].sum(axis=1).max() < 40 * k


def block(rows, item):
    terms, items = sorted({t for t, _, _ in rows}), sorted({i for _, i, _ in rows})
    return {
        "terms": terms, "items": np.array(items, np.int64).tobytes(), "term": np.array([terms.index(t) for t, _, _ in rows], np.int32).tobytes(),
        "at": np.array([items.index(i) for _, i, _ in rows], np.int32).tobytes(), "weight": np.array([float(w) for _, _, w in rows]).tobytes(),
    }


@pytest.mark.parametrize("cells", [1, 3_000, 1 << 23])
def test_terms_in_matrices_and_along_postings(monkeypatch, cells):
    """However few cells a matrix may have, the same sums; equal ones go to the smaller document."""
    monkeypatch.setattr(retrieval, "CELLS", cells)
    random = np.random.default_rng(5)
    postings = [(f"t{t}", 7 * d, int(random.integers(1, 4))) for d in range(1500) for t in random.choice(40, 4, replace=False)]
    queries = [(f"t{t}", q, int(random.integers(1, 3))) for q in range(30) for t in random.choice(45, 6, replace=False)]
    got = retrieval.block_top(block(queries, "query"), block(postings, "doc"), 5).to_pylist()
    weights = {(t, d): w for t, d, w in postings}
    for q in range(30):
        own = [(t, n) for t, i, n in queries if i == q]
        sums = sorted(((-sum(n * weights.get((t, 7 * d), 0) for t, n in own), 7 * d) for d in range(1500)))[:5]
        assert [(-r["score"], r["doc"]) for r in got if r["query"] == q] == [x for x in sums if x[0] < 0]


@pytest.mark.parametrize("sign", [1, -1])
def test_sums_that_single_precision_cannot_tell(sign):
    """Documents whose scores differ by less than single precision holds stand in the order of their exact sums."""
    postings = [(f"t{t}", d, 1000.0 + sign * (d % 50) * 1e-5) for d in range(800) for t in range(3)] + [("t3", d, 1e-6) for d in range(800, 900)]
    got = retrieval.block_top(block([(f"t{t}", q, 1) for q in range(2) for t in range(3)] + [("t3", 2, 1)], "query"), block(postings, "doc"), 20).to_pylist()
    best = sorted(range(800), key=lambda d: (-sign * (d % 50), d))[:20]
    assert [r["doc"] for r in got] == best * 2 + list(range(800, 820))
