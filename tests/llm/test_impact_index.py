"""The impact-ordered index proves nearly all rows out before any exact score is made, and never a member."""

import numpy as np
import pytest

from chronofold.llm.topk import Index


def kinds(rng):
    dense = rng.normal(size=(3000, 48)) * 32
    skewed = dense * np.exp(-np.arange(48) / 6)
    sparse = np.where(rng.random((3000, 48)) < 0.1, dense, 0)
    few = rng.integers(-2, 3, (3000, 6)).astype(float)  # many ties
    return {"dense": dense, "skewed": skewed, "sparse": sparse, "ties": few, "constant": np.ones((400, 4)), "huge": dense * 2**18}


@pytest.mark.parametrize("kind", ["dense", "skewed", "sparse", "ties", "constant", "huge"])
def test_search_equals_the_plain_product(kind):
    rows = np.floor(kinds(np.random.default_rng(1))[kind]).astype(np.int64)
    index, ids = Index(np.arange(len(rows)), rows), np.arange(len(rows))
    for q in range(0, len(rows), 100):
        found, score = index.search(rows[q], q, 5)
        plain = rows @ rows[q]
        plain[q] = -(10**18)
        best = np.lexsort((ids, -plain))[:5]
        assert found.tolist() == best.tolist() and score.tolist() == plain[best].tolist()
    share = index.rescored / (len(rows) / 100) / len(rows)
    assert share < {"dense": 0.15, "skewed": 0.15, "sparse": 0.15, "huge": 0.15}.get(kind, 1.1)


def test_small_blocks_rescore_all():
    rows = np.arange(24).reshape(12, 2)
    index = Index(np.arange(12), rows)
    assert index.search(np.array([1, 0]), 3, 5)[0].tolist() == [11, 10, 9, 8, 7] and index.rescored == 11
