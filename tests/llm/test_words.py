import random

import numpy as np
import pyarrow as pa
import pytest

from chronofold.llm import common


@pytest.mark.parametrize("block", [7, 50, 1 << 18])
def test_word_hashes_follow_the_words(monkeypatch, block):
    monkeypatch.setattr(common, "BLOCK_BYTES", block)
    rng, seen = random.Random(block), {}
    for _ in range(200):
        texts = ["".join(rng.choice(["a", "B", "é", " ", "\n", "\x0b", "x y", "\x1f", "zz"]) for _ in range(rng.randrange(30))) for _ in range(5)]
        hashes, first = common.hash_words(*common.text_bytes(pa.array([*texts, None])))
        for i, text in enumerate([*texts, ""]):
            words = text.encode().lower().split()
            assert first[i + 1] - first[i] == len(words)
            for word, h in zip(words, hashes[first[i] : first[i + 1]], strict=True):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_runs_of_words_are_hashed_in_order():
    words = np.array([1, 2, 3, 1, 2, 3, 4, 3, 2], np.uint64)
    runs = common.fold_words(words, 3)
    assert runs[0] == runs[3] and len(set(runs.tolist())) == 6
    assert len(common.fold_words(words[:2], 3)) == 0
