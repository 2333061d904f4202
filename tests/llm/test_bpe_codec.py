import random

import public_tokenizers
import pytest

from chronofold.llm.bpe import VOCABULARY, Codec


@pytest.mark.parametrize("leaf", [1, 3, 16, 64])
def test_tree_equals_one_encoding(leaf):
    codec = Codec(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, leaf)
    rng = random.Random(leaf)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "\t", "'", "'re", "r", "e", "1", "23", ".", "!!", "é", "漢", "😀", "\x1c", " ", "\r\n", "²"]
    for n in [0, 1, 2, 5, 17, 60, 200, 700]:
        for _ in range(12):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            ids = codec.encode(text)
            assert ids.tolist() == codec.core.encode_ordinary(text)
            assert codec.decode(ids).decode() == text
    for text in ["x" * 3000, " " * 2000, "ab'" * 900, "漢字" * 700]:
        assert codec.encode(text).tolist() == codec.core.encode_ordinary(text)


def test_unknown_id_is_refused():
    codec = Codec(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    with pytest.raises(ValueError):
        codec.decode(codec.plain("a").repeat(1) + 10_000_000)
