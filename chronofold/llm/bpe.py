"""Operator 2: byte-level BPE by monoid tree reduction.

A text is halved until a piece has at most ``leaf`` characters; pieces are encoded alone and
neighbours are joined. A join re-encodes only a window about the seam. The window grows on each
side until it meets an *anchor*: a space or line feed right after a letter or digit. The pattern has
no look-behind, a match holds white space only at its start or throughout, and no contraction holds
any, so a match starts at every anchor whatever stands around it. Tokens never cross matches, hence
the tokens left of the left anchor and right of the right anchor cannot change. Without an anchor
the window reaches the piece's end, which is the plain encoding. Join is associative and the empty
text is its unit, so any bracketing gives what one encoding of the whole text gives.

Nulls are empty texts: no ids, empty bytes. Every row is kept, repeated rows included.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, with_arrow

LEAF = 4096
VOCABULARY = "byte_bpe_50k.tiktoken"


class Codec:
    """Encoder and decoder for one rank file; built once per Python worker."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF):
        import tiktoken

        with open(path, "rb") as lines:  # a read-only vocabulary installed with the tokenizer package on every node
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.leaf = leaf
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        top = max(ranks.values()) + 1
        pieces = [b""] * top
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def plain(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        return self.core.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int32)

    def encode(self, text: str, low: int = 0, high: int | None = None) -> np.ndarray:
        high = len(text) if high is None else high
        if high - low <= self.leaf:
            return self.plain(text[low:high])
        middle = (low + high) // 2
        return self.join(text, low, middle, high, self.encode(text, low, middle), self.encode(text, middle, high))

    def join(self, text: str, low: int, seam: int, high: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        begin, end = self.anchor(text, seam, low, -1), self.anchor(text, seam, high, 1)
        if begin == end:
            return np.concatenate([left, right])
        drop, take = len(text[begin:seam].encode()), len(text[seam:end].encode())
        kept = len(left) - int(np.searchsorted(np.cumsum(self.size[left[::-1]]), drop, "left")) - (drop > 0)
        rest = int(np.searchsorted(np.cumsum(self.size[right]), take, "left")) + (take > 0)
        return np.concatenate([left[:kept], self.plain(text[begin:end]), right[rest:]])

    @staticmethod
    def anchor(text: str, seam: int, bound: int, step: int) -> int:
        """The anchor nearest to the seam on one side, in windows of doubling width, else the bound."""
        near, width = seam, 32
        while near != bound:
            far = max(bound, near - width) if step < 0 else min(bound, near + width)
            spots = range(near, far, -1) if step < 0 else range(near, far)
            for p in spots:
                if 0 < p < len(text) and text[p] in " \n" and text[p - 1].isalnum():
                    return p
            near, width = far, 2 * width
        return bound

    def decode(self, ids: np.ndarray) -> bytes:
        """Leaves are read off the rank table; halves are concatenated on the way up."""
        if len(ids) <= self.leaf:
            if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size)):
                raise ValueError("an id is outside the vocabulary")
            sizes = self.size[ids]
            ends = np.cumsum(sizes)
            spot = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begin[ids] - (ends - sizes), sizes)
            return self.bytes[spot].tobytes()
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(2)
def codec(vocabulary: str, leaf: int = LEAF) -> Codec:
    """``vocabulary``: a file name of the installed public tokenizers, or a path."""
    import public_tokenizers

    return Codec(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary), public_tokenizers.PATTERN, leaf)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """``df`` plus ``ids`` (array<int>, never null): the token ids of each whole text."""

    def run(batch: pa.RecordBatch) -> dict:
        use = codec(vocabulary, leaf)
        made = [use.encode(t or "") for t in batch.column(text).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(m) for m in made])]).astype(np.int32)
        return {ids: pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*made, np.zeros(0, np.int32)]).astype(np.int32)))}

    return with_arrow(df, run, f"`{ids}` array<int>")


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """``df`` plus ``out`` (binary): the bytes of the ids; null or empty ids give empty bytes."""

    def run(batch: pa.RecordBatch) -> dict:
        use, column = codec(vocabulary, leaf), batch.column(ids)
        values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        nulls = column.is_null().to_numpy(zero_copy_only=False)
        made = [b"" if nulls[i] else use.decode(values[ends[i] : ends[i + 1]]) for i in range(len(column))]
        return {out: pa.array(made, pa.binary())}

    return with_arrow(df, run, f"`{out}` binary")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode(encode(docs).drop("text"))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: ``docs`` plus ids, n_tokens and whether decoding gives the text back."""
    small_batches(spark)
    both = decode(encode(docs))
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return both.withColumns({"n_tokens": F.size("ids").cast("long"), "round_trip": same}).drop("decoded")
