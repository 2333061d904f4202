"""What the training-data operators share: table access, training splits, text buffers.

Arrow functions here run on executors and hold one Arrow batch of texts at a time.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..checkpoint import checkpointed as checkpointed


#: Bytes of an Arrow batch that are worked on at a time.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession, rows: int = 250) -> None:
    """Makes the session read and hand Python at most ``rows`` rows at a time, where whole rows of long texts go there and back."""
    for key, default in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"), ("spark.sql.parquet.columnarReaderBatchSize", "4096")):
        if int(spark.conf.get(key, default)) > rows:
            spark.conf.set(key, str(rows))


def trim() -> None:
    """Hands memory that a training has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's readers only (any Hadoop file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hold_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id's decimal text leaves ``remainder``; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def map_arrow(df: DataFrame, fn, schema: str | StructType) -> DataFrame:
    """Run ``fn(record_batch) -> record_batch | None`` on every batch, cast to ``schema``.

    Batches are cut into slices of about ``BATCH_BYTES`` (single rows may be larger), which bounds
    what a task holds. ``fn`` comes once per task, so a closure's tables are shared by its slices.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = schema if isinstance(schema, StructType) else _parse(schema)
    arrow = to_arrow_schema(struct)

    def run(batches):
        for whole in batches:
            step = max(1, int(whole.num_rows * BATCH_BYTES / max(1, whole.nbytes)))
            for at in range(0, whole.num_rows, step):
                if (out := fn(whole.slice(at, step))) is not None and out.num_rows:
                    yield pa.RecordBatch.from_arrays([out.column(n).cast(arrow.field(n).type) for n in arrow.names], schema=arrow)
                del out
            del whole
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, struct)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each made longer until ``df`` has no column of that name in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows by which a key counts as hot, at least; of hot keys there are at most HOT_KEYS.
HOT_ROWS, HOT_KEYS = 1000, 100_000


def skew_join(left: DataFrame, right: DataFrame, key: str, rows: str, added: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``left`` inner-joined with the columns ``added`` of ``right``, which has one row for each key.

    ``rows`` is ``right``'s column with the number of left rows of a key. Keys of more than ``hot_rows`` of them (and of more than
    their ``HOT_KEYS``-th part in all) are at most ``HOT_KEYS``: their rows of ``right`` are broadcast and
    their rows of ``left`` stay where they are; the others are shuffled. Null keys meet nothing.
    """
    total = right.agg(F.coalesce(F.sum(rows), F.lit(0)).alias("n")).first()["n"]
    hot = F.col(rows) > max(hot_rows, total // HOT_KEYS)
    flag, *names = fresh(left, "hot__", *(f"{c}__" for c in added))
    right = right.select(key, rows, *[F.col(c).alias(n) for c, n in zip(added, names, strict=True)])
    mark = F.broadcast(right.where(hot).select(key, *names, F.lit(True).alias(flag)))  # at most HOT_KEYS rows
    marked = left.join(mark, key, "left")
    cold = marked.where(F.col(flag).isNull()).select(*left.columns).join(right.where(~hot).drop(rows), key)
    out = marked.where(F.col(flag)).select(*left.columns, *names).unionByName(cold.select(*left.columns, *names))
    return out.withColumnsRenamed(dict(zip(names, added, strict=True)))


def _parse(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column: all texts end to end in UTF-8; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(offsets) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bytes that separate words: space and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), in place on uint64."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = _mix((LOWER.astype(np.uint64) + np.uint64(1)) * _GOLD)


#: Bytes that are hashed at a time.
BLOCK_BYTES = 1 << 18


def hash_words(data: np.ndarray, offsets: np.ndarray, lead: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, first word of each text and their end) for lower-cased words.

    Words are runs of bytes outside SPACE. A word's hash sums a random 64-bit value per byte
    times powers of an odd constant, taken relative to the word's start (prefix sums over the block,
    times the inverse power at the start), then mixes the sum with the length: the same bytes give the same hash wherever they stand. Works in blocks cut
    at white space, so memory beyond the result is bounded unless one word is longer. With ``lead``, only the first that many bytes of a word count.
    """
    starts, hashes, at, n = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0, len(data)
    while at < n:
        end = _cut(data, at, min(n, at + BLOCK_BYTES))
        low, high = np.searchsorted(offsets, [at, end])
        s, h = _hash_block(data[at:end], offsets[low:high] - at, lead)
        starts.append(s + at)
        hashes.append(h)
        at = end
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def _cut(data: np.ndarray, begin: int, end: int) -> int:
    """The last place up to ``end`` that follows white space, else the first after it."""
    if end == len(data):
        return end
    if len(spots := np.flatnonzero(SPACE[data[begin:end]])):
        return begin + int(spots[-1]) + 1
    rest = np.flatnonzero(SPACE[data[end:]])
    return end + int(rest[0]) + 1 if len(rest) else len(data)


def _hash_block(data: np.ndarray, breaks: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[breaks] = inside[breaks]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if lead:
        ends = np.minimum(ends, starts + lead)
    power, inverse = _powers(1 << max(18, n.bit_length()))
    sums = np.zeros(n + 1, np.uint64)  # prefix sums of byte values times powers of the place in the block
    np.take(_BYTE, data, out=sums[1:])
    sums[1:] *= power[:n]
    np.cumsum(sums, out=sums)
    return starts, _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _GOLD)


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers modulo 2**64 of an odd constant, and of its inverse."""
    out = []
    for base in (0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def fold_words(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbouring word hashes (len(words) - n + 1 of them)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = words[:m].copy()
    for k in range(1, n):
        h *= np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
        h += words[k : k + m]
    return _mix(h)


def with_arrow(df: DataFrame, fn, fields: str) -> DataFrame:
    """``df`` plus the columns ``fields`` (DDL) that ``fn(record_batch) -> {name: array}`` makes.

    Columns of ``df`` that bear one of those names, in any case, are replaced.
    """
    added = _parse(fields)
    names = {f.name.lower() for f in added.fields}
    keep = [f for f in df.schema.fields if f.name.lower() not in names]
    kept = [f.name for f in keep]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = fn(batch)
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *(made[f.name] for f in added.fields)], names=[*kept, *(f.name for f in added.fields)])

    return map_arrow(df, run, StructType([*keep, *added.fields]))
