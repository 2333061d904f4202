"""Operator 7: exact top-k inner products from an impact-ordered, score-at-a-time index.

Components are quantised to floor(256 x). Rows are dealt into blocks of about ``ROW_BYTES``, each of which becomes an index: every dimension is
centred on its mean in the block, the distances from it are cut into ``LEVELS`` levels, and the rows of a level form a
posting segment with the least and the greatest distance in it. A segment's impact for a query is the
greatest size of what it can add to a score. Queries process the segments of all dimensions by descending impact. After each
share of ``ROUNDS`` every row has an upper bound: the most that its processed postings add, and for each other
dimension the most that is still to come there. The 4 k rows with the highest bounds are scored exactly; rows whose upper bound is under
the k-th best of these scores are proven out. A query stops as soon as no more than ``FEW`` of the rows (or 4 k) are possible members, else when all
segments are processed; the possible members, and nobody else, are rescored exactly. Equal bounds stay in, so ties are decided on exact scores and ids.

Queries are dealt into blocks of about ``QUERY_BYTES`` and meet the blocks of rows in a cogroup, so neither reaches the
driver and a task holds one block of either. A task gives k rows for each query; those of all tasks are ranked by a window.

Null vectors and those holding null or non-finite components take no part, nor do rows without an
id. Only vectors of one length meet. Rows with the query's id are its own and no candidates; a row
that is repeated exactly counts once. Components must stay under 2**27 in size, so that sums are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

LEVELS, TOP = 64, 5
ROW_BYTES, QUERY_BYTES = 4 << 20, 4 << 20
#: Shares of a block's postings after which the proof is tried.
ROUNDS = (7 / 16, 9 / 16, 3 / 4, 1)
#: Share of a block's rows that is cheaper to rescore than to go on.
FEW = 1 / 8


class Index:
    """One block of rows of one length; ``rescored`` counts the rows whose exact score was needed."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows, self.rescored = ids, rows, 0
        exact = not rows.size or np.abs(rows).max() < 1 << 22  # then sums of products are exact in doubles
        self.exact = np.ascontiguousarray(rows, np.float64) if exact else None
        n, d = rows.shape
        self.centre = np.rint(rows.mean(0)).astype(np.int64) if n else np.zeros(d, np.int64)
        far = rows - self.centre
        low, high = far.min(0, initial=0), far.max(0, initial=0)
        level = (far - low) * LEVELS // (high - low + 1) + np.arange(d) * LEVELS
        order = np.argsort(level.ravel(), kind="stable")
        self.count = np.bincount(level.ravel(), minlength=d * LEVELS)
        self.posted = (order // max(d, 1)).astype(np.int32)  # rows of all segments, end to end
        self.least, self.most = np.zeros(d * LEVELS), np.zeros(d * LEVELS)
        full = np.flatnonzero(self.count)
        if len(full):
            begins = (np.cumsum(self.count) - self.count)[full]
            self.least[full], self.most[full] = np.minimum.reduceat(far.ravel()[order], begins), np.maximum.reduceat(far.ravel()[order], begins)

    def possible(self, query: np.ndarray, own: int, k: int) -> np.ndarray:
        """Positions of the rows that processed segments do not prove out."""
        n, d = self.rows.shape
        alive = self.ids != own
        if n <= 4 * k:
            return np.flatnonzero(alive)
        weight = np.repeat(query.astype(np.float64), LEVELS)
        ends = weight * self.least, weight * self.most
        most = np.maximum(*ends)
        segments = np.argsort(-np.maximum(-np.minimum(*ends), most), kind="stable")
        segments = segments[self.count[segments] > 0]
        done = np.cumsum(self.count[segments])
        base = float(query @ self.centre)
        for share in ROUNDS:
            met = np.zeros(d * LEVELS, bool)
            met[segments[: int(np.searchsorted(done, share * n * d)) + 1]] = True
            to_come = np.where(~met & (self.count > 0), most, -np.inf).reshape(d, LEVELS).max(1)
            to_come[np.isneginf(to_come)] = 0  # all of the dimension is processed
            gain = np.repeat(most[met] - to_come[np.flatnonzero(met) // LEVELS], self.count[met])
            up = np.bincount(self.posted[np.repeat(met, self.count)], gain, n) + (base + to_come.sum())
            up += 1e-9 * np.abs(up).max()  # more than the sums' rounding
            up[~alive] = -np.inf
            first = np.argpartition(up, n - 4 * k)[n - 4 * k :]
            bar = np.sort(self.scores(first[alive[first]], query))[-k:]
            possible = up >= (bar[0] if len(bar) == k else -np.inf)
            if np.count_nonzero(possible) <= max(4 * k, FEW * n):
                break
        return np.flatnonzero(possible & alive)

    def scores(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        if self.exact is not None and (not len(query) or np.abs(query).max() < 1 << 22):
            return (self.exact[at] @ query.astype(np.float64)).astype(np.int64)
        return self.rows[at] @ query

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows; exact."""
        at = self.possible(query, own, k)
        self.rescored += len(at)
        score = self.scores(at, query)
        best = np.lexsort((self.ids[at], -score))[:k]
        return self.ids[at][best], score[best]


def quantised(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v): integer vectors of the rows that take part, each once."""
    x = F.transform(vector, lambda c: c.cast("double"))
    fit = F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return df.where(fit).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * 256)).alias("v"))


def _by_length(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length: (ids, matrix), exact repetitions dropped."""
    column = rows.column("v").combine_chunks()
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return {}
    ids, ends = rows.column("vec_id").to_numpy(), column.offsets.to_numpy()
    values, sizes, out = column.values.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(ends), {}
    for d in np.unique(sizes):
        mine = np.flatnonzero(sizes == d)
        matrix = np.concatenate([ids[mine][:, None], values[ends[mine][:, None] + np.arange(d)]], 1)
        matrix = np.unique(matrix, axis=0)
        out[int(d)] = matrix[:, 0], np.ascontiguousarray(matrix[:, 1:])
    return out


def top_k(df: DataFrame, queries: DataFrame, k: int = TOP, vec_id: str = "vec_id", vector: str = "embedding", row_bytes: int = ROW_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows; ties to the smaller id."""
    rows, asked = quantised(df, vec_id, vector).distinct(), quantised(queries, vec_id, vector).distinct()

    def blocks(of: DataFrame, size: int) -> int:
        return max(1, -(-8 * of.agg(F.coalesce(F.sum(F.size("v") + 2), F.lit(0)).alias("n")).first()["n"] // size))

    n_rows, n_asked = blocks(quantised(df, vec_id, vector), row_bytes), blocks(quantised(queries, vec_id, vector), query_bytes)
    block = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("vec_id", "v", block(n_rows).alias("r"), every(n_asked).alias("q"))
    right = asked.select("vec_id", "v", every(n_rows).alias("r"), block(n_asked).alias("q"))

    def search(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        made, asked = [(np.zeros(0, np.int64),) * 3], _by_length(theirs)
        for d, (ids, matrix) in _by_length(ours).items():
            if d in asked:
                index = Index(ids, matrix)
                for own, query in zip(*asked[d], strict=True):
                    found, score = index.search(query, int(own), k)
                    made.append((np.full(len(found), own, np.int64), found, score))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*made, strict=True)], names=["query_id", "vec_id", "score"])

    found = left.groupBy("r", "q").cogroup(right.groupBy("r", "q")).applyInArrow(search, "query_id long, vec_id long, score long")
    # vectors that differ under one id are one candidate for each score
    ranked = found.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE_SQL = f"""
with v as (select distinct vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
      from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= {TOP}"""
