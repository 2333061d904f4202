"""Document queries, last-write-wins upserts and predicate deletes over read-model tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Query:
    """A chain of where, select, order, distinct, skip and take over a document table."""

    def __init__(self, df: DataFrame):
        self.df, self.orders = df, []

    def _next(self, df: DataFrame, orders: list[Column] | None = None) -> Query:
        out = Query(df)
        out.orders = self.orders if orders is None else orders
        return out

    def where(self, predicate: Column) -> Query:
        return self._next(self.df.where(predicate))

    def is_one_of(self, column: str, values: list) -> Query:
        return self._next(self.df.where(F.col(column).isin(list(values))))

    def select(self, *columns: str) -> Query:
        return self._next(self._ordered().select(*columns), [])

    def order_by(self, column: str, descending: bool = False) -> Query:
        return self._next(self.df, [F.desc(column) if descending else F.asc(column)])

    def then_by(self, column: str, descending: bool = False) -> Query:
        if not self.orders:
            raise ValueError("then_by needs order_by")
        return self._next(self.df, [*self.orders, F.desc(column) if descending else F.asc(column)])

    def _ordered(self) -> DataFrame:
        return self.df.orderBy(*self.orders) if self.orders else self.df

    def skip(self, n: int) -> Query:
        return self._next(self._ordered().offset(n), [])

    def take(self, n: int) -> Query:
        return self._next(self._ordered().limit(n), [])

    def distinct(self) -> Query:
        return self._next(self._ordered().distinct(), [])

    def frame(self) -> DataFrame:
        return self._ordered()

    def to_list(self) -> list:
        return self._ordered().collect()

    def first_or_default(self, predicate: Column | None = None):
        return (self if predicate is None else self.where(predicate))._ordered().first()

    def count(self, predicate: Column | None = None) -> int:
        return (self if predicate is None else self.where(predicate)).df.count()

    def any(self, predicate: Column | None = None) -> bool:
        return bool((self if predicate is None else self.where(predicate)).df.limit(1).count())


def latest_wins(writes: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """The last write of each key. ``max_by`` combines before the shuffle, so a hot key costs one row per task."""
    rest = [c for c in writes.columns if c not in keys]
    last = writes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("last__"))
    return last.select(*keys, *[F.col(f"last__.{c}").alias(c) for c in rest])


def upsert(documents: DataFrame, writes: DataFrame, key: str, order: str) -> DataFrame:
    """``documents`` after ``writes`` (same columns, plus ``order`` and optionally ``deleted``)."""
    last = latest_wins(writes, [key], F.col(order))
    kept = documents.join(last.select(key), key, "left_anti")
    if "deleted" in last.columns:
        last = last.where(~F.coalesce("deleted", F.lit(False)))
    return kept.unionByName(last.select(*documents.columns))


def delete_where(documents: DataFrame, predicate: Column) -> DataFrame:
    return documents.where(~F.coalesce(predicate, F.lit(False)))
