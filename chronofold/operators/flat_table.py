"""Flat tables: relational columns kept by Map, Increment, Decrement, SetValue and Delete handlers.

Closed form: with ``ld`` an identity's last delete and ``lm`` the last map after it, a mapped column is its value
at ``lm`` plus signed increments after it; a set value is that of its last setter. The markers are
pre-aggregated per identity. An increment on a missing row, or after a delete, starts from 0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["slice_tenant", "slice_id"]


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


@dataclass
class FlatTable:
    maps: dict[str, dict[str, Column]] = field(default_factory=dict)
    steps: dict[str, dict[str, Column]] = field(default_factory=dict)
    values: dict[str, dict[str, object]] = field(default_factory=dict)
    deletes: tuple[str, ...] = ()

    def map(self, event_type: str, column: str, value: Column) -> FlatTable:
        self.maps.setdefault(snake(column), {})[event_type] = value
        return self

    def increment(self, event_type: str, column: str, by: Column | None = None) -> FlatTable:
        self.steps.setdefault(snake(column), {})[event_type] = F.lit(1) if by is None else by
        return self

    def decrement(self, event_type: str, column: str, by: Column | None = None) -> FlatTable:
        return self.increment(event_type, column, F.lit(-1) if by is None else -by)

    def set_value(self, event_type: str, column: str, value) -> FlatTable:
        self.values.setdefault(snake(column), {})[event_type] = value
        return self

    def delete(self, *event_types: str) -> FlatTable:
        self.deletes += event_types
        return self

    def types(self) -> set[str]:
        return {t for part in (self.maps, self.steps, self.values) for c in part.values() for t in c} | set(self.deletes)

    def run(self, slices: DataFrame, keys: list[str] = KEYS) -> DataFrame:
        rows, place = slices.where(F.col("event_type").isin(*self.types())), F.struct("sequence", "ordinal")
        if self.deletes:
            gone = rows.where(F.col("event_type").isin(*self.deletes)).groupBy(*keys).agg(F.max(place).alias("ld"))
            rows = rows.join(gone, keys, "left").where(F.col("ld").isNull() | (place > F.col("ld")))
        mapped = [c for c in self.maps if self.maps[c]]
        marks = rows.groupBy(*keys).agg(*[F.max(F.when(F.col("event_type").isin(*self.maps[c]), place)).alias(f"lm_{c}") for c in mapped], F.count("*").alias("n__"))
        rows = rows.join(marks, keys)
        aggs = []
        for c in {**self.maps, **self.steps, **self.values}:
            if c in self.values:
                pick = F.lit(None)
                for t, v in self.values[c].items():
                    pick = F.when(F.col("event_type") == t, F.lit(v)).otherwise(pick)
                aggs.append(F.max_by(pick, F.when(F.col("event_type").isin(*self.values[c]), place)).alias(c))
                continue
            mark = F.col(f"lm_{c}") if c in mapped else F.lit(None)
            at = F.coalesce(place == mark, F.lit(False)) if c in mapped else F.lit(False)
            after = mark.isNull() | (place > mark) if c in mapped else F.lit(True)
            gain = F.lit(None)
            for t, v in self.steps.get(c, {}).items():
                gain = F.when(after & (F.col("event_type") == t), v).otherwise(gain)
            if c in mapped and c not in self.steps:
                pick = F.lit(None)
                for t, v in self.maps[c].items():
                    pick = F.when(at & (F.col("event_type") == t), v).otherwise(pick)
                aggs.append(F.max(pick).alias(c))
                continue
            for t, v in self.maps.get(c, {}).items():
                gain = F.when(at & (F.col("event_type") == t), v).otherwise(gain)
            aggs.append(F.coalesce(F.sum(gain), F.lit(0)).alias(c))
        return rows.groupBy(*keys).agg(*aggs)
