"""Progress, lag and dead letters of projections."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def projection_lag(progress: DataFrame, marks: DataFrame, key: str = "tenant_id") -> DataFrame:
    """Progress rows against marks: has_row, lag = max(0, mark - sequence), caught_up (which needs a row)."""
    p = progress.groupBy(key).agg(F.max("sequence").alias("sequence"))
    out = marks.join(p, key, "left")
    behind = F.greatest(F.lit(0), F.col("high_water") - F.coalesce("sequence", F.lit(0)))
    has = F.col("sequence").isNotNull()
    return out.select(key, "sequence", "high_water", has.alias("has_row"), behind.alias("lag"), (has & (behind == 0)).alias("caught_up"))


def dead_letter_counts(letters: DataFrame) -> DataFrame:
    return letters.groupBy("projection", "tenant_id").agg(F.count("*").alias("n"))


def dead_letter_page(letters: DataFrame, offset: int = 0, limit: int = 50, tenant: str | None = None) -> DataFrame:
    """A shard's dead letters, latest sequence first."""
    found = letters if tenant is None else letters.where(F.col("tenant_id") == tenant)
    return found.orderBy(F.desc("event_sequence")).offset(offset).limit(limit)


def status(progress: DataFrame, registry: DataFrame, store_sequence: int) -> DataFrame:
    """Per projection: lifecycle and its shards with processed and store sequence."""
    shards = registry.join(progress, "shard", "left").withColumn("store_sequence", F.lit(store_sequence))
    shard = F.struct("shard", F.coalesce("state", F.lit("stopped")).alias("state"), F.coalesce("sequence", F.lit(0)).alias("sequence"), "store_sequence")
    return shards.groupBy("projection", "lifecycle").agg(F.array_sort(F.collect_list(shard)).alias("shards"))  # shards of one projection


@dataclass(frozen=True)
class ShardName:
    """``name[:Vn]:key[:tenant]``."""

    name: str
    key: str = "All"
    version: int = 1
    tenant: str | None = None

    def __str__(self) -> str:
        return ":".join([self.name, *([f"V{self.version}"] if self.version > 1 else []), self.key, *([self.tenant] if self.tenant else [])])

    @staticmethod
    def parse(text: str) -> ShardName:
        parts = text.split(":")
        version = 1
        if len(parts) > 2 and (m := re.fullmatch(r"V(\d+)", parts[1])):
            version = int(m[1])
            del parts[1]
        if not 2 <= len(parts) <= 3 or not all(parts):
            raise ValueError(f"not a shard name: {text}")
        return ShardName(parts[0], parts[1], version, parts[2] if len(parts) == 3 else None)


#: Failure categories by exception type name; the earliest sequence of several failures is reported.
CATEGORIES = {"ApplyEventError": "ApplyEvent", "SerializationError": "EventSerialization", "UnknownEventType": "UnknownEventType", "ProgressOutOfOrder": "ProgressionOutOfOrder"}


def failure_category(error: BaseException) -> str:
    while error is not None:
        if (name := type(error).__name__) in CATEGORIES:
            return CATEGORIES[name]
        error = error.__cause__
    return "Other"


class ProgressOutOfOrder(RuntimeError):
    """A batch's floor is not where the shard's progress ended."""


class SerializationError(ValueError):
    """A payload cannot be read."""


class UnknownEventType(KeyError):
    """An event type that nobody registered."""
