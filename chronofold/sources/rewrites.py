"""Rewrites of a log as column expressions: masking, compacting, archiving, replacing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import COMPACTED


class Masking:
    """Rules by event type that compose; headers go only to events that some rule covers."""

    def __init__(self):
        self.rules: list[tuple[tuple[str, ...], Callable[[Column], Column]]] = []
        self.headers: dict[str, str] = {}
        self.scope: list[Column] = []
        self.tenant: str | None = None

    def rule(self, event_type: str | tuple[str, ...], mask: Callable[[Column], Column]) -> Masking:
        self.rules.append(((event_type,) if isinstance(event_type, str) else tuple(event_type), mask))
        return self

    def header(self, key: str, value: str) -> Masking:
        self.headers[key] = value
        return self

    def include(self, predicate: Column) -> Masking:
        """Adds events to the selection; without any, all are selected."""
        self.scope.append(predicate)
        return self

    def for_tenant(self, tenant: str) -> Masking:
        self.tenant = tenant
        return self

    def selected(self) -> Column:
        out = F.lit(not self.scope)
        for s in self.scope:
            out |= s
        return out & (F.col("tenant_id") == self.tenant) if self.tenant else out

    def apply(self, events: DataFrame) -> DataFrame:
        """Same rows and versions, with masked data."""
        picked, covered, data = self.selected(), F.lit(False), F.col("data")
        for types, mask in self.rules:
            hit = F.col("event_type").isin(*types)
            covered |= hit
            data = F.when(hit & picked, mask(data)).otherwise(data)
        made = {"data": data}
        if self.headers:
            extra = F.create_map(*[F.lit(x) for kv in self.headers.items() for x in kv])
            old = F.coalesce("headers", F.create_map().cast("map<string,string>"))
            made["headers"] = F.when(covered & picked, F.map_zip_with(old, extra, lambda k, a, b: F.coalesce(b, a))).otherwise(F.col("headers"))
        return events.withColumns(made)


def compact(events: DataFrame, version: int, fold: Callable[[DataFrame], DataFrame], stream: Column | None = None, keys: tuple[str, ...] = ("tenant_id", "stream_id")) -> DataFrame:
    """Streams with their events up to ``version`` (0: all) folded into one compaction event.

    It takes the place, version and sequence of the last folded event; later events stay. ``fold``
    maps the folded events to (keys, columns); those columns are added to the log. A stream for which it gives
    no row keeps its version all the same: its compaction event has nulls there.
    """
    keys = list(keys)
    mine = F.coalesce(stream, F.lit(False)) if stream is not None else F.lit(True)
    within = mine & (F.col("version") <= version) if version else mine
    prefix = events.where(within)
    last = prefix.groupBy(*keys).agg(F.max("version").alias("last__"))
    state = fold(prefix)
    added = [c for c in state.columns if c not in keys]
    ends = prefix.join(last, keys).where("version = last__").drop("last__").join(state, keys, "left").withColumn("event_type", F.lit(COMPACTED))
    rest = events.where(~within).withColumns({c: F.lit(None).cast(state.schema[c].dataType) for c in added})
    return rest.unionByName(ends.select(*rest.columns))


def archive(events: DataFrame, stream: Column) -> DataFrame:
    """Marks a stream's events archived; again, or for a missing stream, changes nothing."""
    return events.withColumn("is_archived", F.when(stream, True).otherwise(F.coalesce("is_archived", F.lit(False))))


def overwrite(events: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Replaces data and headers where ``changes`` (key, data, headers) has them."""
    new = changes.select(key, F.col("data").alias("data__"), F.col("headers").alias("headers__"))
    out = events.join(new, key, "left")
    return out.withColumns({"data": F.coalesce("data__", "data"), "headers": F.coalesce("headers__", "headers")}).drop("data__", "headers__").select(*events.columns)


def replace(events: DataFrame, sequence: int, event_type: str, data: str) -> DataFrame:
    """A new body at a sequence: identity and version stay, headers are emptied."""
    here = F.col("sequence") == sequence
    return events.withColumns({
        "event_type": F.when(here, event_type).otherwise(F.col("event_type")),
        "data": F.when(here, data).otherwise(F.col("data")),
        "headers": F.when(here, F.lit(None).cast("map<string,string>")).otherwise(F.col("headers")),
    })
