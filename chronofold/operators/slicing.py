"""Slicing: which identities an event belongs to. The result has one row per (tenant, id, event, ordinal).

Order inside a slice is (sequence, ordinal): a parent has ordinal -1, its fan-out children 0, 1, ...
Source events are made distinct by (event_type, key) before anything is exploded, and siblings are
kept: collapsing children that share their parent's id is an accident that is not repeated here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT_TENANT, NIL_ID


def not_default(id_: Column) -> Column:
    """Null, zero, empty and nil identities are no identity."""
    text = id_.cast("string")
    return id_.isNotNull() & ~text.isin("", "0", NIL_ID)


@dataclass
class Rule:
    """Identities of some event types (none: of all): an array column."""

    types: tuple[str, ...]
    ids: Column


@dataclass
class FanOut:
    """Children of a parent type: an array column; ``make`` turns a child into replaced event columns."""

    parent: str
    children: Column
    child_type: str
    make: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    before_grouping: bool = False


class Slicer:
    """Identity rules, custom groupers and fan-outs; ``slice`` applies them to a log."""

    def __init__(self, tenancy: str = "per_tenant"):
        if tenancy not in ("per_tenant", "across", "rollup", "single"):
            raise ValueError(f"unknown tenancy {tenancy}")
        self.tenancy, self.rules, self.customs, self.fans = tenancy, [], [], []

    def identity(self, id_: Column, *types: str) -> Slicer:
        self.rules.append(Rule(types, F.array(id_.cast("string"))))
        return self

    def identities(self, ids: Column, *types: str) -> Slicer:
        """One event to many identities; types are required, as a rule on every event matches none."""
        if not types:
            raise ValueError("identities needs event types")
        self.rules.append(Rule(types, ids.cast("array<string>")))
        return self

    def custom(self, grouper: Callable[[DataFrame], DataFrame]) -> Slicer:
        """A function from events to events with a column ``slice_id``; it runs after the rules."""
        self.customs.append(grouper)
        return self

    def fan_out(self, parent: str, children: Column, child_type: str, make: dict | None = None, before_grouping: bool = False) -> Slicer:
        self.fans.append(FanOut(parent, children, child_type, make or {}, before_grouping))
        return self

    def validate(self) -> None:
        if not self.rules and not self.customs and self.tenancy != "rollup":
            raise ValueError("a multi-stream projection needs identity rules, a custom grouping or a tenant rollup")
        if self.rules and self.tenancy == "rollup":
            raise ValueError("a tenant rollup takes no identity rules")

    def slice(self, events: DataFrame, key: str = "id") -> DataFrame:
        self.validate()
        events = events.dropDuplicates(["event_type", key]) if key in events.columns else events
        events = events.withColumn("ordinal", F.lit(-1))
        for fan in self.fans:
            if fan.before_grouping:
                events = _fan(events, fan)
        tenant = {"across": F.lit(DEFAULT_TENANT), "single": F.lit(DEFAULT_TENANT)}.get(self.tenancy, F.col("tenant_id"))
        parts = []
        if self.tenancy == "rollup":
            parts.append(events.withColumn("slice_id", F.col("tenant_id")))
        if self.rules:
            none = F.array().cast("array<string>")
            found = [F.coalesce(F.when(F.col("event_type").isin(*r.types), r.ids) if r.types else r.ids, none) for r in self.rules]
            ids = F.array_distinct(F.filter(F.concat(*found), not_default))
            parts.append(events.withColumn("slice_id", F.explode(ids)))
        parts += [g(events) for g in self.customs]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        if len(parts) > 1:
            out = out.dropDuplicates(["tenant_id", "slice_id", "sequence", "ordinal"])
        out = out.where(not_default(F.col("slice_id"))).withColumn("slice_tenant", tenant)
        for fan in self.fans:
            if not fan.before_grouping:
                out = _fan(out, fan)
        return out


def _fan(events: DataFrame, fan: FanOut) -> DataFrame:
    """Parents stay; children follow them and copy their envelope."""
    kids = events.where(F.col("event_type") == fan.parent).select("*", F.posexplode(fan.children).alias("pos__", "child__"))
    made = {"event_type": F.lit(fan.child_type), "ordinal": F.col("pos__")} | {c: f(F.col("child__")) for c, f in fan.make.items()}
    if "tags" in events.columns and "tags" not in made:
        made["tags"] = F.lit(None).cast(events.schema["tags"].dataType)
    kids = kids.withColumns(made).drop("pos__", "child__")
    return events.unionByName(kids.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in events.schema.fields]))


def by_stream(events: DataFrame) -> DataFrame:
    """One slice for each stream, in arrival order."""
    return events.withColumns({"slice_id": F.col("stream_id").cast("string"), "slice_tenant": F.col("tenant_id"), "ordinal": F.lit(-1)})


def ungrouped(events: DataFrame) -> DataFrame:
    """All events in one nameless slice; aggregate it with partial sums only."""
    return events.withColumns({"slice_id": F.lit("*"), "slice_tenant": F.lit(DEFAULT_TENANT), "ordinal": F.lit(-1)})
