"""Tag queries: conditions as one boolean column, so each event matches once and no join is needed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Condition:
    tag_type: str
    value: str
    event_types: tuple[str, ...] = ()


class TagQuery:
    """OR of conditions. ``for_tag`` only names a tag; ``or_tag`` and ``and_events`` add conditions."""

    def __init__(self, conditions: tuple[Condition, ...] = (), current: tuple[str, str] | None = None):
        self.conditions, self.current = conditions, current

    def for_tag(self, tag_type: str, value) -> TagQuery:
        return TagQuery(self.conditions, (tag_type, str(value)))

    def or_tag(self, tag_type: str, value, *event_types: str) -> TagQuery:
        return TagQuery((*self.conditions, Condition(tag_type, str(value), event_types)), (tag_type, str(value)))

    def and_events(self, *event_types: str) -> TagQuery:
        """Narrows the current tag to event types, in place of its condition for all types."""
        if self.current is None:
            raise ValueError("name a tag first")
        bare = Condition(*self.current)
        return TagQuery((*[c for c in self.conditions if c != bare], Condition(*self.current, event_types)), self.current)

    def column(self, tags: str = "tags", event_type: str = "event_type") -> Column:
        if not self.conditions:
            raise ValueError("a tag query needs a condition")
        out = F.lit(False)
        for c in self.conditions:
            hit = has_tag(c.tag_type, c.value, tags)
            out |= hit & F.col(event_type).isin(*c.event_types) if c.event_types else hit
        return out

    def to_dict(self) -> dict:
        return {"conditions": [{"tag_type": c.tag_type, "value": c.value, "event_types": list(c.event_types)} for c in self.conditions]}

    @staticmethod
    def from_dict(spec: dict, known_types: set[str] | None = None) -> TagQuery:
        made = []
        for c in spec["conditions"]:
            if known_types is not None and (unknown := set(c.get("event_types", ())) - known_types):
                raise ValueError(f"unknown event types: {sorted(unknown)}")
            made.append(Condition(c["tag_type"], str(c["value"]), tuple(c.get("event_types", ()))))
        return TagQuery(tuple(made))


def has_tag(tag_type: str, value, tags: str = "tags") -> Column:
    return F.exists(F.coalesce(F.col(tags), F.array().cast("array<struct<tag_type:string,value:string>>")), lambda t: (t["tag_type"] == tag_type) & (t["value"] == str(value)))


def query_by_tags(events: DataFrame, query: TagQuery) -> DataFrame:
    """Events matching any condition, each once, by sequence."""
    return events.where(query.column()).orderBy("sequence")


def query_by_all_tags(events: DataFrame, tags: dict, tenant: str | None = None) -> DataFrame:
    """Events that carry all the tags given, by sequence."""
    found = events if tenant is None else events.where(F.col("tenant_id") == tenant)
    for tag_type, value in tags.items():
        found = found.where(has_tag(tag_type, value))
    return found.orderBy("sequence")


def events_exist(events: DataFrame, query: TagQuery) -> DataFrame:
    """One row: whether any event matches; the scan ends at the first."""
    return events.where(query.column()).limit(1).agg((F.count("*") > 0).alias("found"))


def assign_tag_where(events: DataFrame, predicate: Column, tag_type: str, value, registered: set[str] | None = None) -> DataFrame:
    """Adds a tag to the events a predicate picks; again changes nothing."""
    if registered is not None and tag_type not in registered:
        raise ValueError(f"tag type {tag_type} is not registered")
    tag = F.array(F.struct(F.lit(tag_type).alias("tag_type"), F.lit(str(value)).alias("value")))
    empty = F.array().cast("array<struct<tag_type:string,value:string>>")
    return events.withColumn("tags", F.when(predicate & ~has_tag(tag_type, value), F.concat(F.coalesce("tags", empty), tag)).otherwise(F.col("tags")))
