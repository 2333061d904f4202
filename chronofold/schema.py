"""The event row, reserved event types, the type registry, and the adapter for the driver's tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DEFAULT_TENANT = "*DEFAULT*"
NIL_ID = "00000000-0000-0000-0000-000000000000"
#: Fixed value: the stream that gap fillers stand in.
TOMBSTONE_STREAM = "mt_tombstone"
#: Event types with a meaning of their own.
ARCHIVED, COMPACTED, TOMBSTONE, REFERENCES, UPDATED, DELETED = "archived", "compacted", "tombstone", "references", "updated", "projection_deleted"

#: One event. ``data`` is JSON; ``payload`` holds binary bodies of types that ask for it.
EVENT_DDL = (
    "id string, sequence long, version long, stream_id string, event_type string, schema_name string, data string, payload binary, "
    "timestamp timestamp, tenant_id string, causation_id string, correlation_id string, user_name string, headers map<string,string>, "
    "tags array<struct<tag_type:string,value:string>>, is_archived boolean, aggregate_type string, is_skipped boolean"
)


def alias(type_name: str, style: str = "plain", outer: str | None = None) -> str:
    """The event type alias of a class name: snake case; ``outer.inner`` for nested types."""
    words = re.sub(r"([a-z])([^a-z])", r"\1 \2", re.sub(r"([^a-z])([^a-z][a-z])", r"\1 \2", type_name.split("`")[0]))
    made = words.lower().replace(" ", "_")
    return f"{alias(outer)}.{made}" if style == "nested" and outer else made


def versioned(name: str, version: int) -> str:
    """The alias of a later schema of an event type: ``name_v2``."""
    return f"{name}_v{version}" if version > 1 else name


@dataclass
class EventType:
    alias: str
    schema: StructType
    bases: tuple[str, ...] = ()
    tags: dict[str, str] = field(default_factory=dict)
    binary: bool = False


class EventTypeRegistry:
    """Aliases, payload schemas, base types and tag members of the event types in use."""

    def __init__(self):
        self.types: dict[str, EventType] = {}
        self.tag_types: dict[str, str] = {}

    def register(self, name: str, ddl: str, bases: tuple[str, ...] = (), tags: dict[str, str] | None = None, binary: bool = False) -> EventType:
        made = EventType(name, StructType.fromDDL(ddl), bases, tags or {}, binary)
        if (old := self.types.get(name)) and old != made:
            raise ValueError(f"event type {name} is registered already")
        self.types[name] = made
        return made

    def register_tag(self, tag_type: str, kind: str = "string") -> None:
        self.tag_types[tag_type] = kind

    def assignable(self, *names: str) -> list[str]:
        """The types named and all that derive from them; none given means all."""
        if not names:
            return []
        found, grown = set(names), True
        while grown:
            more = {t.alias for t in self.types.values() if found & set(t.bases)} - found
            found |= more
            grown = bool(more)
        return sorted(found)

    def depth(self, name: str) -> int:
        """How far a type is from its furthest base: derived types are dispatched before their bases."""
        return 1 + max((self.depth(b) for b in (self.types[name].bases if name in self.types else ())), default=-1)

    def parsed(self, events: DataFrame, name: str) -> DataFrame:
        """Events of one type (and derived ones) with ``data`` parsed by its schema."""
        return events.where(F.col("event_type").isin(self.assignable(name))).withColumn("data", F.from_json("data", self.types[name].schema))

    def inferred_tags(self, event_type: Column, data: Column) -> Column:
        """Tags that follow from payload members: one for each tag type with exactly one member."""
        made = []
        for t in self.types.values():
            for tag_type, path in t.tags.items():
                value = F.get_json_object(data, f"$.{path}")
                made.append(F.when((event_type == t.alias) & value.isNotNull(), F.struct(F.lit(tag_type).alias("tag_type"), value.alias("value"))))
        return F.array_compact(F.array(*made)) if made else F.array().cast("array<struct<tag_type:string,value:string>>")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adapted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as an event log, without versions: a projection that filters push through.

    sequence = event_id, stream = user_id, tenant from user_id, tags from type and props.k.
    """
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(
        F.col("event_id").alias("sequence"),
        F.col("user_id").alias("stream_id"),
        F.concat(F.lit("t"), F.pmod("user_id", F.lit(3)).cast("string")).alias("tenant_id"),
        "event_type",
        F.col("ts").alias("timestamp"),
        "value",
        k.cast("long").alias("k"),
        F.array(F.struct(F.lit("k").alias("tag_type"), k.alias("value")), F.struct(F.lit("type").alias("tag_type"), F.col("event_type").alias("value"))).alias("tags"),
    )
