"""Reads of an event log: functions from a DataFrame of events to a DataFrame.

Filters on sequence, stream, type and tenant come first, so they reach the scan. Archived events and
gap fillers are left out unless asked for.
"""

from __future__ import annotations

from dataclasses import dataclass
from threading import BoundedSemaphore

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TOMBSTONE


def visible(events: DataFrame, archived: bool = False) -> DataFrame:
    if "is_archived" in events.columns and not archived:
        events = events.where(~F.coalesce(F.col("is_archived"), F.lit(False)))
    return events.where(F.col("event_type") != TOMBSTONE)


def for_tenant(events: DataFrame, tenant: str | None) -> DataFrame:
    """One tenant's events; a stream id means another stream in another tenant."""
    return events if tenant is None else events.where(F.col("tenant_id") == tenant)


def numbered(events: DataFrame) -> DataFrame:
    """Events with ``version`` 1..n per stream, for logs that do not store it. Filter streams before."""
    if "version" in events.columns:
        return events
    return events.withColumn("version", F.row_number().over(Window.partitionBy("tenant_id", "stream_id").orderBy("sequence")).cast("long"))


def fetch_stream(events: DataFrame, stream_id, version: int = 0, timestamp=None, from_version: int = 0, tenant: str | None = None) -> DataFrame:
    """A stream by version; the bounds are inclusive and 0 or None means none. Unknown streams are empty."""
    one = numbered(visible(for_tenant(events, tenant).where(F.col("stream_id") == stream_id)))
    if version:
        one = one.where(F.col("version") <= version)
    if from_version:
        one = one.where(F.col("version") >= from_version)
    if timestamp is not None:
        one = one.where(F.col("timestamp") <= F.lit(timestamp))
    return one.orderBy("version")


def load_event(events: DataFrame, event_id, key: str = "id", event_type: str | None = None) -> DataFrame:
    """The event with an id, or no row; with a type, only if it has that type."""
    found = events.where(F.col(key) == event_id)
    return (found if event_type is None else found.where(F.col("event_type") == event_type)).limit(1)


def stream_state(events: DataFrame) -> DataFrame:
    """version, created, last_timestamp of every stream, and archived and aggregate type where the log has them."""
    aggs = [F.count("*").cast("long") if "version" not in events.columns else F.max("version")]
    made = [aggs[0].alias("version"), F.min("timestamp").alias("created"), F.max("timestamp").alias("last_timestamp")]
    if "is_archived" in events.columns:
        made.append(F.coalesce(F.bool_and("is_archived"), F.lit(False)).alias("is_archived"))
    if "aggregate_type" in events.columns:
        made.append(F.max("aggregate_type").alias("aggregate_type"))
    return events.groupBy("tenant_id", "stream_id").agg(*made)


@dataclass(frozen=True)
class EventQuery:
    event_type: str | None = None
    stream_id: object = None
    correlation_id: str | None = None
    causation_id: str | None = None
    user_name: str | None = None
    tenant_id: str | None = None
    page: int = 1
    size: int = 50

    def filter(self) -> Column:
        wanted = {k: getattr(self, k) for k in ("event_type", "stream_id", "correlation_id", "causation_id", "user_name", "tenant_id")}
        out = F.lit(True)
        for name, value in wanted.items():
            if value is not None:
                out &= F.col(name) == value
        return out


def query_events(events: DataFrame, query: EventQuery) -> tuple[DataFrame, DataFrame]:
    """(the page by sequence, a row with total_count). Pages start at 1."""
    found = events.where(query.filter())
    page = found.orderBy("sequence").offset((query.page - 1) * query.size).limit(query.size)
    return page, found.agg(F.count("*").alias("total_count"))


def recent_streams(events: DataFrame, count: int, tenant: str | None = None) -> DataFrame:
    """The streams updated last, newest first; ties by stream."""
    return stream_state(for_tenant(events, tenant)).orderBy(F.desc("last_timestamp"), "tenant_id", "stream_id").limit(count)


def stream_records(events: DataFrame, stream_id, tenant: str | None = None) -> DataFrame:
    """A stream as explorer rows, oldest first: the payload is one JSON text."""
    body = F.col("data") if "data" in events.columns else F.to_json(F.struct("value", "k"))
    one = fetch_stream(events, stream_id, tenant=tenant)
    return one.select("sequence", "version", "event_type", "timestamp", body.alias("data")).orderBy("version")


def stream_metadata(events: DataFrame, tag_col: str = "tags") -> DataFrame:
    """Per stream: version, created, updated and its distinct tags as sorted ``type=value`` texts."""
    tags = events.select("tenant_id", "stream_id", F.explode(tag_col).alias("t")).groupBy("tenant_id", "stream_id")
    tags = tags.agg(F.array_sort(F.collect_set(F.concat_ws("=", "t.tag_type", "t.value"))).alias("tags"))  # distinct tags of one stream
    return stream_state(events).join(tags, ["tenant_id", "stream_id"], "left")


def page(events: DataFrame, floor: int, high_water: int, batch: int = 500, types: list[str] | None = None, archived: bool = False) -> DataFrame:
    """The next ``batch`` events above ``floor`` and up to the mark, by sequence."""
    found = visible(events.where((F.col("sequence") > floor) & (F.col("sequence") <= high_water)), archived)
    return (found.where(F.col("event_type").isin(types)) if types else found).orderBy("sequence").limit(batch)


def page_ceiling(sequences: list[int], batch: int, high_water: int, floor: int = 0, skipped: int = 0, last_seen: int = 0) -> int:
    """Where a page ends: at its last event when full, else at the mark; a page that skips filled ends at the last row seen."""
    if len(sequences) + skipped < batch:
        return high_water
    if sequences:
        return max(sequences[-1], last_seen)
    return last_seen if last_seen > floor else high_water


def highest_sequence(events: DataFrame, tenant: str | None = None) -> DataFrame:
    return for_tenant(events, tenant).agg(F.max("sequence").alias("sequence"))


def floor_at_time(events: DataFrame, at, tenant: str | None = None) -> DataFrame:
    """The highest sequence below an instant; null when no event is."""
    return for_tenant(events, tenant).where(F.col("timestamp") < F.lit(at).cast("timestamp_ntz" if dict(events.dtypes)["timestamp"] == "timestamp_ntz" else "timestamp")).agg(F.max("sequence").alias("sequence"))


def load_many(documents: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Documents whose key is among ``ids``; each once however often it was asked for."""
    return documents.join(ids.select(key).distinct(), key, "left_semi")


def with_retry(load, attempts: int = 3, transient: tuple = (IOError, TimeoutError)):
    """Calls a loader again on transient errors; what Spark retries by task needs none of this."""
    for left in range(attempts - 1, -1, -1):
        try:
            return load()
        except transient:
            if not left:
                raise
    return None


class Throttled:
    """A loader that at most ``limit`` threads call at a time; others wait."""

    def __init__(self, load, limit: int = 4):
        self.load, self.free = load, BoundedSemaphore(limit)

    def __call__(self, *args, **named):
        with self.free:
            return self.load(*args, **named)
