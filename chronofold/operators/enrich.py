"""Enrichment: look up reference rows for events. Reference tables are made distinct by key first, and
Catalyst picks the join: it broadcasts a side only if its measured size is under the session's threshold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_of_each(entities: DataFrame, key: str) -> DataFrame:
    """One row for each key: of several the smallest, so a task that runs again picks the same one."""
    others = [c for c in entities.columns if c != key]
    if any(dict(entities.dtypes)[c].startswith("map") for c in others):
        return entities.dropDuplicates([key])  # maps have no order
    return entities.groupBy(key).agg(F.min(F.struct(*others)).alias("one__")).select(key, "one__.*") if others else entities.distinct()


def enrich(events: DataFrame, entities: DataFrame, event_key: Column, entity_key: str, columns: dict[str, str], types: tuple[str, ...] = ()) -> DataFrame:
    """``events`` with ``columns`` (new name: entity column); null for other types and where nothing matches."""
    refs = one_of_each(entities, entity_key).select(F.col(entity_key).alias("ref_key__"), *[F.col(c).alias(n) for n, c in columns.items()])
    key = F.when(F.col("event_type").isin(*types), event_key) if types else event_key
    return events.withColumn("key__", key).join(refs, F.col("key__") == F.col("ref_key__"), "left").drop("key__", "ref_key__")


def enrich_many(events: DataFrame, entities: DataFrame, ids: Column, entity_key: str, name: str, order: str = "sequence") -> DataFrame:
    """Adds ``name``: the entities of each event's distinct ids, as an array sorted by key."""
    place = [order, *(["ordinal"] if "ordinal" in events.columns and order != "ordinal" else [])]  # siblings of a fan-out share the sequence
    pairs = events.select(*place, F.explode(F.array_distinct(ids)).alias("ref_key__")).distinct()
    found = pairs.join(one_of_each(entities, entity_key), F.col("ref_key__") == F.col(entity_key)).groupBy(*place)
    found = found.agg(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in [entity_key, *[c for c in entities.columns if c != entity_key]]]))).alias(name))  # the ids of one event
    return events.join(found, place, "left").select(*events.columns, name)


def add_references(slices: DataFrame, entities: DataFrame, key: Column, entity_key: str, name: str) -> DataFrame:
    """Attaches a whole entity as a struct column, for the fold to read."""
    refs = one_of_each(entities, entity_key).select(F.col(entity_key).alias("ref_key__"), F.struct(*entities.columns).alias(name))
    return slices.withColumn("key__", key).join(refs, F.col("key__") == F.col("ref_key__"), "left").drop("key__", "ref_key__")


def peer_view(view: DataFrame, other: DataFrame, key: str | list[str]) -> DataFrame:
    """A read model joined with another of the same identity."""
    return view.join(other, key)


def enrich_by_query(events: DataFrame, callback: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A user's own join; not called for a statically empty batch."""
    return callback(events)


def replace_data(events: DataFrame, predicate: Column, data: Column, column: str = "data") -> DataFrame:
    """New payloads under the old envelope."""
    return events.withColumn(column, F.when(predicate, data).otherwise(F.col(column)))
