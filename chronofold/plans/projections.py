"""Projections: builders that put filters, slicing, enrichment and folds together, and their registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import slicing
from ..operators.flat_table import FlatTable
from ..operators.fold import KEYS, ClosedForm, Handlers, python_fold
from ..operators.tags import TagQuery, query_by_tags
from ..schema import DELETED, UPDATED
from ..sources.reads import visible

LIFECYCLES = ("live", "inline", "async")


@dataclass
class Projection:
    """Common parts: name, fold, event filters, enrichment, lifecycle and version."""

    name: str
    fold: ClosedForm | FlatTable | None = None
    types: tuple[str, ...] = ()
    aggregate_type: str | None = None
    include_archived: bool = False
    lifecycle: str = "async"
    version: int = 1
    enrichments: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)

    def filtered(self, events: DataFrame) -> DataFrame:
        out = visible(events, self.include_archived)
        if self.types:
            out = out.where(F.col("event_type").isin(*self.types))
        if self.aggregate_type and "aggregate_type" in events.columns and self.lifecycle == "async":
            out = out.where(F.col("aggregate_type") == self.aggregate_type)
        return out

    def sliced(self, events: DataFrame) -> DataFrame:
        raise NotImplementedError

    has_errors = False

    def enriched(self, events: DataFrame) -> DataFrame:
        """The slices of the events, with what the enrichment steps add."""
        rows = self.sliced(self.filtered(events))
        for step in self.enrichments:
            rows = step(rows)
        return rows

    def folded(self, slices: DataFrame) -> DataFrame:
        return self.fold.run(slices)

    def run(self, events: DataFrame) -> DataFrame:
        return self.folded(self.enriched(events))

    def matches_any_event(self) -> bool:
        """No type filter: every event is offered to the fold."""
        return not self.types

    def filter_description(self) -> dict:
        """What the projection reads: its event types (none: any), aggregate type, archived events or not."""
        return {"matches_any_event": self.matches_any_event(), "event_types": sorted(self.types), "aggregate_type": self.aggregate_type, "include_archived": self.include_archived}

    def reads_any_of(self, *event_types: str) -> bool:
        """Some of these types are among those read: a batch without any needs no fold."""
        return self.matches_any_event() or bool(set(self.types) & set(event_types))

    def enrich(self, step: Callable[[DataFrame], DataFrame]) -> Projection:
        """A step over the slices before the fold."""
        self.enrichments.append(step)
        return self

    def validate(self) -> list[str]:
        out = [] if self.fold is not None else [f"{self.name}: no fold"]
        return out + ([] if self.lifecycle in LIFECYCLES else [f"{self.name}: unknown lifecycle {self.lifecycle}"])


class SingleStream(Projection):
    """One row for each stream."""

    def sliced(self, events: DataFrame) -> DataFrame:
        return slicing.by_stream(events)


class HandlerStream(SingleStream):
    """One row for each stream (or identity of a slicer), folded by Python handlers; errors are skipped and kept, or fail the run."""

    has_errors = True

    def __init__(self, name: str, handlers: Handlers, state_ddl: str, slicer: slicing.Slicer | None = None, **rest):
        super().__init__(name, None, **rest)
        self.handlers, self.state_ddl, self.slicer = handlers, state_ddl, slicer

    def sliced(self, events: DataFrame) -> DataFrame:
        return self.slicer.slice(events) if self.slicer else super().sliced(events)

    def folded(self, slices: DataFrame, on_error: str = "skip") -> DataFrame:
        made = python_fold(slices, self.handlers, self.state_ddl, on_error=on_error).where("is_live")
        return made.select(*KEYS, "last_sequence", "version", *[f.name for f in StructType.fromDDL(self.state_ddl).fields])

    def run(self, events: DataFrame, on_error: str = "skip") -> DataFrame:
        return self.folded(self.enriched(events), on_error)

    def errors(self, events: DataFrame) -> DataFrame:
        """The dead letters of a run: keys, sequence, event_type, exception_type, exception_message."""
        return python_fold(self.enriched(events), self.handlers, self.state_ddl, mode="errors")

    def validate(self) -> list[str]:
        return [] if self.lifecycle in LIFECYCLES else [f"{self.name}: unknown lifecycle {self.lifecycle}"]


class MultiStream(Projection):
    """One row for each identity of a slicer."""

    def __init__(self, name: str, slicer: slicing.Slicer, fold: ClosedForm | FlatTable, **rest):
        super().__init__(name, fold, **rest)
        self.slicer = slicer

    def sliced(self, events: DataFrame) -> DataFrame:
        return self.slicer.slice(events)

    def validate(self) -> list[str]:
        try:
            self.slicer.validate()
        except ValueError as e:
            return [*super().validate(), f"{self.name}: {e}"]
        return super().validate()


class BoundaryAggregate(Projection):
    """One state over all events that a tag query covers, whatever their streams; it has no identity of its own."""

    def __init__(self, name: str, query: TagQuery, fold: ClosedForm, **rest):
        super().__init__(name, fold, **rest)
        self.query = query

    def sliced(self, events: DataFrame) -> DataFrame:
        return slicing.ungrouped(query_by_tags(events, self.query))


class EventProjection(Projection):
    """Each event to rows of its own, by type; no state."""

    def __init__(self, name: str, **rest):
        super().__init__(name, None, **rest)
        self.made: list[tuple[str, dict[str, Column], Column | None]] = []

    def project(self, event_type: str, explode: Column | None = None, **columns: Column) -> EventProjection:
        """Columns for an event type; with ``explode`` one row per element, named ``item``."""
        self.made.append((event_type, columns, explode))
        return self

    def run(self, events: DataFrame) -> DataFrame:
        rows = self.filtered(events)
        for step in self.enrichments:
            rows = step(rows)
        out = None
        for kind, columns, explode in self.made:
            part = rows.where(F.col("event_type") == kind)
            part = (part.withColumn("item", F.explode(explode)) if explode is not None else part).select(*[c.alias(n) for n, c in columns.items()])
            out = part if out is None else out.unionByName(part)
        return out

    def validate(self) -> list[str]:
        return [] if self.made else [f"{self.name}: projects no event type"]


class Composite:
    """Ordered stages. What a stage stores or drops becomes events before the next stage's input.

    A member's rows become ``updated`` events; identities that had events but no row become ``projection_deleted`` ones.
    """

    def __init__(self, name: str):
        self.name, self.stages, self.lifecycle = name, [], "async"

    def stage(self, *members: Projection) -> Composite:
        self.stages.append(members)
        return self

    def run(self, events: DataFrame) -> dict[str, DataFrame]:
        out, current, with_id = {}, events, "id" in events.columns
        for at, members in enumerate(self.stages):
            derived, later = [], [m for stage in self.stages[at + 1 :] for m in stage]
            for m in members:
                out[m.name] = m.run(current)
                if any(x.reads_any_of(UPDATED) for x in later):
                    derived.append(derived_events(out[m.name], m.name, with_id=with_id))
                if isinstance(m, (SingleStream, MultiStream)) and any(x.reads_any_of(DELETED) for x in later):
                    gone = m.sliced(m.filtered(current)).select(*KEYS).distinct().join(out[m.name].select(*KEYS), KEYS, "left_anti")
                    derived.append(derived_events(gone, m.name, deleted=True, with_id=with_id))
            for d in derived:
                current = current.unionByName(d, allowMissingColumns=True)
        return out

    def validate(self) -> list[str]:
        names = [m.name for s in self.stages for m in s]
        out = [f"{self.name}: {n} stands twice" for n in sorted({n for n in names if names.count(n) > 1})]
        return out + [e for s in self.stages for m in s for e in m.validate()] + ([] if self.stages else [f"{self.name}: no stage"])


def derived_events(view: DataFrame, source: str, deleted: bool = False, with_id: bool = False) -> DataFrame:
    """A read model's rows as events before all others (sequence 0): (tenant_id, stream_id, event_type, sequence, state); the stream is the row's identity."""
    names = [c for c in view.columns if c not in KEYS]
    kind = DELETED if deleted else UPDATED
    return view.select(
        F.col("slice_tenant").alias("tenant_id"), F.col("slice_id").alias("stream_id"), F.lit(kind).alias("event_type"), F.lit(0).cast("long").alias("sequence"),
        F.lit(source).alias("aggregate_type"), F.col("slice_id").alias("source_id"), *([F.struct(*names).alias("state")] if names else []),
        *([F.concat_ws(":", F.lit(kind), F.lit(source), "slice_tenant", "slice_id").alias("id")] if with_id else []),
    )


def upstream(rows: DataFrame, view: DataFrame, key: Column, columns: dict[str, str], per_tenant: bool = True) -> DataFrame:
    """Rows of a later stage with columns (new name: the view's) of an earlier stage's read model, of their own tenant."""
    found = view.select(F.col("slice_tenant").alias("up_tenant__"), F.col("slice_id").alias("up_id__"), *[F.col(c).alias(n) for n, c in columns.items()])
    same = key.cast("string") == F.col("up_id__")
    tenant = F.col("slice_tenant") if "slice_tenant" in rows.columns else F.col("tenant_id")
    return rows.join(found, same & (tenant == F.col("up_tenant__")) if per_tenant else same, "left").drop("up_tenant__", "up_id__")


#: What a sink does with a row of a read model.
ACTIONS = ("Store", "Delete", "UnDeleteAndStore", "Nothing", "HardDelete", "StoreThenSoftDelete")


def actions(before: DataFrame, after: DataFrame, keys: list[str] = KEYS, ending: Column | None = None, hard: bool = False) -> DataFrame:
    """Rows and what a sink has to do with them (``ACTIONS``).

    ``before`` may have a boolean ``is_deleted`` for rows that were deleted softly: such a row that comes back is undeleted.
    A row that did not change needs nothing, if both sides have the same columns. Rows of ``after`` where ``ending``
    holds are stored and then deleted softly; rows that are gone are deleted, for good with ``hard``.
    """
    soft = "is_deleted" in before.columns
    columns = [c for c in after.columns if c not in keys]
    same_columns = set(columns) == {c for c in before.columns if c not in (*keys, "is_deleted")}
    old = before.select(*keys, F.lit(True).alias("had__"), (F.coalesce("is_deleted", F.lit(False)) if soft else F.lit(False)).alias("gone__"), *([F.struct(*[F.col(c) for c in columns]).alias("was__")] if same_columns and columns else []))
    joined = after.join(old, keys, "left")
    stay = F.coalesce(F.col("had__") & ~F.col("gone__"), F.lit(False)) & F.col("was__").eqNullSafe(F.struct(*[F.col(c) for c in columns])) if same_columns and columns else F.lit(False)
    what = F.when(F.coalesce("gone__", F.lit(False)), F.lit("UnDeleteAndStore")).when(stay, F.lit("Nothing")).otherwise(F.lit("Store"))
    if ending is not None:
        what = F.when(F.coalesce(ending, F.lit(False)), F.lit("StoreThenSoftDelete")).otherwise(what)
    stored = joined.withColumn("action", what).select(*after.columns, "action")
    lost = before.where(~F.coalesce("is_deleted", F.lit(False))).drop("is_deleted") if soft else before
    gone = lost.join(after.select(*keys), keys, "left_anti").withColumn("action", F.lit("HardDelete" if hard else "Delete"))
    return stored.unionByName(gone, allowMissingColumns=True)


def apply_actions(table: DataFrame, acts: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """A table of rows with ``is_deleted`` after a sink has carried out the actions."""
    columns = [c for c in table.columns if c != "is_deleted"]
    stored = acts.where(F.col("action").isin("Store", "UnDeleteAndStore", "StoreThenSoftDelete")).select(*columns, (F.col("action") == "StoreThenSoftDelete").alias("is_deleted"))
    soft = table.join(acts.where("action = 'Delete'").select(*keys), keys, "left_semi").withColumn("is_deleted", F.lit(True))
    rest = table.join(acts.where("action != 'Nothing'").select(*keys), keys, "left_anti")
    return stored.unionByName(soft.select(*stored.columns)).unionByName(rest.select(*stored.columns))


class ProjectionGraph:
    """Registered projections by name, with validation and lookup of composite members."""

    def __init__(self):
        self.all: dict[str, Projection | Composite] = {}

    def register(self, projection: Projection | Composite) -> None:
        if projection.name in self.all:
            raise ValueError(f"projection {projection.name} is registered already")
        self.all[projection.name] = projection

    def find(self, name: str) -> Projection | Composite:
        if name in self.all:
            return self.all[name]
        for p in self.all.values():
            for members in getattr(p, "stages", []):
                for m in members:
                    if m.name == name:
                        return m
        raise KeyError(name)

    def validate(self) -> None:
        if errors := [e for p in self.all.values() for e in p.validate()]:
            raise ValueError("; ".join(errors))


def natural_keys(events: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """natural_key -> stream_id, by event type; the latest event decides."""
    key = F.lit(None).cast("string")
    for kind, column in keys.items():
        key = F.when(F.col("event_type") == kind, column.cast("string")).otherwise(key)
    rows = events.withColumn("natural_key", key).where("natural_key is not null")
    return rows.groupBy("tenant_id", "natural_key").agg(F.max_by("stream_id", "sequence").alias("stream_id"))
