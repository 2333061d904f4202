"""Folds of slices into read-model rows, in three strengths.

``ClosedForm``: handlers are columns (create, sums, counts, last and extreme values). Markers (last delete, first
create after it) are pre-aggregated per identity, joined back, and the rest is one partial
aggregation. A stream that holds a third of all rows costs a skewed join, which adaptive execution splits,
and sums that combine before the shuffle. This is the way to write a fold for large data.

``expression_fold``: an ordered ``aggregate`` over the sorted events of an identity, for rules that read the
state. Stays in the JVM; an identity's events form one array.

``python_fold``: handlers in Python. Events arrive sorted and are folded as they stream by, so memory
holds one state, not one group.

Rules of all three: events apply strictly in order of (sequence, ordinal); a delete empties the state and
is itself not applied; a create counts only on an empty state; other events need a state, unless
the fold starts from a default. Deletes act in their place, however pages are cut.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import COMPACTED

KEYS = ["slice_tenant", "slice_id"]


@dataclass
class Measure:
    """``kind``: sum, count, last, min, max or collect; over ``types`` (none: all) after the create, or from it on.

    ``seed``: the value of a sum or count that a compaction event carries; the fold goes on from it.
    """

    kind: str
    value: Column | None = None
    types: tuple[str, ...] = ()
    at_create: bool = False
    seed: Column | None = None


@dataclass
class ClosedForm:
    create: tuple[str, ...] = ()
    delete: tuple[str, ...] = ()
    measures: dict[str, Measure] = field(default_factory=dict)
    relevant: tuple[str, ...] = ()

    def live(self, slices: DataFrame, keys: list[str] = KEYS) -> DataFrame:
        """Events of living states, from their create on, with ``created`` (its place, or null without creates)."""
        if self.relevant:
            slices = slices.where(F.col("event_type").isin(*{*self.relevant, *self.create, *self.delete, COMPACTED}))
        place = F.struct("sequence", "ordinal")
        if any(m.seed is not None for m in self.measures.values()):
            slices = compacted_forward(slices, keys)
        if self.delete:
            gone = slices.where(F.col("event_type").isin(*self.delete)).groupBy(*keys).agg(F.max(place).alias("gone__"))
            slices = slices.join(gone, keys, "left").where(F.col("gone__").isNull() | (place > F.col("gone__"))).drop("gone__")
        if self.create:
            born = slices.where(F.col("event_type").isin(*self.create, COMPACTED)).groupBy(*keys).agg(F.min(place).alias("created"))
            return slices.join(born, keys).where(place >= F.col("created"))
        return slices.withColumn("created", F.lit(None).cast("struct<sequence:bigint,ordinal:int>"))

    def run(self, slices: DataFrame, keys: list[str] = KEYS) -> DataFrame:
        """One row for each identity with a state: keys, last_sequence and the measures."""
        live = self.live(slices, keys)
        return live.groupBy(*keys).agg(F.max("sequence").alias("last_sequence"), *[self._agg(m).alias(n) for n, m in self.measures.items()])

    def _agg(self, m: Measure) -> Column:
        here = F.col("event_type").isin(*m.types) if m.types else F.lit(True)
        if self.create and not m.at_create:
            here &= F.struct("sequence", "ordinal") > F.col("created")
        here &= F.col("event_type") != COMPACTED
        if m.seed is not None:
            own = ClosedForm._agg(self, Measure(m.kind, m.value, m.types, m.at_create))
            return own + F.coalesce(F.sum(F.when(F.col("event_type") == COMPACTED, m.seed)), F.lit(0))
        order = F.struct("sequence", "ordinal")
        return {
            "sum": lambda: F.coalesce(F.sum(F.when(here, m.value)), F.lit(0)),
            "count": lambda: F.count(F.when(here, F.lit(1))).cast("long"),
            "min": lambda: F.min(F.when(here, m.value)),
            "max": lambda: F.max(F.when(here, m.value)),
            "last": lambda: F.max_by(m.value, F.when(here, order)),
            "collect": lambda: F.transform(F.array_sort(F.collect_list(F.when(here, F.struct(order.alias("o"), m.value.alias("v"))))), lambda x: x["v"]),
        }[m.kind]()


def resumed(snapshot: DataFrame, fold: ClosedForm, new: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """A snapshot brought up to date with newer events only: sums and counts add up, deletes start anew.

    Measures must be sums or counts. Snapshots whose identity has no new event stay as they are.
    """
    gone = new.where(F.col("event_type").isin(*fold.delete)).select(*keys).distinct() if fold.delete else None
    kept = snapshot if gone is None else snapshot.join(gone, keys, "left_anti")
    known = kept.select(*keys, F.lit(True).alias("known__"))
    marked = new.join(known, keys, "left")
    going = ClosedForm((), (), fold.measures, fold.relevant).run(marked.where("known__"), keys)
    fresh = fold.run(marked.where("known__ is null").drop("known__"), keys)
    names = list(fold.measures)
    g = going.select(*keys, F.col("last_sequence").alias("seq__"), *[F.col(n).alias(f"{n}__") for n in names])
    merged = kept.join(g, keys, "left").select(*keys, F.coalesce("seq__", "last_sequence").alias("last_sequence"), *[(F.col(n) + F.coalesce(f"{n}__", F.lit(0))).cast(kept.schema[n].dataType).alias(n) for n in names])
    return merged.unionByName(fresh.select(*merged.columns))


def expression_fold(slices: DataFrame, carried: list[str], zero: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None, keys: list[str] = KEYS) -> DataFrame:
    """(keys, state): ``step(state, event)`` over each identity's events in order; ``carried`` are event columns."""
    rows = F.array_sort(F.collect_list(F.struct("sequence", "ordinal", *[c for c in carried if c not in ("sequence", "ordinal")])))
    folded = F.aggregate(rows, zero, step, finish) if finish else F.aggregate(rows, zero, step)
    return slices.groupBy(*keys).agg(folded.alias("state"))


def running(slices: DataFrame, fold: ClosedForm, keys: list[str] = KEYS) -> DataFrame:
    """The timeline of sums and counts: every event with each measure before and after it, restarted by deletes."""
    inside = Window.partitionBy(*keys).orderBy("sequence", "ordinal")
    out = slices.withColumn("life__", F.sum(F.when(F.col("event_type").isin(*fold.delete), 1).otherwise(0)).over(inside))
    life = Window.partitionBy(*keys, "life__").orderBy("sequence", "ordinal")
    for name, m in fold.measures.items():
        here = F.col("event_type").isin(*m.types) if m.types else F.lit(True)
        gain = F.when(here & ~F.col("event_type").isin(*fold.delete), m.value if m.kind == "sum" else F.lit(1)).otherwise(0)
        total = F.sum(gain).over(life.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        out = out.withColumn(f"{name}_after", total)
    for name in fold.measures:
        out = out.withColumn(f"{name}_before", F.coalesce(F.lag(f"{name}_after").over(inside), F.lit(0)))
    return out.drop("life__")


class Handlers:
    """Python handlers of an aggregate, dispatched from derived to base types.

    ``create[type](event) -> state``, ``apply[type](state, event) -> state | None`` (None deletes; a
    mutated state may be returned), ``should_delete[type](state, event) -> bool``, ``delete`` types,
    ``default() -> state`` for a fold that needs no create, or one ``evolve(state, event)`` for all.
    """

    def __init__(self, create: dict | None = None, apply: dict | None = None, should_delete: dict | None = None, delete: tuple[str, ...] = (), default: Callable | None = None, evolve: Callable | None = None, bases: dict[str, tuple[str, ...]] | None = None):
        if evolve and (create or apply or should_delete):
            raise ValueError("either evolve or create/apply/should_delete")
        self.create, self.apply, self.should_delete, self.delete = create or {}, apply or {}, should_delete or {}, delete
        self.default, self.evolve, self.bases = default, evolve, bases or {}

    def find(self, handlers: dict, event_type: str):
        """The handler of the type itself, else of its nearest base."""
        seen, level = {event_type}, [event_type]
        while level:
            for t in level:
                if t in handlers:
                    return handlers[t]
            level = [b for t in level for b in self.bases.get(t, ()) if b not in seen]
            seen |= set(level)
        return None

    def step(self, state, event: dict):
        kind = event["event_type"]
        if kind == COMPACTED and self.find(self.create, kind) is None:
            return json.loads(event["data"])  # stands for all events up to it
        if self.evolve:
            return self.evolve(state, event)
        if kind in self.delete:
            return None
        if state is not None and (gone := self.find(self.should_delete, kind)) and gone(state, event):
            return None
        if state is None:
            if make := self.find(self.create, kind):
                return make(event)
            if self.default is None or self.find(self.apply, kind) is None:
                return None
            state = self.default()
        change = self.find(self.apply, kind)
        return state if change is None else change(state, event)


class ApplyEventError(RuntimeError):
    """A handler failed on an event and the policy does not skip."""


def python_fold(slices: DataFrame, handlers: Handlers, state_ddl: str, mode: str = "final", on_error: str = "skip", keys: list[str] = KEYS) -> DataFrame:
    """Folds with Python handlers.

    mode ``final``: keys, last_sequence, version, last_known (the last state that was not deleted, as in
    ``state_ddl`` columns prefixed ``known_``) and the state's columns, null when deleted; ``timeline``: a row for each event
    with the state before and after as JSON, and the error; ``errors``: the dead letters only.
    """
    state = StructType.fromDDL(state_ddl)
    names = [f.name for f in state.fields]
    key_ddl = ", ".join(f"{k} {slices.schema[k].dataType.simpleString()}" for k in keys)
    ddl = {
        "final": f"{key_ddl}, last_sequence long, version long, is_live boolean, {state_ddl}, " + ", ".join(f"known_{f.name} {f.dataType.simpleString()}" for f in state.fields),
        "timeline": f"{key_ddl}, sequence long, ordinal int, event_type string, before string, after string, error string",
        "errors": f"{key_ddl}, sequence long, event_type string, exception_type string, exception_message string",
    }[mode]
    columns = [f.name for f in StructType.fromDDL(ddl).fields]

    def run(batches):
        key, now, known, last, count, out = None, None, None, 0, 0, []

        def close():
            if key is not None and mode == "final" and count:
                out.append((*key, last, count, now is not None, *[(now or {}).get(n) for n in names], *[(known or {}).get(n) for n in names]))

        def flush():
            made = pd.DataFrame(out, columns=columns, dtype=object)
            out.clear()
            return made

        for batch in batches:
            for event in batch.to_dict("records"):
                mine = tuple(event[k] for k in keys)
                if mine != key:
                    close()
                    key, now, known, last, count = mine, None, None, 0, 0
                before, error = now, None
                try:
                    now = handlers.step(dict(now) if now is not None else None, event)
                except Exception as e:  # any handler error is an apply error by contract
                    if on_error != "skip":
                        raise ApplyEventError(f"event {event['sequence']} of {key}") from e
                    now, error = before, e
                known = now if now is not None else known
                last, count = event["sequence"], count + (error is None)
                if mode == "timeline":
                    text = lambda s: None if s is None else json.dumps(s, sort_keys=True, default=str)
                    out.append((*key, event["sequence"], event["ordinal"], event["event_type"], text(before), text(now), None if error is None else str(error)))
                elif mode == "errors" and error is not None:
                    out.append((*key, event["sequence"], event["event_type"], type(error).__name__, str(error)))
            if len(out) > 10_000:
                yield flush()
        close()
        yield flush()

    return slices.repartition(*keys).sortWithinPartitions(*keys, "sequence", "ordinal").mapInPandas(run, ddl)


def compacted_forward(events: DataFrame, keys: list[str], compacted: str = COMPACTED) -> DataFrame:
    """Drops what precedes an identity's newest compaction event; that event stands for it."""
    newest = events.where(F.col("event_type") == compacted).groupBy(*keys).agg(F.max("sequence").alias("from__"))
    return events.join(newest, keys, "left").where(F.col("sequence") >= F.coalesce("from__", F.lit(-1))).drop("from__")
