"""The event-model graph and topological order."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kinds of elements of a slice in the order in which they lead to each other.
KINDS = (("triggers", "trigger"), ("commands", "command"), ("handlers", "handler"), ("events", "event"), ("projections", "projection"), ("read_models", "read_model"))


@dataclass(frozen=True)
class Slice:
    """One slice of an event model: what triggers a command, who handles it, which events and read models follow."""

    name: str
    triggers: tuple[str, ...] = ()
    commands: tuple[str, ...] = ()
    handlers: tuple[str, ...] = ()
    events: tuple[str, ...] = ()
    projections: tuple[str, ...] = ()
    read_models: tuple[str, ...] = ()


def model(spark: SparkSession, slices: Iterable[Slice]) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges): elements by (kind, name), of which the first slice's stays, and edges between neighbouring kinds."""
    slices = list(slices)
    ddl = "ordinal int, slice string, " + ", ".join(f"{f} array<string>" for f, _ in KINDS)
    df = spark.createDataFrame([(i, s.name, *[list(getattr(s, f)) for f, _ in KINDS]) for i, s in enumerate(slices)], ddl)
    parts = [df.select("ordinal", "slice", F.lit(kind).alias("kind"), F.explode(f).alias("name")) for f, kind in KINDS]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    first = Window.partitionBy("kind", "name").orderBy("ordinal")
    vertices = found.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("kind", "name", "slice")
    edges = None
    for (a, ka), (b, kb) in zip(KINDS, KINDS[1:], strict=False):
        e = df.select(F.explode(a).alias("from_name"), F.col(b)).select(F.lit(ka).alias("from_kind"), "from_name", F.lit(kb).alias("to_kind"), F.explode(b).alias("to_name"))
        edges = e if edges is None else edges.unionByName(e)
    return vertices, edges.distinct()


def topological(items: Iterable, depends_on: Callable) -> list:
    """Items after what they depend on, otherwise in the given order; a cycle is an error."""
    out, state = [], {}
    for start in items:
        stack = [(start, iter(depends_on(start)))] if start not in state else []
        if stack:
            state[start] = "open"
        while stack:
            item, rest = stack[-1]
            for other in rest:
                if state.get(other) == "open":
                    raise ValueError(f"cycle through {other}")
                if other not in state:
                    state[other] = "open"
                    stack.append((other, iter(depends_on(other))))
                    break
            else:
                stack.pop()
                state[item] = "done"
                out.append(item)
    return out
