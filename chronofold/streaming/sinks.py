"""Side outputs of a batch: raised events, messages and dead letters, each written once per batch id."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class SideEffects:
    """What a read model raises after a batch: events for streams, and messages.

    Only continuous runs raise anything; catch-ups and rebuilds do not.
    """

    raise_when: Column | None = None
    event_type: str = ""
    data: Column | None = None
    target: Column | None = None
    message_when: Column | None = None
    message: Column | None = None

    def events(self, view: DataFrame) -> DataFrame:
        """Rows to append: each goes to its own target stream only, after that stream's last version."""
        rows = view.where(self.raise_when)
        stream = self.target if self.target is not None else F.col("slice_id")
        return rows.select(F.col("slice_tenant").alias("tenant_id"), stream.cast("string").alias("stream_id"), F.lit(self.event_type).alias("event_type"), self.data.alias("data"))

    def messages(self, view: DataFrame) -> DataFrame:
        return view.where(self.message_when).select(F.col("slice_tenant").alias("tenant_id"), F.col("slice_id"), self.message.alias("body"))


def write_once(rows: DataFrame, folder: str, batch_id: int) -> None:
    """Overwrites the batch's own part, so a batch that is tried again leaves one copy."""
    rows.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={batch_id}")


def dead_letters(errors: DataFrame, projection: str, shard: str) -> DataFrame:
    """Errors of a Python fold as dead-letter rows."""
    return errors.select(
        F.lit(projection).alias("projection"), F.lit(shard).alias("shard_name"), F.col("slice_tenant").alias("tenant_id"), F.col("sequence").alias("event_sequence"),
        "exception_type", "exception_message", F.current_timestamp().alias("timestamp"),
    )


def sink(view_of: Callable[[DataFrame, int], DataFrame], effects: SideEffects, store, outbox: str, name: str = "side effects") -> Callable[[DataFrame, int], None]:
    """A ``side_effects`` callback for ``Daemon.continuous``: appends raised events and fills the outbox.

    The store remembers the last batch of ``name`` with the commit, so a batch that is tried again raises nothing twice.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        view = view_of(batch, batch_id)
        if effects.message_when is not None:
            write_once(effects.messages(view), outbox, batch_id)
        if effects.raise_when is not None:
            store.append_frame(effects.events(view).withColumn("timestamp", F.current_timestamp()), once=(name, batch_id))

    return run


def project_latest(projection, committed: DataFrame, pending: DataFrame) -> DataFrame:
    """A read model over committed events and those a session has not saved yet, which come last."""
    top = committed.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("top__"))
    later = pending.join(F.broadcast(top), F.lit(True)).withColumn("sequence", (F.col("top__") + F.col("sequence")).cast("long")).drop("top__")  # one row
    return projection.run(committed.unionByName(later, allowMissingColumns=True))
