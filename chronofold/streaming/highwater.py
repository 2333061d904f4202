"""High-water marks over a log's sequence: the highest one below which nothing is missing.

The log is cut into ranges of ``SPAN`` sequences and each range is reduced to first, last and count before
anything is ordered, so the ordered part has one row for each range, not for each event.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1_000_000


def gaps(events: DataFrame, span: int = SPAN, by: tuple[str, ...] = ()) -> DataFrame:
    """(``by``, gap_after, resumes_at): neighbours in the log (of each value of ``by``) whose sequences are not."""
    seq = events.select(*by, "sequence").distinct().withColumn("range", F.floor(F.col("sequence") / span))
    inside = seq.withColumn("next", F.lead("sequence").over(Window.partitionBy(*by, "range").orderBy("sequence")))
    inner = inside.where(F.col("next") > F.col("sequence") + 1).select(*by, F.col("sequence").alias("gap_after"), F.col("next").alias("resumes_at"))
    ends = seq.groupBy(*by, "range").agg(F.min("sequence").alias("low"), F.max("sequence").alias("high"))
    order = Window.partitionBy(*by).orderBy("range")  # one row for each million sequences
    outer = ends.withColumn("next", F.lead("low").over(order)).where(F.col("next") > F.col("high") + 1)
    return inner.unionByName(outer.select(*by, F.col("high").alias("gap_after"), F.col("next").alias("resumes_at")))


def high_water_mark(events: DataFrame, by: str | None = None, skip_to: int | None = None, span: int = SPAN, own: bool = False) -> DataFrame:
    """One row (for each value of ``by``): mark and highest.

    ``skip_to``: gaps that resume at or below it are stale and skipped. Values of ``by`` that share one sequence share its
    mark: each stands at its last event up to there (0 if it has none). With ``own`` each has a sequence of its own.
    """
    if by is None:
        found = gaps(events, span)
        if skip_to is not None:
            found = found.where(F.col("resumes_at") > skip_to)
        first = found.agg(F.min("gap_after").alias("gap"))
        return events.agg(F.max("sequence").alias("highest")).join(F.broadcast(first), F.lit(True)).select(F.coalesce("gap", "highest").alias("mark"), "highest")  # one row each
    if not own:
        shared = high_water_mark(events, None, skip_to, span).select(F.col("mark").alias("shared__"))
        rows = events.select(by, "sequence").join(F.broadcast(shared), F.lit(True))  # one row
        return rows.groupBy(by).agg(F.coalesce(F.max(F.when(F.col("sequence") <= F.col("shared__"), F.col("sequence"))), F.lit(0).cast("long")).alias("mark"), F.max("sequence").alias("highest"))
    found = gaps(events, span, (by,))
    if skip_to is not None:
        found = found.where(F.col("resumes_at") > skip_to)
    first = found.groupBy(by).agg(F.min("gap_after").alias("gap__"))
    return events.groupBy(by).agg(F.max("sequence").alias("highest")).join(first, by, "left").select(by, F.coalesce("gap__", "highest").alias("mark"), "highest")


@dataclass
class HighWater:
    """The driver's view of the mark: it never goes back; a gap older than the threshold is skipped."""

    mark: int = 0
    since: float = 0.0
    skipped: int = 0
    threshold: float = 3.0

    def observe(self, mark: int, highest: int, now: float) -> str:
        """CaughtUp, Changed or Stale; after Stale the caller reads again with ``skip_to=highest``."""
        if mark > self.mark:
            self.mark, self.since = mark, now
            return "CaughtUp" if mark >= highest else "Changed"
        if highest <= self.mark:
            self.since = now
            return "CaughtUp"
        return "Stale" if now - self.since >= self.threshold else "Changed"

    def skip(self, mark: int, now: float) -> None:
        self.skipped += max(0, mark - self.mark - 1)
        self.mark, self.since = max(self.mark, mark), now


def merged(old: dict[str, int], new: dict[str, int]) -> dict[str, int]:
    """A vector of marks by tenant; each only rises."""
    return {t: max(old.get(t, 0), new.get(t, 0)) for t in {*old, *new}}
