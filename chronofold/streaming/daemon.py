"""Projections over a growing log: catch-up, continuous runs, rebuilds, subscriptions.

A page is a range of sequences above the shard's progress and never past the high-water mark, the
highest sequence below which nothing is missing. It is read from the log by sequence, whatever files
the events lie in, so neither interleaved files nor a gap that fills late loses an event. A gap that stays longer than the
threshold is skipped and counted. Each page is folded on top of the stored read model: sums and counts add up (see ``fold.resumed``),
for other folds the slices that the page touches are folded anew. The result is a new version of the table with a
progress row; a page whose floor is not where the progress ends is refused.

Continuous runs are a Structured Streaming query whose trigger looks at the log; catch-ups run
until the mark is reached. A rebuild folds the whole log in one batch job and replaces the table once.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.fold import KEYS, ClosedForm, resumed
from ..plans.projections import Composite, Projection
from .highwater import HighWater, high_water_mark
from .lag import ProgressOutOfOrder, ShardName
from .sinks import dead_letters, write_once


@dataclass(frozen=True)
class StartAt:
    """Where a shard begins: catch_up (progress or 0), present, sequence, time, or inline_to_async."""

    kind: str = "catch_up"
    value: object = None

    def floor(self, events: DataFrame, progress: int | None) -> int:
        """Events above this sequence are read; stored progress wins once it is past it."""
        if self.kind == "catch_up":
            return progress or 0
        if self.kind == "inline_to_async" and progress is not None:
            return progress
        found = {
            "present": lambda: events,
            "inline_to_async": lambda: events,
            "time": lambda: events.where(F.col("timestamp") < F.lit(self.value)),
        }
        at = int(self.value) if self.kind == "sequence" else found[self.kind]().agg(F.max("sequence")).first()[0] or 0
        return max(at, progress or 0)


class ReadModelTable:
    """Versions of a read model under a folder, and a pointer to the one that holds."""

    def __init__(self, spark: SparkSession, root: str, shard: ShardName):
        self.spark, self.root, self.shard = spark, root.rstrip("/"), shard
        self.folder = f"{self.root}/{str(shard).replace(':', '_')}"

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def progress(self) -> dict | None:
        """The newest progress row: version, sequence, batch id."""
        fs, p = self._fs(f"{self.folder}/_progress")
        if not fs.exists(p):
            return None
        names = sorted(x.getPath().getName() for x in fs.listStatus(p) if x.getPath().getName().endswith(".json"))
        return json.loads(self.spark.read.text(f"{self.folder}/_progress/{names[-1]}", wholetext=True).first()[0]) if names else None

    def read(self) -> DataFrame | None:
        at = self.progress()
        return self.spark.read.parquet(f"{self.folder}/{at['folder']}") if at else None

    def write(self, rows: DataFrame, sequence: int, batch_id: int, skipped: int = 0) -> None:
        """A new version of the rows and its progress; fails if another writer made that version, and drops versions before the last two."""
        at = self.progress()
        version = at["version"] + 1 if at else 1
        name = f"v{version:012d}_{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.folder}/{name}")
        fs, p = self._fs(f"{self.folder}/_progress/{version:012d}.json")
        try:
            stream = fs.create(p, False)
        except Exception as e:
            if "exists" in str(e).lower():
                raise ProgressOutOfOrder(f"{self.shard} was written by another daemon") from e
            raise
        try:
            stream.write(bytearray(json.dumps({"version": version, "folder": name, "sequence": sequence, "batch_id": batch_id, "skipped": skipped}).encode()))
        finally:
            stream.close()
        self._drop_before(version - 1)

    def _drop_before(self, version: int) -> None:
        fs, p = self._fs(self.folder)
        for x in fs.listStatus(p):
            name = x.getPath().getName()
            if name.startswith("v") and int(name[1:13]) < version:
                fs.delete(x.getPath(), True)

    def drop(self) -> None:
        fs, p = self._fs(self.folder)
        fs.delete(p, True)


class Daemon:
    """Runs projections over a log: a parquet folder, an event store, or a function that gives the log's events."""

    def __init__(self, spark: SparkSession, log, root: str, prepare: Callable[[DataFrame], DataFrame] = lambda e: e, threshold: float = 3.0):
        self.spark, self.source, self.root, self.prepare, self.threshold = spark, log, root, prepare, threshold
        self.water: dict[str, HighWater] = {}

    def log(self) -> DataFrame:
        found = self.spark.read.parquet(self.source) if isinstance(self.source, str) else self.source.events() if hasattr(self.source, "events") else self.source()
        return self.prepare(found)

    def table(self, projection: Projection | Composite, member: str | None = None) -> ReadModelTable:
        """The stored read model; of a composite that of a member, else its shared progress."""
        return ReadModelTable(self.spark, self.root, ShardName(projection.name, key=member or "All", version=getattr(projection, "version", 1)))

    # ---- the mark ----

    def mark(self, floor: int = 0, shard: str = "", now: float | None = None) -> int:
        """How far a shard at ``floor`` may read. A gap that has stood for ``threshold`` seconds is skipped.

        Before anything was read the log begins at its first event; later, right behind the floor.
        """
        above = self.log().where(F.col("sequence") > floor).select("sequence")
        if floor:
            above = above.unionByName(self.spark.range(1).select(F.lit(floor).cast("long").alias("sequence")))
        found = high_water_mark(above).first()
        if found["highest"] is None:
            return floor
        water, now = self.water.setdefault(shard, HighWater(threshold=self.threshold)), time.monotonic() if now is None else now
        if floor > water.mark:
            water.mark, water.since = floor, now
        if not water.since:
            water.since = now
        if water.observe(found["mark"], found["highest"], now) != "Stale":
            return found["mark"]
        mark = high_water_mark(above, skip_to=found["highest"]).first()["mark"]
        water.skip(mark, now)
        return mark

    # ---- rebuilds ----

    def rebuild(self, projection: Projection | Composite, tenant: str | None = None, on_error: str = "fail") -> None:
        """The whole log folded once, replacing the table; without events nothing is torn down. Errors fail it unless they are skipped."""
        events = self.log()
        mark = events.agg(F.max("sequence")).first()[0]
        if not mark:
            return
        if isinstance(projection, Composite):
            self._write_composite(projection, events, mark, -1)
            return
        table = self.table(projection)
        if tenant is None:
            table.write(projection.run(events, on_error=on_error) if projection.has_errors else projection.run(events), mark, -1)
            return
        fresh, old = projection.run(events.where(F.col("tenant_id") == tenant)), table.read()
        table.write(fresh if old is None else old.where(F.col("slice_tenant") != tenant).unionByName(fresh), mark, -1)

    def rebuild_all(self, projections: list[Projection], width: int = 4) -> None:
        """Several rebuilds at once, at most ``width`` of them."""
        with ThreadPoolExecutor(width) as pool:
            list(pool.map(self.rebuild, projections))

    def rebuild_tenants(self, projection: Projection, tenants: list[str] | None = None, width: int = 4) -> None:
        """The tenants named (none: all) folded at most ``width`` at a time into parts of their own, which replace their rows in one commit."""
        events = self.log()
        mark = events.agg(F.max("sequence")).first()[0]
        if not mark:
            return
        named = tenants if tenants is not None else [r[0] for r in events.select("tenant_id").distinct().collect()]  # a row for each tenant
        table, folder = self.table(projection), f"{self.root}/_rebuild/{uuid.uuid4().hex}"

        def one(job: tuple[int, str]) -> str:
            path = f"{folder}/{job[0]}"
            projection.run(events.where(F.col("tenant_id") == job[1])).write.parquet(path)
            return path

        with ThreadPoolExecutor(width) as pool:
            parts = list(pool.map(one, enumerate(named)))
        if not parts:
            return
        fresh, old = self.spark.read.parquet(*parts), table.read()
        if old is not None:
            gone = self.spark.createDataFrame([(t,) for t in named], "slice_tenant string")
            fresh = old.join(gone, "slice_tenant", "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))
        table.write(fresh, mark, -1)
        fs, p = table._fs(folder)
        fs.delete(p, True)

    # ---- pages ----

    def apply_batch(self, projection: Projection, batch: DataFrame, batch_id: int, expected_floor: int | None = None) -> None:
        """Events above the progress on top of the stored state; a batch that was applied already is left out."""
        at = self.table(projection).progress()
        if at and at["batch_id"] == batch_id:
            return
        floor = at["sequence"] if at else 0
        if expected_floor is not None and floor != expected_floor:
            raise ProgressOutOfOrder(f"{projection.name} is at {floor}, not {expected_floor}")
        mark = batch.where(F.col("sequence") > floor).agg(F.max("sequence")).first()[0]
        if mark is not None:
            self.apply_page(projection, floor, mark, batch_id)

    def apply_page(self, projection: Projection | Composite, floor: int, ceiling: int, batch_id: int | None = None, skipped: int = 0) -> None:
        """Folds the log's events in (floor, ceiling] into the read model; dead letters go to a table beside it."""
        table = self.table(projection)
        at = (table.progress() or {"sequence": 0})["sequence"]
        if at > floor:
            raise ProgressOutOfOrder(f"{projection.name} is at {at}, not {floor}")
        log, batch_id = self.log().where(F.col("sequence") <= ceiling), ceiling if batch_id is None else batch_id
        if isinstance(projection, Composite):
            self._write_composite(projection, log, ceiling, batch_id)
            return
        old = table.read()
        plain = isinstance(projection.fold, ClosedForm) and all(m.kind in ("sum", "count") for m in projection.fold.measures.values())
        page = log.where(F.col("sequence") > floor)
        if old is None and not floor:
            rows = projection.run(log)
        elif plain and old is not None:
            rows = resumed(old, projection.fold, projection.enriched(page))
        else:  # the slices that the page touches, from their first event on
            touched = projection.sliced(projection.filtered(page)).select(*KEYS).distinct()
            rows = projection.folded(projection.enriched(log).join(touched, KEYS, "left_semi"))
            if old is not None:
                rows = old.join(touched, KEYS, "left_anti").select(*old.columns).unionByName(rows.select(*old.columns))
        if projection.has_errors:
            letters = dead_letters(projection.errors(log).where(F.col("sequence") > floor), projection.name, str(table.shard))
            write_once(letters, f"{table.folder}_dead", ceiling)
        table.write(rows, ceiling, batch_id, skipped)

    def _write_composite(self, composite: Composite, events: DataFrame, ceiling: int, batch_id: int) -> None:
        """One pass over the stages; every member's table, then the shared progress."""
        for name, rows in composite.run(events).items():
            self.table(composite, name).write(rows, ceiling, batch_id)
        self.table(composite).write(self.spark.range(0), ceiling, batch_id)

    def dead_letters(self, projection: Projection) -> DataFrame | None:
        folder = f"{self.table(projection).folder}_dead"
        fs, p = self.table(projection)._fs(folder)
        return self.spark.read.parquet(folder) if fs.exists(p) else None

    def advance(self, projection: Projection | Composite, start: StartAt = StartAt(), page: int | None = None, now: float | None = None) -> tuple[int, int]:
        """Applies what the mark allows, ``page`` sequences at a time (none: all at once); gives (floor before, progress after)."""
        shard = str(self.table(projection).shard)
        progress = (self.table(projection).progress() or {}).get("sequence")
        floor = first = start.floor(self.log(), progress)
        mark = self.mark(floor, shard, now)
        while floor < mark:
            ceiling = mark if page is None else min(mark, floor + page)
            self.apply_page(projection, floor, ceiling, skipped=self.water[shard].skipped)
            floor = ceiling
        return first, floor

    def catch_up(self, projection: Projection | Composite, start: StartAt = StartAt(), page: int | None = None) -> None:
        """Reads up to the mark and returns; side effects stay off."""
        self.advance(projection, start, page)

    def continuous(self, projection: Projection | Composite, start: StartAt = StartAt(), every: str = "1 second", page: int | None = None, side_effects: Callable | None = None) -> StreamingQuery:
        """A streaming query that looks at the log at each trigger and applies what is new.

        ``side_effects(events, ceiling)`` hears each page once it is stored; a page's ceiling names it when it is tried again.
        """

        def look(_: DataFrame, __: int) -> None:
            floor, ceiling = self.advance(projection, start, page)
            if side_effects and ceiling > floor:
                side_effects(self.log().where((F.col("sequence") > floor) & (F.col("sequence") <= ceiling)), ceiling)

        point = f"{self.root}/_checkpoints/{str(self.table(projection).shard).replace(':', '_')}"
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(look).option("checkpointLocation", point).trigger(processingTime=every).start()

    def wait_for_non_stale(self, projections: list, timeout: float = 30.0, poll: float = 0.25) -> None:
        """Returns when every shard has reached the highest sequence seen now; raises TimeoutError otherwise."""
        goal = self.log().agg(F.max("sequence")).first()[0] or 0
        end = time.monotonic() + timeout
        while behind := [p.name for p in projections if (self.table(p).progress() or {"sequence": 0})["sequence"] < goal]:
            if time.monotonic() >= end:
                raise TimeoutError(f"not at {goal} after {timeout} s: {', '.join(behind)}")
            time.sleep(poll)

    def rewind(self, projection: Projection, to: int) -> None:
        """Back to a sequence: the state up to it is folded anew."""
        self.water.pop(str(self.table(projection).shard), None)
        self.table(projection).write(projection.run(self.log().where(F.col("sequence") <= to)), to, -1)

    def subscribe(self, name: str, deliver: Callable[[DataFrame, int], None], start: StartAt = StartAt(), types: tuple[str, ...] = (), page: int | None = None) -> None:
        """Hands pages of events in order of sequence to ``deliver``, each once, and returns when the mark is reached.

        Progress is stored after each page; a page that failed is delivered again under the same ceiling.
        """
        table = ReadModelTable(self.spark, self.root, ShardName(f"sub_{name}"))
        floor = start.floor(self.log(), (table.progress() or {}).get("sequence"))
        mark = self.mark(floor, str(table.shard))
        while floor < mark:
            ceiling = mark if page is None else min(mark, floor + page)
            events = self.log().where((F.col("sequence") > floor) & (F.col("sequence") <= ceiling))
            deliver((events.where(F.col("event_type").isin(*types)) if types else events).orderBy("sequence"), ceiling)
            table.write(self.spark.range(0), ceiling, ceiling)
            floor = ceiling

    def fetch_latest(self, projection: Projection, slice_id: str) -> DataFrame:
        """The read model's row as of now: the stored state with newer events folded in, as the live fold gives it."""
        at, mine = self.table(projection).progress(), F.col("slice_id") == slice_id
        plain = isinstance(projection.fold, ClosedForm) and all(m.kind in ("sum", "count") for m in projection.fold.measures.values())
        if at is None or not plain:
            return projection.folded(projection.enriched(self.log()).where(mine))
        newer = projection.enriched(self.log().where(F.col("sequence") > at["sequence"])).where(mine)
        return resumed(self.table(projection).read().where(mine), projection.fold, newer)


class WarmUp:
    """A new version of a projection runs without side effects until it has passed the old one's mark."""

    def __init__(self, mark: int):
        self.mark, self.live = mark, False

    def side_effects_on(self, batch_highest: int) -> bool:
        self.live = self.live or batch_highest >= self.mark
        return self.live


class WriteCache:
    """States kept between writes, newest ``limit`` of them; each entry is taken once."""

    def __init__(self, limit: int = 0):
        self.limit, self.entries = limit, {}

    def put(self, key: tuple, state, version: int) -> None:
        if self.limit:
            self.entries.pop(key, None)
            self.entries[key] = (state, version)
            while len(self.entries) > self.limit:
                del self.entries[next(iter(self.entries))]

    def take(self, key: tuple):
        return self.entries.pop(key, None)
