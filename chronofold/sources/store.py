"""An event store on a file system that Spark can reach: parquet buckets under numbered manifests.

The log is dealt into ``buckets`` by (tenant, stream). A manifest lists each bucket's folders. A commit
writes new folders, then creates manifest n + 1 without overwriting: of two writers with the same base
one fails and nothing of it is visible. Appends add folders; rewrites replace the folders of the
buckets they touch and leave the others alone. Manifests go through Spark's file system API, so
the root may be any store Spark reads; creation must be atomic there, as it is on HDFS and local disks.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..checkpoint import checkpointed
from ..operators.fold import KEYS
from ..plans.projections import Projection, SingleStream
from ..functions.scalars import comb_guid
from ..operators import tags as tagging
from ..schema import ARCHIVED, COMPACTED, DEFAULT_TENANT, EVENT_DDL, TOMBSTONE, TOMBSTONE_STREAM, EventTypeRegistry
from . import reads, rewrites


class EmptyStreamError(ValueError):
    """A stream was started without events."""


class ExistingStreamError(ValueError):
    """A stream was started that is there already."""


class UnexpectedVersionError(RuntimeError):
    """A stream is not at the version its writer expected."""


class ConcurrencyError(RuntimeError):
    """Another writer committed first, or newer events match a boundary."""


@dataclass
class Event:
    """An event to append; what is None is filled in."""

    event_type: str
    data: dict
    id: str | None = None
    timestamp: datetime | None = None
    causation_id: str | None = None
    correlation_id: str | None = None
    user_name: str | None = None
    headers: dict | None = None
    tags: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class Action:
    """Pending events of one stream."""

    stream_id: str
    events: list[Event]
    tenant_id: str = DEFAULT_TENANT
    start: bool = False
    expected: int | None = None
    aggregate_type: str | None = None


class EventStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 16, registry: EventTypeRegistry | None = None):
        self.spark, self.root, self.buckets, self.registry = spark, root.rstrip("/"), buckets, registry or EventTypeRegistry()
        self.schema = StructType.fromDDL(EVENT_DDL)
        self.inline: dict[str, Projection] = {}

    # ---- manifests ----

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def manifest(self) -> dict:
        """The latest manifest: number, buckets' folders, highest sequence."""
        fs, p = self._fs(f"{self.root}/_log")
        numbers = [int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")] if fs.exists(p) else []
        if not numbers:
            return {"n": 0, "folders": {}, "highest": 0}
        lines = self.spark.read.text(f"{self.root}/_log/{max(numbers):012d}.json", wholetext=True).first()[0]
        return json.loads(lines)

    def _commit(self, base: dict, folders: dict, highest: int, **more: dict) -> None:
        """``more``: entries of ``views`` and ``once`` that change with this commit."""
        made = {"n": base["n"] + 1, "folders": folders, "highest": highest} | {k: {**base.get(k, {}), **more.get(k, {})} for k in ("views", "once")}
        fs, p = self._fs(f"{self.root}/_log/{made['n']:012d}.json")
        try:
            stream = fs.create(p, False)
        except Exception as e:
            if "exists" in str(e).lower():
                raise ConcurrencyError(f"manifest {made['n']} was written by another writer") from e
            raise
        try:
            stream.write(bytearray(json.dumps(made).encode()))
        finally:
            stream.close()

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("tenant_id", "stream_id"), F.lit(self.buckets)).cast("int")

    def bucket_of(self, tenant: str, stream_id: str) -> int:
        """A stream's bucket, computed without reading any event."""
        one = self.spark.createDataFrame([(tenant, stream_id)], "tenant_id string, stream_id string")
        return one.select(self._bucket()).first()[0]

    def _write(self, events: DataFrame) -> dict[str, str]:
        """New folders by bucket, written in one job."""
        name = uuid.uuid4().hex
        folder = f"{self.root}/data/{name}"
        events.withColumn("bucket", self._bucket()).repartition("bucket").sortWithinPartitions("tenant_id", "stream_id", "version").write.partitionBy("bucket").parquet(folder)
        fs, p = self._fs(folder)
        return {s.getPath().getName().split("=")[1]: f"data/{name}/{s.getPath().getName()}" for s in fs.listStatus(p) if "=" in s.getPath().getName()}

    def events(self, manifest: dict | None = None, buckets: set[str] | None = None, archived: bool = True) -> DataFrame:
        """The whole log, or some buckets of it."""
        m = manifest or self.manifest()
        paths = [f"{self.root}/{f}" for b, fs in m["folders"].items() if buckets is None or b in buckets for f in fs]
        df = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        return df if archived else reads.visible(df)

    # ---- appends ----

    def append(self, *actions: Action, mode: str = "rich", check: Callable[[dict], None] | None = None, correlation: dict | None = None, lock: str | None = None) -> DataFrame:
        """Commits the actions together; versions and sequences follow what is stored. Returns the new events.

        mode ``rich``: times come from here where an event has none, and the rows returned are complete; ``quick``: the same times, but
        versions and sequences are left to the commit and not returned; ``quick_server``: all times are the commit's, whatever events say.
        Registered inline projections change in the same commit.
        """
        if mode not in ("rich", "quick", "quick_server"):
            raise ValueError(f"unknown append mode {mode}")
        base = self.manifest()
        for a in actions:
            self._check_lock(a.tenant_id, a.stream_id, lock)
        for a in actions:
            if a.start and not a.events:
                raise EmptyStreamError(a.stream_id)
        if check:
            check(base)
        current = self.versions([(a.tenant_id, a.stream_id) for a in actions], base)
        now, sequence, rows = datetime.now(timezone.utc), base["highest"], []
        for a in actions:
            at = current.get((a.tenant_id, a.stream_id), 0)
            if a.start and at:
                raise ExistingStreamError(a.stream_id)
            if a.expected is not None and at != a.expected:
                raise UnexpectedVersionError(f"{a.stream_id} is at {at}, not {a.expected}")
            for e in a.events:
                at, sequence = at + 1, sequence + 1
                when = now if mode == "quick_server" else e.timestamp or now
                headers = {k: str(v) for k, v in {**(e.headers or {}), **(correlation or {}).get("headers", {})}.items()}
                known = lambda own, key: own if own is not None else (correlation or {}).get(key)
                rows.append((
                    e.id or comb_guid(when), sequence, at, a.stream_id, e.event_type, None, json.dumps(e.data), None, when, a.tenant_id,
                    known(e.causation_id, "causation_id"), known(e.correlation_id, "correlation_id"), known(e.user_name, "user_name"), headers, [tuple(t) for t in e.tags], False, a.aggregate_type, False,
                ))
            current[(a.tenant_id, a.stream_id)] = at
        df = self.spark.createDataFrame(rows, self.schema)
        inferred = self.registry.inferred_tags(F.col("event_type"), F.col("data"))
        df = df.withColumn("tags", F.array_distinct(F.concat("tags", inferred)))
        if rows:
            self._add(base, df, sequence, views=self._inline(base, df))
            for tenant, stream in {(a.tenant_id, a.stream_id) for a in actions if any(e.event_type == ARCHIVED for e in a.events)}:
                if any(isinstance(p, SingleStream) for p in self.inline.values()):  # a projection that owns the stream archives it
                    self.archive_stream(stream, tenant)
        return df if mode == "rich" else df.drop("version", "sequence")

    # ---- inline projections ----

    def register_inline(self, projection: Projection) -> None:
        """From now on appends bring the projection's read model up to date in their own commit."""
        if projection.name in self.inline:
            raise ValueError(f"projection {projection.name} is inline already")
        self.inline[projection.name] = projection

    def view(self, name: str) -> DataFrame | None:
        """The read model of an inline projection as of the last commit."""
        folder = self.manifest().get("views", {}).get(name)
        return self.spark.read.parquet(f"{self.root}/{folder}") if folder else None

    def _inline(self, base: dict, new: DataFrame) -> dict[str, str]:
        """Folders of the read models after the new events; only the slices that these touch are folded, from their first event on.

        A single-stream projection reads the buckets of the streams concerned, others the whole log.
        """
        out = {}
        for name, p in self.inline.items():
            touched = p.sliced(p.filtered(new)).select(*KEYS).distinct()
            mine = {str(r["b"]) for r in new.select(self._bucket().alias("b")).distinct().collect()} if isinstance(p, SingleStream) else None
            every = self.events(base, mine).unionByName(new)
            rows = p.folded(p.enriched(every).join(touched, KEYS, "left_semi"))
            if old := base.get("views", {}).get(name):
                before = self.spark.read.parquet(f"{self.root}/{old}")
                rows = before.join(touched, KEYS, "left_anti").select(*before.columns).unionByName(rows.select(*before.columns))
            out[name] = f"views/{name}/{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.root}/{out[name]}")
        return out

    # ---- exclusive writers ----

    def _lock_path(self, tenant: str, stream_id: str) -> str:
        return f"{self.root}/_locks/{hashlib.sha256(f'{tenant}|{stream_id}'.encode()).hexdigest()}"

    def _check_lock(self, tenant: str, stream_id: str, lock: str | None) -> None:
        fs, p = self._fs(self._lock_path(tenant, stream_id))
        if fs.exists(p) and self.spark.read.text(str(p.toString()), wholetext=True).first()[0] != lock:
            raise ConcurrencyError(f"{stream_id} is held by another writer")

    def append_exclusive(self, stream_id: str, *events: Event, tenant: str = DEFAULT_TENANT, fold: Callable[[DataFrame], DataFrame] | None = None) -> WriteHandle:
        """A write handle that holds the stream until it is saved or released: meanwhile other appends to it fail."""
        token, (fs, p) = uuid.uuid4().hex, self._fs(self._lock_path(tenant, stream_id))
        try:
            stream = fs.create(p, False)
        except Exception as e:
            if "exists" in str(e).lower():
                raise ConcurrencyError(f"{stream_id} is held by another writer") from e
            raise
        try:
            stream.write(bytearray(token.encode()))
        finally:
            stream.close()
        handle = self.fetch_for_writing(stream_id, fold, tenant)
        handle.lock = token
        handle.append(*events)
        return handle

    def append_optimistic(self, stream_id: str, *events: Event, tenant: str = DEFAULT_TENANT) -> WriteHandle:
        """A write handle at the stream's version of now; saving fails if another writer came first."""
        handle = self.fetch_for_writing(stream_id, tenant=tenant)
        handle.append(*events)
        return handle

    def release(self, handle: WriteHandle) -> None:
        if handle.lock:
            fs, p = self._fs(self._lock_path(handle.tenant, handle.stream_id))
            fs.delete(p, False)
            handle.lock = None

    def append_frame(self, events: DataFrame, once: tuple[str, int] | None = None) -> None:
        """Bulk append of a DataFrame (stream_id, event_type, data, timestamp; optionally the rest), ordered by ``timestamp`` and ``id``.

        Versions are numbered per stream on top of what is stored; sequences by ranges of time, whose
        counts are known before rows are numbered, so no task orders the whole input. ``once``: a writer's name and the growing number of
        its batch, stored with the commit; a batch at or below the stored number is left out.
        """
        base = self.manifest()
        if once and base.get("once", {}).get(once[0], -1) >= once[1]:
            return
        rows = events
        for f in self.schema.fields:
            if f.name not in rows.columns:
                default = {"id": F.expr("uuid()"), "tenant_id": F.lit(DEFAULT_TENANT), "is_archived": F.lit(False), "is_skipped": F.lit(False)}.get(f.name, F.lit(None))
                rows = rows.withColumn(f.name, default.cast(f.dataType))
        # numbered rows must not change between the count and the write, so they are checkpointed
        rows = checkpointed(rows.repartitionByRange("timestamp", "id").sortWithinPartitions("timestamp", "id").withColumn("part__", F.spark_partition_id()))
        offset, offsets = base["highest"], {}
        for r in rows.groupBy("part__").count().orderBy("part__").collect():  # one row for each partition
            offsets[r["part__"]] = offset
            offset += r["count"]
        if not offsets:
            return
        start = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.col("part__"))
        inside = F.row_number().over(Window.partitionBy("part__").orderBy("timestamp", "id"))
        stored = self.events(base).groupBy("tenant_id", "stream_id").agg(F.max("version").alias("at__"))
        rows = rows.withColumn("sequence", (start + inside).cast("long")).drop("part__").join(stored, ["tenant_id", "stream_id"], "left")
        version = F.row_number().over(Window.partitionBy("tenant_id", "stream_id").orderBy("sequence")) + F.coalesce("at__", F.lit(0))
        self._add(base, rows.withColumn("version", version.cast("long")).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]), offset, once=dict([once]) if once else {})

    def _add(self, base: dict, df: DataFrame, highest: int, **more: dict) -> None:
        new = self._write(df)
        self._commit(base, {b: [*base["folders"].get(b, []), *([new[b]] if b in new else [])] for b in {*base["folders"], *new}}, highest, **more)

    def versions(self, streams: list[tuple[str, str]], base: dict | None = None) -> dict[tuple[str, str], int]:
        """Current versions of the streams named; only their buckets are read."""
        base = base or self.manifest()
        if not streams or not base["folders"]:
            return {}
        keys = self.spark.createDataFrame(sorted(set(streams)), "tenant_id string, stream_id string").withColumn("bucket", self._bucket())
        mine = {str(r["bucket"]) for r in keys.select("bucket").distinct().collect()}
        found = self.events(base, mine).join(F.broadcast(keys.drop("bucket")), ["tenant_id", "stream_id"]).groupBy("tenant_id", "stream_id").agg(F.max("version").alias("v"))
        return {(r["tenant_id"], r["stream_id"]): r["v"] for r in found.collect()}

    # ---- writing against a state ----

    def fetch_for_writing(self, stream_id: str, fold: Callable[[DataFrame], DataFrame] | None = None, tenant: str = DEFAULT_TENANT, expected: int | None = None, always_check: bool = False) -> WriteHandle:
        base = self.manifest()
        at = self.versions([(tenant, stream_id)], base).get((tenant, stream_id), 0)
        if expected is not None and at != expected:
            raise UnexpectedVersionError(f"{stream_id} is at {at}, not {expected}")
        mine = {str(self.bucket_of(tenant, stream_id))}
        state = fold(self.events(base, mine, archived=False).where((F.col("stream_id") == stream_id) & (F.col("tenant_id") == tenant))) if fold and at else None
        return WriteHandle(self, stream_id, tenant, at, state, always_check)

    def write_to_aggregate(self, stream_id: str, fold, decide: Callable[[WriteHandle], None], **rest) -> DataFrame:
        handle = self.fetch_for_writing(stream_id, fold, **rest)
        decide(handle)
        return handle.save()

    def fetch_for_writing_by_tags(self, query: tagging.TagQuery, fold: Callable[[DataFrame], DataFrame] | None = None) -> Boundary:
        """The events a tag query covers, and a writer that fails if newer ones match at commit."""
        found = self.events(archived=False).where(query.column())
        seen = found.agg(F.max("sequence").alias("s")).first()["s"] or 0
        return Boundary(self, query, seen, fold(found) if fold else None)

    # ---- rewrites ----

    def _rewrite(self, affected: Column, change: Callable[[DataFrame], DataFrame], stream: tuple[str, str] | None = None) -> None:
        """Replaces the buckets that hold affected events; of a rewrite of one ``stream`` (tenant, id) only its bucket is looked at."""
        base = self.manifest()
        own = {str(self.bucket_of(*stream))} if stream else None
        hit = self.events(base, own).where(affected).select(self._bucket().cast("string").alias("b")).distinct().collect()
        mine = {r["b"] for r in hit}
        if not mine:
            return
        new = self._write(change(self.events(base, mine)).select(*self.schema.names))
        self._commit(base, {b: ([new[b]] if b in new else []) if b in mine else fs for b, fs in base["folders"].items()}, base["highest"])

    def archive_stream(self, stream_id: str, tenant: str = DEFAULT_TENANT) -> None:
        mine = (F.col("stream_id") == stream_id) & (F.col("tenant_id") == tenant)
        self._rewrite(mine, lambda e: rewrites.archive(e, mine), (tenant, stream_id))

    def overwrite_event(self, event_id: str, data: dict, headers: dict | None = None) -> None:
        new = self.spark.createDataFrame([(event_id, json.dumps(data), headers or {})], "id string, data string, headers map<string,string>")
        self._rewrite(F.col("id") == event_id, lambda e: rewrites.overwrite(e, new))

    def replace_event(self, sequence: int, event_type: str, data: dict) -> None:
        self._rewrite(F.col("sequence") == sequence, lambda e: rewrites.replace(e, sequence, event_type, json.dumps(data)))

    def assign_tag_where(self, predicate: Column, tag_type: str, value) -> None:
        if tag_type not in self.registry.tag_types:
            raise ValueError(f"tag type {tag_type} is not registered")
        self._rewrite(predicate, lambda e: tagging.assign_tag_where(e, predicate, tag_type, value))

    def mask(self, masking: rewrites.Masking) -> None:
        self._rewrite(masking.selected(), masking.apply)

    def compact_stream(self, stream_id: str, fold: Callable[[DataFrame], DataFrame], version: int = 0, tenant: str = DEFAULT_TENANT, archiver: Callable[[DataFrame, int], None] | None = None, before: datetime | None = None) -> None:
        """``fold``: events to (tenant_id, stream_id, data) of the compaction event, whose data is ``null`` if it gives no row.

        Events up to ``version`` (0: all) and, if given, below the time ``before`` are folded. Versions stay; where only a
        compaction event is left nothing changes and the archiver is not called again.
        """
        mine, bucket = (F.col("stream_id") == stream_id) & (F.col("tenant_id") == tenant), {str(self.bucket_of(tenant, stream_id))}
        if before is not None:
            upto = self.events(buckets=bucket).where(mine & (F.col("timestamp") < F.lit(before))).agg(F.max("version")).first()[0]
            if not upto:
                return
            version = min(version, upto) if version else upto
        prefix = mine & (F.col("version") <= version) if version else mine
        gone = self.events(buckets=bucket).where(prefix)
        if not gone.where(F.col("event_type") != COMPACTED).limit(1).count():
            return
        if archiver:
            archiver(gone, gone.agg(F.max("sequence")).first()[0])
        keep, keys = self.schema.names, ["tenant_id", "stream_id"]

        def state(p: DataFrame) -> DataFrame:
            made = fold(p).select(*keys, F.col("data").alias("made__"))
            return p.select(*keys).distinct().join(made, keys, "left").select(*keys, F.coalesce("made__", F.lit("null")).alias("data__"))

        def change(e: DataFrame) -> DataFrame:
            return rewrites.compact(e, version, state, mine).withColumn("data", F.coalesce("data__", "data")).select(*keep)

        self._rewrite(mine, change, (tenant, stream_id))

    def fill_gap(self, sequences: list[int]) -> None:
        """Gap fillers for sequences that will never come; all reads leave them out."""
        base = self.manifest()
        now = datetime.now(timezone.utc)
        rows = [(str(uuid.uuid4()), s, s, TOMBSTONE_STREAM, TOMBSTONE, None, "{}", None, now, DEFAULT_TENANT, None, None, None, {}, [], False, None, False) for s in sequences]
        self._add(base, self.spark.createDataFrame(rows, self.schema), max([base["highest"], *sequences]))


@dataclass
class WriteHandle:
    """A stream's state and its pending events; ``save`` checks that the stream has not moved."""

    store: EventStore
    stream_id: str
    tenant: str
    starting_version: int
    state: DataFrame | None
    always_check: bool = False
    pending: list[Event] = field(default_factory=list)
    lock: str | None = None

    @property
    def current_version(self) -> int:
        return self.starting_version + len(self.pending)

    def append(self, *events: Event) -> None:
        self.pending += events

    def save(self) -> DataFrame | None:
        if self.pending:
            made = self.store.append(Action(self.stream_id, self.pending, self.tenant, expected=self.starting_version), lock=self.lock)
            self.starting_version, self.pending = self.current_version, []
            self.store.release(self)
            return made
        if self.always_check and self.store.versions([(self.tenant, self.stream_id)]).get((self.tenant, self.stream_id), 0) != self.starting_version:
            raise UnexpectedVersionError(self.stream_id)
        return None


@dataclass
class Boundary:
    """Events under a tag query; saving fails when newer ones match."""

    store: EventStore
    query: tagging.TagQuery
    seen: int
    state: DataFrame | None
    pending: list[Action] = field(default_factory=list)

    def append(self, stream_id: str, *events: Event, tenant: str = DEFAULT_TENANT) -> None:
        for e in events:
            known = self.store.registry.types.get(e.event_type)
            if not e.tags and not (known and known.tags):
                raise ValueError(f"no tags for {e.event_type}")
        self.pending.append(Action(stream_id, list(events), tenant))

    def save(self) -> DataFrame:
        def check(base: dict) -> None:
            newer = self.store.events(base, archived=False).where((F.col("sequence") > self.seen) & self.query.column())
            if newer.limit(1).count():
                raise ConcurrencyError("newer events match the boundary")

        return self.store.append(*self.pending, check=check)


class Session:
    """A unit of work: pending streams and documents, one commit, listeners after success only."""

    def __init__(self, store: EventStore, documents: DocumentStore | None = None, tenant: str = DEFAULT_TENANT):
        self.store, self.documents, self.tenant = store, documents, tenant
        self.pending_streams: dict[str, Action] = {}
        self.writes: list[tuple[str, str, dict | None]] = []
        self.listeners: list[Callable[[dict], None]] = []

    def start_stream(self, stream_id: str, *events: Event, aggregate_type: str | None = None) -> None:
        if not events:
            raise EmptyStreamError(stream_id)
        self.pending_streams[stream_id] = Action(stream_id, list(events), self.tenant, True, aggregate_type=aggregate_type)

    def append(self, stream_id: str, *events: Event, expected: int | None = None) -> None:
        action = self.pending_streams.setdefault(stream_id, Action(stream_id, [], self.tenant, expected=expected))
        action.events += events

    def save_document(self, kind: str, key: str, body: dict) -> None:
        self.writes.append((kind, key, body))

    def delete_document(self, kind: str, key: str) -> None:
        self.writes.append((kind, key, None))

    def save(self) -> None:
        """Events first, then documents; both are cleared, then listeners hear what was inserted, updated and deleted."""
        kinds = {k for k, _, _ in self.writes}
        known = {k: set(self.documents.load_many(k, [i for kind, i, _ in self.writes if kind == k])) for k in kinds}
        if self.pending_streams:
            self.store.append(*self.pending_streams.values())
        if self.writes:
            self.documents.apply(self.writes)
        last = {(k, i): b for k, i, b in self.writes}
        report = {"streams": list(self.pending_streams), "inserted": [k for k, b in last.items() if b is not None and k[1] not in known[k[0]]], "updated": [k for k, b in last.items() if b is not None and k[1] in known[k[0]]], "deleted": [k for k, b in last.items() if b is None]}
        self.pending_streams, self.writes = {}, []
        for listener in self.listeners:
            listener(report)


class DocumentStore:
    """Documents by kind and id as JSON; each save writes a new version of the kinds it touches.

    A kind's versions are numbered files that name a folder and are created without overwriting: a store that is
    opened again reads the last one, and of two writers with the same base one fails.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _at(self, kind: str) -> tuple[int, str | None]:
        """(number, folder) of a kind's last version; 0 and None before the first."""
        fs, p = self._fs(f"{self.root}/{kind}/_versions")
        names = sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []
        names = [n for n in names if n.endswith(".txt")]
        return (int(names[-1].split(".")[0]), self.spark.read.text(f"{self.root}/{kind}/_versions/{names[-1]}", wholetext=True).first()[0]) if names else (0, None)

    def _put(self, kind: str, base: int, rows: DataFrame) -> None:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/{kind}/{name}")
        fs, p = self._fs(f"{self.root}/{kind}/_versions/{base + 1:012d}.txt")
        try:
            stream = fs.create(p, False)
        except Exception as e:
            if "exists" in str(e).lower():
                raise ConcurrencyError(f"{kind} was saved by another writer") from e
            raise
        try:
            stream.write(bytearray(name.encode()))
        finally:
            stream.close()

    def query(self, kind: str) -> DataFrame:
        _, folder = self._at(kind)
        if folder is None:
            return self.spark.createDataFrame([], "id string, body string")
        return self.spark.read.parquet(f"{self.root}/{kind}/{folder}")

    def load(self, kind: str, key: str) -> dict | None:
        row = self.query(kind).where(F.col("id") == key).limit(1).collect()
        return json.loads(row[0]["body"]) if row else None

    def load_many(self, kind: str, keys: list[str]) -> dict[str, dict]:
        wanted = self.spark.createDataFrame([(k,) for k in sorted(set(keys))], "id string")
        return {r["id"]: json.loads(r["body"]) for r in reads.load_many(self.query(kind), wanted, "id").collect()}

    def apply(self, writes: list[tuple[str, str, dict | None]]) -> None:
        from ..operators.documents import upsert

        for kind in {k for k, _, _ in writes}:
            rows = [(key, json.dumps(body), body is None, n) for n, (k, key, body) in enumerate(writes) if k == kind]
            new = self.spark.createDataFrame(rows, "id string, body string, deleted boolean, n int")
            base, _ = self._at(kind)
            self._put(kind, base, upsert(self.query(kind), new, "id", "n"))

    def delete_where(self, kind: str, predicate: Column) -> None:
        from ..operators.documents import delete_where

        base, _ = self._at(kind)
        self._put(kind, base, delete_where(self.query(kind), predicate))
