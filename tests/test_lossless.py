"""What a daemon, a fold and a store must not lose: late events, siblings, versions, documents, and what was raised once."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from chronofold.operators import slicing
from chronofold.operators.flat_table import FlatTable
from chronofold.operators.fold import ClosedForm, Handlers, Measure, python_fold
from chronofold.plans.projections import BoundaryAggregate, Composite, HandlerStream, MultiStream, SingleStream, actions, apply_actions, upstream
from chronofold.operators.tags import TagQuery
from chronofold.sources import reads
from chronofold.sources.store import Action, ConcurrencyError, DocumentStore, Event, EventStore, UnexpectedVersionError
from chronofold.streaming.daemon import Daemon, StartAt
from chronofold.streaming.highwater import gaps, high_water_mark
from chronofold.streaming.lag import ProgressOutOfOrder
from chronofold.streaming.sinks import SideEffects, sink

DDL = "tenant_id string, stream_id string, sequence long, event_type string, value double"


def count(**rest):
    return SingleStream("counts", ClosedForm(measures={"n": Measure("count"), "total": Measure("sum", F.col("value"))}), **rest)


def put(spark, path, sequences, tenant="t"):
    rows = [(tenant, f"s{i % 3}", i, "x", float(i)) for i in sequences]
    spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(path)


def state(df):
    return sorted(tuple(r) for r in df.select("slice_tenant", "slice_id", "n", "total").collect())


def test_interleaved_files_lose_nothing(spark, tmp_path):
    log = str(tmp_path / "log")
    put(spark, log, range(1, 101, 2))
    put(spark, log, range(2, 101, 2))
    daemon, p = Daemon(spark, log, str(tmp_path / "read")), count()
    daemon.catch_up(p, page=7 * 5)
    assert state(daemon.table(p).read()) == state(p.run(daemon.log())) and daemon.table(p).progress()["sequence"] == 100


def test_a_gap_that_fills_late_loses_nothing(spark, tmp_path):
    log = str(tmp_path / "log")
    put(spark, log, [1, 2, 4, 5])
    daemon, p = Daemon(spark, log, str(tmp_path / "read"), threshold=1000), count()
    daemon.catch_up(p)
    assert daemon.table(p).progress()["sequence"] == 2
    put(spark, log, [3])
    daemon.catch_up(p)
    assert state(daemon.table(p).read()) == state(p.run(daemon.log())) and daemon.table(p).progress()["sequence"] == 5


def test_a_stale_gap_is_skipped_and_counted(spark, tmp_path):
    log = str(tmp_path / "log")
    put(spark, log, [1, 2, 5, 6])
    daemon, p = Daemon(spark, log, str(tmp_path / "read"), threshold=3), count()
    assert daemon.advance(p, now=100.0) == (0, 2) and daemon.advance(p, now=102.0) == (2, 2) and daemon.advance(p, now=104.0) == (2, 6)
    assert daemon.table(p).progress()["skipped"] == 3 and state(daemon.table(p).read()) == state(p.run(daemon.log()))


def test_other_folds_take_up_pages(spark, tmp_path):
    log = str(tmp_path / "log")
    put(spark, log, range(1, 40))
    extreme = SingleStream("extremes", ClosedForm(measures={"most": Measure("max", F.col("value")), "all": Measure("collect", F.col("sequence"))}))
    flat = SingleStream("flat", FlatTable().map("x", "A", F.col("value")))
    daemon = Daemon(spark, log, str(tmp_path / "read"))
    for p in (extreme, flat):
        daemon.catch_up(p, page=9)
    put(spark, log, range(40, 45))
    latest = daemon.fetch_latest(extreme, "s1").first()
    assert latest["most"] == 43 and latest["all"] == list(range(1, 45, 3))
    for p in (extreme, flat):
        daemon.catch_up(p, page=2)
        assert sorted(map(tuple, daemon.table(p).read().select(*p.run(daemon.log()).columns).collect())) == sorted(map(tuple, p.run(daemon.log()).collect()))


def test_two_daemons_do_not_replace_each_other(spark, tmp_path):
    log = str(tmp_path / "log")
    put(spark, log, range(1, 9))
    one, two, p = Daemon(spark, log, str(tmp_path / "read")), Daemon(spark, log, str(tmp_path / "read")), count()
    one.apply_page(p, 0, 4)
    with pytest.raises(ProgressOutOfOrder):
        two.apply_page(p, 0, 8)
    two.apply_page(p, 4, 8)
    assert state(one.table(p).read()) == state(p.run(one.log()))


def test_tenants_rebuild_apart(spark, tmp_path):
    log = str(tmp_path / "log")
    put(spark, log, range(1, 20), "a")
    put(spark, log, range(20, 40), "b")
    daemon, p = Daemon(spark, log, str(tmp_path / "read")), count()
    daemon.rebuild(p)
    put(spark, log, range(40, 50), "b")
    put(spark, log, range(50, 60), "a")
    daemon.rebuild_tenants(p, ["b"], width=2)
    assert state(daemon.table(p).read()) == state(p.run(daemon.log().where("sequence < 50")))
    daemon.rebuild_tenants(p)
    assert state(daemon.table(p).read()) == state(p.run(daemon.log()))


def test_continuous_and_waiting(spark, tmp_path):
    log, heard = str(tmp_path / "log"), []
    put(spark, log, range(1, 10))
    daemon, p = Daemon(spark, log, str(tmp_path / "read")), count()
    with pytest.raises(TimeoutError, match="counts"):
        daemon.wait_for_non_stale([p], timeout=0)
    query = daemon.continuous(p, every="200 milliseconds", side_effects=lambda events, ceiling: heard.append((events.count(), ceiling)))
    try:
        daemon.wait_for_non_stale([p], timeout=60)
        put(spark, log, range(10, 14))
        daemon.wait_for_non_stale([p], timeout=60)
    finally:
        query.stop()
    assert state(daemon.table(p).read()) == state(p.run(daemon.log())) and sum(n for n, _ in heard) in (9, 13)


def failing():
    def fault(s, e):
        if e["value"] == 13:
            raise ValueError("reactor fault")
        return {"output": s["output"] + e["value"]}

    return HandlerStream("reactor", Handlers(create={"start": lambda e: {"output": 0.0}}, apply={"pulse": fault}), "output double")


def test_dead_letters(spark, tmp_path):
    rows = [("t", "r", 1, "start", 0.0), ("t", "r", 2, "pulse", 5.0), ("t", "r", 3, "pulse", 13.0), ("t", "r", 4, "pulse", 2.0), ("t", "q", 5, "start", 0.0), ("t", "q", 6, "pulse", 13.0), ("t", "r", 7, "pulse", 13.0)]
    daemon, p = Daemon(spark, lambda: spark.createDataFrame(rows, DDL), str(tmp_path / "read")), failing()
    daemon.catch_up(p, page=3)
    assert sorted((r["slice_id"], r["output"]) for r in daemon.table(p).read().collect()) == [("q", 0.0), ("r", 7.0)]
    letters = daemon.dead_letters(p).collect()
    assert sorted(r["event_sequence"] for r in letters) == [3, 6, 7] and {r["exception_message"] for r in letters} == {"reactor fault"}
    with pytest.raises(Exception, match="event (3|6) of"):
        daemon.rebuild(p)
    daemon.rebuild(p, on_error="skip")
    assert daemon.table(p).read().count() == 2


def test_composite_through_the_daemon(spark, tmp_path):
    log = str(tmp_path / "log")
    put(spark, log, range(1, 13))
    spark.createDataFrame([("t", "s1", 13, "end", 0.0)], DDL).write.mode("append").parquet(log)
    first = SingleStream("first", ClosedForm(delete=("end",), measures={"n": Measure("count")}))
    second = SingleStream("second", ClosedForm(measures={"n": Measure("sum", F.col("state.n"), ("updated",)), "gone": Measure("count", None, ("projection_deleted",))}), types=("updated", "projection_deleted"))
    c, daemon = Composite("c").stage(first).stage(second), Daemon(spark, log, str(tmp_path / "read"))
    daemon.catch_up(c)
    assert sorted((r["slice_id"], r["n"], r["gone"]) for r in daemon.table(c, "second").read().collect()) == [("s0", 4, 0), ("s1", 0, 1), ("s2", 4, 0)]
    daemon.rebuild(c)
    assert daemon.table(c).progress()["sequence"] == 13 and daemon.table(c, "first").read().count() == 2
    view = first.run(daemon.log())
    got = upstream(slicing.by_stream(daemon.log()), view, F.col("slice_id"), {"up": "n"}).groupBy("slice_id").agg(F.max("up").alias("up")).collect()
    assert {r["slice_id"]: r["up"] for r in got} == {"s0": 4, "s1": None, "s2": 4}


def fanned(spark):
    log = spark.createDataFrame([("t", "p", 1, "order", [1.0, 2.0, 3.0]), ("t", "p", 2, "note", None)], "tenant_id string, stream_id string, sequence long, event_type string, items array<double>").withColumn("value", F.lit(0.0))
    return slicing.Slicer().identity(F.col("stream_id")).fan_out("order", F.col("items"), "item", {"value": lambda c: c}).slice(log)


def test_folds_agree_on_fan_out(spark):
    s = fanned(spark)
    closed = ClosedForm(create=("order",), measures={"n": Measure("count"), "total": Measure("sum", F.col("value"))}).run(s).first()
    h = Handlers(create={"order": lambda e: {"n": 0, "total": 0.0}}, apply={k: lambda x, e: {"n": x["n"] + 1, "total": x["total"] + e["value"]} for k in ("item", "note")})
    plain = python_fold(s.select("slice_tenant", "slice_id", "sequence", "ordinal", "event_type", "value"), h, "n long, total double").first()
    assert (closed["n"], closed["total"]) == (plain["n"], plain["total"]) == (4, 6.0)
    flat = FlatTable().map("order", "Kids", F.lit(0)).increment("item", "Kids").set_value("order", "Last", "parent").set_value("item", "Last", "child").run(s).first()
    assert flat["kids"] == 3 and flat["last"] == "child"


def test_a_delete_among_siblings_counts_from_its_place(spark):
    log = spark.createDataFrame([("t", "p", 1, "order", ["add", "drop", "add"])], "tenant_id string, stream_id string, sequence long, event_type string, kinds array<string>")
    s = slicing.Slicer().identity(F.col("stream_id")).fan_out("order", F.col("kinds"), "child", {"event_type": lambda c: c}).slice(log)
    assert ClosedForm(delete=("drop",), measures={"n": Measure("count", None, ("add",))}).run(s).first()["n"] == 1


def meter(*readings):
    return [Event("read", {"reading": r}, timestamp=datetime(2024, 1, k + 1, tzinfo=timezone.utc)) for k, r in enumerate(readings)]


def total(events):
    reading = F.get_json_object("data", "$.reading").cast("int")
    return events.groupBy("tenant_id", "stream_id").agg(F.to_json(F.struct(F.sum(reading).alias("reading"))).alias("data"))


def test_compaction_keeps_every_stream(spark, tmp_path):
    store, seen = EventStore(spark, str(tmp_path / "log"), buckets=2), []
    store.append(Action("a", meter(1, 2, 3, 4)), Action("b", meter(9)))
    archiver = lambda gone, last: seen.append((gone.count(), last))
    store.compact_stream("a", total, before=datetime(2024, 1, 3, tzinfo=timezone.utc), archiver=archiver)
    store.compact_stream("a", total, before=datetime(2024, 1, 3, tzinfo=timezone.utc), archiver=archiver)
    rows = [(r["event_type"], r["version"], json.loads(r["data"])["reading"]) for r in reads.fetch_stream(store.events(), "a").collect()]
    assert rows == [("compacted", 2, 3), ("read", 3, 3), ("read", 4, 4)] and seen == [(2, 2)]
    store.compact_stream("b", lambda e: total(e).where("false"))
    left = store.events().where("stream_id = 'b'").collect()
    assert [(r["event_type"], r["version"], r["data"]) for r in left] == [("compacted", 1, "null")]
    reading = F.get_json_object("data", "$.reading").cast("int")
    f = ClosedForm(measures={"total": Measure("sum", reading, ("read",), seed=reading)})
    assert {r["slice_id"]: r["total"] for r in f.run(slicing.by_stream(store.events())).collect()} == {"a": 10, "b": 0}
    h = Handlers(default=lambda: {"reading": 0}, apply={"read": lambda s, e: {"reading": s["reading"] + json.loads(e["data"])["reading"]}})
    rows = slicing.by_stream(store.events()).select("slice_tenant", "slice_id", "sequence", "ordinal", "event_type", "data")
    assert {r["slice_id"]: r["reading"] for r in python_fold(rows, h, "reading long").where("is_live").collect()} == {"a": 10}


def test_documents_outlive_their_store(spark, tmp_path):
    one = DocumentStore(spark, str(tmp_path / "docs"))
    one.apply([("widget", "1", {"w": 1}), ("widget", "2", {"w": 2})])
    two = DocumentStore(spark, str(tmp_path / "docs"))
    assert two.load("widget", "2") == {"w": 2}
    base, _ = one._at("widget")
    two.delete_where("widget", F.col("id") == "1")
    assert one.load("widget", "1") is None and one.query("gadget").count() == 0
    with pytest.raises(ConcurrencyError):
        one._put("widget", base, one.query("widget"))


def test_a_batch_raises_its_events_once(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "log"), buckets=2)
    log = spark.createDataFrame([("t", "a", 1, "x", 0.0)], DDL)
    effects = SideEffects(F.col("n") > 0, "many", F.to_json(F.struct("n")), F.col("slice_id"))
    run = sink(lambda batch, _: ClosedForm(measures={"n": Measure("count")}).run(slicing.by_stream(batch)), effects, store, str(tmp_path / "outbox"))
    run(log, 4)
    run(log, 4)
    assert store.events().count() == 1
    run(log, 5)
    assert sorted(r["version"] for r in store.events().collect()) == [1, 2]


def test_inline_projections_commit_with_the_events(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "log"), buckets=4)
    reading = F.get_json_object("data", "$.reading").cast("int")
    store.register_inline(SingleStream("meters", ClosedForm(measures={"total": Measure("sum", reading, ("read",)), "most": Measure("max", reading, ("read",))})))
    store.register_inline(MultiStream("kinds", slicing.Slicer().identity(F.col("event_type")), ClosedForm(measures={"n": Measure("count")})))
    with pytest.raises(ValueError, match="inline already"):
        store.register_inline(SingleStream("meters", ClosedForm()))
    store.append(Action("a", meter(5, 1)), Action("b", meter(7)))
    store.append(Action("a", meter(2)))
    assert sorted((r["slice_id"], r["total"], r["most"]) for r in store.view("meters").collect()) == [("a", 8, 5), ("b", 7, 7)]
    assert [(r["slice_id"], r["n"]) for r in store.view("kinds").collect()] == [("read", 4)]
    with pytest.raises(UnexpectedVersionError):
        store.append(Action("a", meter(9), expected=1))
    assert store.view("kinds").first()["n"] == 4
    store.append(Action("b", [Event("archived", {})]))
    assert reads.fetch_stream(store.events(), "b").count() == 0 and reads.fetch_stream(store.events(), "a").count() == 3
    handle = store.fetch_for_writing("b", total)
    assert handle.starting_version == 2 and handle.state.count() == 0


def test_append_modes_and_exclusive_writers(spark, tmp_path):
    store, old = EventStore(spark, str(tmp_path / "log"), buckets=2), datetime(2020, 1, 1, tzinfo=timezone.utc)
    assert "version" in store.append(Action("a", [Event("x", {}, timestamp=old)])).columns
    assert "version" not in store.append(Action("a", [Event("x", {}, timestamp=old)]), mode="quick").columns
    store.append(Action("a", [Event("x", {}, timestamp=old)]), mode="quick_server")
    years = [r["timestamp"].year for r in reads.fetch_stream(store.events(), "a").collect()]
    assert years[:2] == [2020, 2020] and years[2] > 2020
    with pytest.raises(ValueError, match="append mode"):
        store.append(Action("a", [Event("x", {})]), mode="slow")
    held = store.append_exclusive("a", Event("x", {}))
    with pytest.raises(ConcurrencyError, match="held"):
        store.append_exclusive("a")
    with pytest.raises(ConcurrencyError, match="held"):
        store.append(Action("a", [Event("x", {})]))
    store.append(Action("b", [Event("x", {})]))
    held.save()
    one, two = store.append_optimistic("a", Event("x", {})), store.append_optimistic("a", Event("x", {}))
    one.save()
    with pytest.raises(UnexpectedVersionError):
        two.save()
    store.release(store.append_exclusive("a"))
    assert store.append(Action("a", [Event("x", {})])).first()["version"] == 6


def test_daemon_over_a_store(spark, tmp_path):
    store, seen = EventStore(spark, str(tmp_path / "log"), buckets=2), []
    store.append(Action("a", meter(1, 2)), Action("b", meter(9)))
    p = SingleStream("n", ClosedForm(measures={"n": Measure("count")}))
    daemon = Daemon(spark, store, str(tmp_path / "read"))
    daemon.catch_up(p)
    store.compact_stream("a", total)
    store.append(Action("b", meter(1)))
    daemon.catch_up(p)
    assert sorted((r["slice_id"], r["n"]) for r in daemon.table(p).read().collect()) == [("a", 2), ("b", 2)]
    deliver = lambda batch, _: seen.extend(r["sequence"] for r in batch.collect())
    daemon.subscribe("s", deliver, StartAt("sequence", 1), page=1)
    daemon.subscribe("s", deliver, StartAt("sequence", 1))
    assert seen == sorted(set(seen)) == [2, 3, 4]


def test_marks_by_tenant(spark):
    e = spark.createDataFrame([("a", 1), ("b", 2), ("a", 4), ("b", 5), ("c", 9)], "t string, sequence long")
    assert {r["t"]: (r["mark"], r["highest"]) for r in high_water_mark(e, "t").collect()} == {"a": (1, 4), "b": (2, 5), "c": (0, 9)}
    own = spark.createDataFrame([(t, i) for t, s in (("a", (1, 2, 3, 5)), ("b", (1, 2))) for i in s], "t string, sequence long")
    assert {r["t"]: r["mark"] for r in high_water_mark(own, "t", own=True, span=2).collect()} == {"a": 3, "b": 2}
    planted = spark.createDataFrame([(i,) for i in range(1, 400) if i % 97], "sequence long")
    assert sorted(map(tuple, gaps(planted, span=10).collect())) == [(k * 97 - 1, k * 97 + 1) for k in range(1, 5)]
    assert high_water_mark(planted).first()["mark"] == 96 and high_water_mark(planted, skip_to=200).first()["mark"] == 290


def test_actions_and_what_they_do(spark):
    ddl = "slice_tenant string, slice_id string, x int"
    before = spark.createDataFrame([("t", "same", 1, False), ("t", "new", 1, False), ("t", "back", 1, True), ("t", "gone", 1, False), ("t", "was", 1, True)], ddl + ", is_deleted boolean")
    after = spark.createDataFrame([("t", "same", 1), ("t", "new", 2), ("t", "back", 3), ("t", "ends", -1)], ddl)
    for hard in (False, True):
        acts = actions(before, after, ending=F.col("x") < 0, hard=hard)
        assert {r["slice_id"]: r["action"] for r in acts.collect()} == {"same": "Nothing", "new": "Store", "back": "UnDeleteAndStore", "ends": "StoreThenSoftDelete", "gone": "HardDelete" if hard else "Delete"}
        want = {"same": (1, False), "new": (2, False), "back": (3, False), "ends": (-1, True), "was": (1, True)} | ({} if hard else {"gone": (1, True)})
        assert {r["slice_id"]: (r["x"], r["is_deleted"]) for r in apply_actions(before, acts).collect()} == want


def test_small_parts(spark):
    import threading

    p = count(types=("x", "y"))
    assert p.filter_description()["event_types"] == ["x", "y"] and not p.matches_any_event() and p.reads_any_of("y", "z") and not p.reads_any_of("z") and count().reads_any_of("z")
    log = spark.createDataFrame([("t", "a", 1, "x", 1.0, [("k", "1")]), ("t", "b", 2, "x", 2.0, [("k", "2")]), ("u", "c", 3, "x", 4.0, [("k", "1")])], DDL + ", tags array<struct<tag_type:string,value:string>>")
    b = BoundaryAggregate("b", TagQuery().or_tag("k", 1), ClosedForm(measures={"total": Measure("sum", F.col("value"))}))
    assert b.run(log).first()["total"] == 5.0
    inside, most, lock = [0], [0], threading.Lock()

    def load(x):
        with lock:
            inside[0] += 1
            most[0] = max(most[0], inside[0])
        threading.Event().wait(0.02)
        with lock:
            inside[0] -= 1
        return x

    slow = reads.Throttled(load, 2)
    threads = [threading.Thread(target=slow, args=(k,)) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert most[0] == 2 and slow(7) == 7


def test_siblings_are_enriched_apart(spark):
    from chronofold.operators.enrich import enrich, enrich_many

    log = spark.createDataFrame([("t", "p", 1, "order", [3, 1])], "tenant_id string, stream_id string, sequence long, event_type string, parts array<int>").withColumn("part", F.lit(0))
    s = slicing.Slicer().identity(F.col("stream_id")).fan_out("order", F.col("parts"), "item", {"part": lambda c: c}).slice(log)
    parts = spark.createDataFrame([(1, "one"), (3, "three"), (3, "also three")], "id int, name string")
    got = {r["ordinal"]: [x["name"] for x in r["found"] or []] for r in enrich_many(s, parts, F.array("part"), "id", "found").collect()}
    assert got == {-1: [], 0: ["also three"], 1: ["one"]}
    assert sorted(r["n"] or "" for r in enrich(s, parts, F.col("part"), "id", {"n": "name"}).collect()) == ["", "also three", "one"]
