import random

import pytest
from pyspark.sql import functions as F

from chronofold.operators.fold import ClosedForm, Measure
from chronofold.operators.graph import topological
from chronofold.plans.projections import Composite, EventProjection, ProjectionGraph, SingleStream, actions
from chronofold.sources.reads import page_ceiling
from chronofold.streaming.daemon import Daemon, StartAt, WarmUp, WriteCache
from chronofold.streaming.highwater import HighWater, gaps, high_water_mark, merged
from chronofold.streaming.lag import ProgressOutOfOrder, ShardName, failure_category

DDL = "tenant_id string, stream_id string, sequence long, event_type string, value double"


def projection(name="totals", version=1):
    f = ClosedForm(create=("signup",), delete=("error",), measures={"total": Measure("sum", F.col("value"), ("purchase",)), "n": Measure("count", None, ("purchase",))})
    return SingleStream(name, f, version=version)


def write(spark, path, first, last, seed=1):
    rng = random.Random(seed)
    kinds = ["signup", "purchase", "purchase", "error"]
    rows = [("t", f"s{rng.randrange(5)}", i, rng.choice(kinds), float(rng.randrange(9))) for i in range(first, last)]
    spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(path)


def rows(df):
    return sorted((r["slice_id"], r["total"], r["n"], r["last_sequence"]) for r in df.collect())


def test_catch_up_equals_rebuild_and_live(spark, tmp_path):
    log = str(tmp_path / "log")
    daemon = Daemon(spark, log, str(tmp_path / "read"))
    for k in range(3):
        write(spark, log, k * 40 + 1, k * 40 + 41, k)
    p = projection()
    daemon.catch_up(p, page=30)
    write(spark, log, 121, 161, 9)
    latest = {s: rows(daemon.fetch_latest(p, s)) for s in ("s0", "s1")}
    daemon.catch_up(p)
    live = rows(p.run(daemon.log()))
    assert rows(daemon.table(p).read()) == live
    assert all(rows(p.run(daemon.log()).where(F.col("slice_id") == s)) == got for s, got in latest.items())
    other = projection("again")
    daemon.rebuild_all([other], 2)
    assert rows(daemon.table(other).read()) == live and daemon.table(other).progress()["sequence"] == 160
    daemon.rebuild(other, "t")
    assert rows(daemon.table(other).read()) == live
    daemon.rewind(p, 80)
    assert rows(daemon.table(p).read()) == rows(p.run(daemon.log().where("sequence <= 80")))
    daemon.catch_up(p)
    assert rows(daemon.table(p).read()) == live


def test_batches_apply_once_and_in_order(spark, tmp_path):
    log = str(tmp_path / "log")
    write(spark, log, 1, 60)
    daemon, p = Daemon(spark, log, str(tmp_path / "read")), projection()
    daemon.apply_batch(p, daemon.log().where("sequence <= 30"), 0, 0)
    before = rows(daemon.table(p).read())
    daemon.apply_batch(p, daemon.log().where("sequence <= 30"), 0)
    assert rows(daemon.table(p).read()) == before
    with pytest.raises(ProgressOutOfOrder):
        daemon.apply_batch(p, daemon.log(), 1, 5)
    daemon.apply_batch(p, daemon.log(), 1, 30)
    assert rows(daemon.table(p).read()) == rows(p.run(daemon.log()))


def test_subscription_delivers_each_event_once(spark, tmp_path):
    log, seen = str(tmp_path / "log"), []
    write(spark, log, 1, 30)
    daemon = Daemon(spark, log, str(tmp_path / "read"))
    deliver = lambda batch, _: seen.extend(r["sequence"] for r in batch.collect())
    daemon.subscribe("s", deliver, StartAt("sequence", 10))
    daemon.subscribe("s", deliver, StartAt("sequence", 10))
    assert seen == list(range(11, 30))
    assert StartAt("present").floor(daemon.log(), None) == 29 and StartAt("sequence", 5).floor(daemon.log(), 12) == 12


def test_high_water(spark):
    e = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 6, 9)], "sequence long")
    assert sorted(map(tuple, gaps(e, span=2).collect())) == [(3, 5), (6, 9)]
    assert tuple(high_water_mark(e).first()) == (3, 9) and high_water_mark(e, skip_to=5).first()["mark"] == 6
    t = e.withColumn("t", F.col("sequence") % 2)
    assert {r["t"]: r["mark"] for r in high_water_mark(t, "t", own=True).collect()} == {0: 2, 1: 1}
    h = HighWater()
    assert h.observe(3, 9, 0.0) == "Changed" and h.observe(3, 9, 1.0) == "Changed" and h.observe(3, 9, 4.0) == "Stale"
    h.skip(6, 4.0)
    assert (h.mark, h.skipped) == (6, 2) and h.observe(2, 6, 5.0) == "CaughtUp"
    assert merged({"a": 3, "b": 9}, {"a": 5, "b": 1}) == {"a": 5, "b": 9}


def test_names_pages_and_small_parts(spark):
    for text in ("orders:All", "orders:V3:All", "orders:All:t1", "orders:V2:east:t1"):
        assert str(ShardName.parse(text)) == text
    with pytest.raises(ValueError, match="shard"):
        ShardName.parse("x")
    assert page_ceiling([1, 2], 5, 99) == 99 and page_ceiling([1, 2, 3], 3, 99) == 3 and page_ceiling([], 3, 99, 0, 3, 7) == 7 and page_ceiling([], 3, 99, 8, 3, 7) == 99
    assert failure_category(ProgressOutOfOrder("x")) == "ProgressionOutOfOrder" and failure_category(ValueError()) == "Other"
    assert topological("abc", lambda x: {"a": "c", "b": "", "c": "b"}[x]) == ["b", "c", "a"]
    with pytest.raises(ValueError, match="cycle"):
        topological("ab", lambda x: {"a": "b", "b": "a"}[x])
    w = WarmUp(10)
    assert not w.side_effects_on(9) and w.side_effects_on(10) and w.side_effects_on(3)
    c = WriteCache(1)
    c.put(("a",), 1, 1)
    c.put(("b",), 2, 1)
    assert c.take(("a",)) is None and c.take(("b",)) == (2, 1) and c.take(("b",)) is None


def test_graph_and_actions(spark):
    g = ProjectionGraph()
    g.register(projection())
    g.register(Composite("c").stage(projection("inner")))
    assert g.find("inner").name == "inner"
    g.validate()
    with pytest.raises(ValueError, match="already"):
        g.register(projection())
    g.register(EventProjection("empty"))
    with pytest.raises(ValueError, match="no event type"):
        g.validate()
    ddl = "slice_tenant string, slice_id string, x int"
    before, after = spark.createDataFrame([("t", "a", 1), ("t", "b", 2)], ddl), spark.createDataFrame([("t", "b", 3)], ddl)
    assert sorted((r["slice_id"], r["action"]) for r in actions(before, after).collect()) == [("a", "Delete"), ("b", "Store")]
