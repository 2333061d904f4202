import pytest
from pyspark.sql import functions as F

from chronofold.operators import slicing
from chronofold.operators.fold import ClosedForm, Measure
from chronofold.plans.projections import SingleStream
from chronofold.scenario import Scenario
from chronofold.sources.store import Event, EventStore
from chronofold.streaming.sinks import SideEffects, project_latest, sink, write_once


def count_fold():
    return ClosedForm(measures={"n": Measure("count")})


def test_raised_events_and_messages(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "log"), buckets=2)
    log = spark.createDataFrame([("t", "a", 1, "x"), ("t", "a", 2, "x"), ("t", "b", 3, "x")], "tenant_id string, stream_id string, sequence long, event_type string")
    effects = SideEffects(F.col("n") > 1, "many", F.to_json(F.struct("n")), F.concat(F.lit("alerts-"), "slice_id"), F.col("n") == 1, F.lit("one"))
    run = sink(lambda batch, _: count_fold().run(slicing.by_stream(batch)), effects, store, str(tmp_path / "outbox"))
    run(log, 0)
    got = [(r["stream_id"], r["version"], r["data"]) for r in store.events().collect()]
    assert got == [("alerts-a", 1, '{"n":2}')]
    write_once(effects.messages(count_fold().run(slicing.by_stream(log))), str(tmp_path / "outbox"), 0)
    assert [r["slice_id"] for r in spark.read.parquet(str(tmp_path / "outbox")).collect()] == ["b"]
    pending = spark.createDataFrame([("t", "b", 1, "x")], log.schema)
    rows = {r["slice_id"]: (r["n"], r["last_sequence"]) for r in project_latest(SingleStream("c", count_fold()), log, pending).collect()}
    assert rows == {"a": (2, 2), "b": (2, 4)}


def test_scenario(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "log"), buckets=2)
    view = lambda e: count_fold().run(slicing.by_stream(e))
    Scenario(store).append("a", Event("x", {}), start=True).check("one", view, lambda r: r[0]["n"] == 1).play()
    with pytest.raises(AssertionError, match="step 1, none"):
        Scenario(store).check("none", view, lambda r: not r).play()
