"""Fold rules: all strategies, lifecycles and page cuts agree on random logs."""

import random

import pytest
from pyspark.sql import functions as F

from chronofold.operators import fold, slicing
from chronofold.operators.fold import ClosedForm, Handlers, Measure

DDL = "tenant_id string, stream_id string, sequence long, event_type string, value double"


def random_log(seed, n=150):
    rng = random.Random(seed)
    kinds = ["signup", "purchase", "purchase", "click", "error"]
    return [("t" + str(rng.randrange(2)), f"s{rng.randrange(6)}", i, rng.choice(kinds), float(rng.randrange(100))) for i in range(1, n + 1)]


def expected(log):
    state = {}
    for t, s, seq, kind, value in log:
        now = state.get((t, s))
        if kind == "error":
            state[(t, s)] = None
        elif now is None:
            state[(t, s)] = [0.0, 0, seq] if kind == "signup" else None
        else:
            state[(t, s)] = [now[0] + (value if kind == "purchase" else 0), now[1] + (kind == "purchase"), seq]
    return {k: (v[0], v[1], v[2]) for k, v in state.items() if v}


def closed():
    return ClosedForm(create=("signup",), delete=("error",), measures={"total": Measure("sum", F.col("value"), ("purchase",)), "n": Measure("count", None, ("purchase",))})


def found(df):
    return {(r["slice_tenant"], r["slice_id"]): (r["total"], r["n"], r["last_sequence"]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_strategies_agree(spark, seed):
    log = random_log(seed)
    rng = random.Random(seed)
    rows = log[:]
    rng.shuffle(rows)  # input order must not matter
    slices = slicing.by_stream(spark.createDataFrame(rows, DDL).repartition(rng.randrange(1, 6)))
    want = expected(log)
    assert found(closed().run(slices)) == want
    handlers = Handlers(create={"signup": lambda e: {"total": 0.0, "n": 0}}, apply={"purchase": lambda s, e: {"total": s["total"] + e["value"], "n": s["n"] + 1}}, delete=("error",))
    made = fold.python_fold(slices, handlers, "total double, n long").where("is_live")
    assert {k: v[:2] for k, v in found(made).items()} == {k: v[:2] for k, v in want.items()}
    for cut in (0, rng.randrange(150), 150):
        snapshot = closed().run(slices.where(F.col("sequence") <= cut))
        assert found(fold.resumed(snapshot, closed(), slices.where(F.col("sequence") > cut))) == want


def test_dispatch_prefers_derived_types_and_skips_errors(spark):
    def boom(state, e):
        raise ValueError("no")

    h = Handlers(apply={"base": lambda s, e: {"x": s["x"] + 1}, "derived": lambda s, e: {"x": s["x"] + 10}, "bad": boom, "gone": lambda s, e: None}, default=lambda: {"x": 0}, bases={"derived": ("base",), "other": ("base",)})
    log = [("t", "s", i, k, 0.0) for i, k in enumerate(["other", "derived", "bad", "base"], 1)]
    slices = slicing.by_stream(spark.createDataFrame(log, DDL))
    assert fold.python_fold(slices, h, "x int").first()["x"] == 12
    errors = fold.python_fold(slices, h, "x int", mode="errors").collect()
    assert [(r["sequence"], r["exception_type"]) for r in errors] == [(3, "ValueError")]
    steps = fold.python_fold(slices, h, "x int", mode="timeline").orderBy("sequence").collect()
    assert [r["after"] for r in steps] == ['{"x": 1}', '{"x": 11}', '{"x": 11}', '{"x": 12}'] and steps[2]["error"] == "no"
    with pytest.raises(Exception, match="ApplyEventError"):
        fold.python_fold(slices, h, "x int", on_error="fail").collect()
    gone = slicing.by_stream(spark.createDataFrame([*log, ("t", "s", 9, "gone", 0.0)], DDL))
    row = fold.python_fold(gone, h, "x int").first()
    assert row["x"] is None and not row["is_live"] and row["known_x"] == 12


def test_should_delete_reads_the_state():
    h = Handlers(create={"a": lambda e: {"x": e["value"]}}, apply={"b": lambda s, e: {"x": s["x"] + 1}}, should_delete={"b": lambda s, e: s["x"] > 5})
    assert h.step(None, {"event_type": "b", "value": 1}) is None
    assert h.step({"x": 9}, {"event_type": "b"}) is None and h.step({"x": 1}, {"event_type": "b"}) == {"x": 2}
    assert h.step({"x": 3}, {"event_type": "a", "value": 7}) == {"x": 3}
    with pytest.raises(ValueError, match="either"):
        Handlers(create={"a": lambda e: e}, evolve=lambda s, e: s)


def test_slicing_rules(spark):
    rows = [("t0", "s1", 1, "a", 1.0), ("t0", None, 2, "a", 1.0), ("t1", "0", 3, "b", 2.0), ("t1", "s1", 4, "b", 2.0)]
    e = spark.createDataFrame(rows, DDL)
    s = slicing.Slicer().identity(F.col("stream_id"), "a").identities(F.array("stream_id", "stream_id", F.lit("x")), "b").slice(e)
    assert sorted((r["slice_tenant"], r["slice_id"], r["sequence"]) for r in s.collect()) == [("t0", "s1", 1), ("t1", "s1", 4), ("t1", "x", 3), ("t1", "x", 4)]
    fanned = slicing.Slicer("across").identity(F.col("stream_id")).fan_out("b", F.array(F.lit(7.0), F.lit(8.0)), "kid", {"value": lambda c: c}).slice(e.where("sequence = 4"))
    assert [(r["event_type"], r["ordinal"], r["value"]) for r in fanned.orderBy("sequence", "ordinal").collect()] == [("b", -1, 2.0), ("kid", 0, 7.0), ("kid", 1, 8.0)]
    with pytest.raises(ValueError, match="needs identity"):
        slicing.Slicer().slice(e)
    with pytest.raises(ValueError, match="rollup"):
        slicing.Slicer("rollup").identity(F.col("stream_id")).slice(e)
