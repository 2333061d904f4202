import json

import pytest
from pyspark.sql import functions as F

from chronofold.operators.tags import TagQuery
from chronofold.schema import EventTypeRegistry
from chronofold.sources import reads
from chronofold.sources.rewrites import Masking
from chronofold.sources.store import Action, ConcurrencyError, DocumentStore, EmptyStreamError, Event, EventStore, ExistingStreamError, Session, UnexpectedVersionError


@pytest.fixture
def store(spark, tmp_path):
    registry = EventTypeRegistry()
    registry.register("meter_read", "reading int", tags={"site": "site"})
    registry.register_tag("site")
    registry.register_tag("size")
    return EventStore(spark, str(tmp_path / "log"), buckets=3, registry=registry)


def meter(*readings):
    return [Event("meter_read", {"reading": r, "site": "north"}) for r in readings]


def total(events):
    return events.groupBy("tenant_id", "stream_id").agg(F.to_json(F.struct(F.sum(F.get_json_object("data", "$.reading").cast("int")).alias("reading"))).alias("data"))


def test_append_and_read(store):
    store.append(Action("a", meter(1, 2), start=True), Action("b", meter(5)))
    store.append(Action("a", meter(3)))
    one = reads.fetch_stream(store.events(), "a").collect()
    assert [(r["version"], json.loads(r["data"])["reading"]) for r in one] == [(1, 1), (2, 2), (3, 3)]
    assert sorted(r["sequence"] for r in store.events().collect()) == [1, 2, 3, 4]
    assert one[0]["tags"][0]["value"] == "north"
    assert reads.fetch_stream(store.events(), "zz").count() == 0
    with pytest.raises(EmptyStreamError):
        store.append(Action("c", [], start=True))
    with pytest.raises(ExistingStreamError):
        store.append(Action("a", meter(1), start=True))
    with pytest.raises(UnexpectedVersionError):
        store.append(Action("a", meter(1), expected=1))


def test_tenants_are_apart(store):
    store.append(Action("a", meter(1), "t1"), Action("a", meter(2, 3), "t2"))
    state = {r["tenant_id"]: r["version"] for r in reads.stream_state(store.events()).collect()}
    assert state == {"t1": 1, "t2": 2}


def test_two_writers_from_one_base(store):
    store.append(Action("a", meter(1)))
    one, two = store.fetch_for_writing("a", total), store.fetch_for_writing("a")
    assert one.state.first()["data"] == '{"reading":1}' and one.current_version == 1
    one.append(*meter(2))
    one.save()
    two.append(*meter(9))
    with pytest.raises(UnexpectedVersionError):
        two.save()
    base = store.manifest()
    store.append(Action("b", meter(1)))
    with pytest.raises(ConcurrencyError):
        store._commit(base, base["folders"], base["highest"])


def test_boundary(store):
    store.append(Action("a", meter(1)))
    query = TagQuery().or_tag("site", "north")
    one, two = store.fetch_for_writing_by_tags(query, total), store.fetch_for_writing_by_tags(query)
    one.append("a", *meter(2))
    one.save()
    two.append("b", *meter(3))
    with pytest.raises(ConcurrencyError):
        two.save()
    with pytest.raises(ValueError, match="no tags"):
        two.append("b", Event("other", {}))
    with pytest.raises(ValueError, match="needs a condition"):
        store.fetch_for_writing_by_tags(TagQuery())


def test_rewrites(store):
    store.append(Action("a", meter(1, 2, 3)), Action("b", meter(7)))
    store.compact_stream("a", total, 2)
    store.compact_stream("a", total, 2)
    rows = [(r["event_type"], r["version"], r["data"]) for r in reads.fetch_stream(store.events(), "a").collect()]
    assert rows == [("compacted", 2, '{"reading":3}'), ("meter_read", 3, '{"reading": 3, "site": "north"}')]
    store.archive_stream("b")
    store.archive_stream("b")
    store.archive_stream("missing")
    assert reads.fetch_stream(store.events(), "b").count() == 0 and store.events().where("stream_id = 'b'").first()["is_archived"]
    store.assign_tag_where(F.col("stream_id") == "a", "size", "big")
    store.assign_tag_where(F.col("stream_id") == "a", "size", "big")
    assert all(sum(t["tag_type"] == "size" for t in r["tags"]) == 1 for r in store.events().where("stream_id = 'a'").collect())
    with pytest.raises(ValueError, match="not registered"):
        store.assign_tag_where(F.lit(True), "nope", 1)
    store.mask(Masking().rule("meter_read", lambda d: F.lit('"*****"')).header("masked", "1").include(F.col("stream_id") == "a"))
    masked = store.events().where("stream_id = 'a' and event_type = 'meter_read'").first()
    assert masked["data"] == '"*****"' and masked["headers"] == {"masked": "1"}
    store.replace_event(4, "meter_reset", {"x": 1})
    row = store.events().where("sequence = 4").first()
    assert row["event_type"] == "meter_reset" and row["headers"] is None and row["version"] == 1
    store.fill_gap([9])
    assert reads.highest_sequence(store.events()).first()[0] == 9 and reads.visible(store.events()).agg(F.max("sequence")).first()[0] == 3  # the stream at 4 is archived


def test_bulk_append_continues_versions(spark, store):
    store.append(Action("s0", meter(1)))
    rows = spark.range(200).selectExpr("concat('s', id % 7) as stream_id", "'tick' as event_type", "'{}' as data", "timestamp_seconds(id) as timestamp")
    store.append_frame(rows)
    state = {r["stream_id"]: r["version"] for r in reads.stream_state(store.events()).collect()}
    assert state["s0"] == 30 and state["s1"] == 29
    got = store.events().agg(F.count("*").alias("n"), F.max("sequence").alias("top"), F.countDistinct("sequence").alias("d")).first()
    assert tuple(got) == (201, 201, 201)


def test_session_and_documents(spark, store, tmp_path):
    docs = DocumentStore(spark, str(tmp_path / "docs"))
    session, heard = Session(store, docs), []
    session.listeners.append(heard.append)
    session.start_stream("a", *meter(1))
    session.append("a", *meter(2))
    session.save_document("widget", "1", {"w": 1})
    session.save_document("widget", "1", {"w": 2})
    session.save_document("widget", "2", {"w": 3})
    assert list(session.pending_streams) == ["a"] and docs.load("widget", "1") is None
    session.save()
    assert docs.load("widget", "1") == {"w": 2} and docs.load_many("widget", ["2", "2", "9"]) == {"2": {"w": 3}}
    assert not session.pending_streams and heard[0]["inserted"] == [("widget", "1"), ("widget", "2")] and not heard[0]["updated"]
    session.delete_document("widget", "1")
    session.save()
    assert docs.load("widget", "1") is None and heard[1]["deleted"] == [("widget", "1")]
    with pytest.raises(EmptyStreamError):
        session.start_stream("x")
