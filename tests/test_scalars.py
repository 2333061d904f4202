from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from chronofold.functions import scalars as s
from chronofold.operators.patch import Patch
from chronofold.operators.tags import TagQuery
from chronofold.schema import EventTypeRegistry, alias, versioned


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_texts(spark):
    assert alias("HTTPRequestSent") == "http_request_sent" and alias("Sent", "nested", "OrderEvents") == "order_events.sent" and versioned("a", 2) == "a_v2"
    assert one(spark, s.capitalise(F.lit("the old HOUSE"))) == "The Old HOUSE"
    assert one(spark, s.camel_case(F.lit("HTTPRequest"))) == "httpRequest" and one(spark, s.camel_case(F.lit("Name"))) == "name"
    assert one(spark, s.replace_first(F.lit("a-b-c"), "-", "+")) == "a+b-c"
    assert one(spark, s.delimited(F.lit(" a, ,b ,"))) == ["a", "b"]
    assert one(spark, s.fill(F.array(F.lit(1), F.lit(1)), F.lit(1))) == [1, 1]
    assert one(spark, s.first_index(F.array(F.lit(1), F.lit(5)), lambda v: v > 4)) == 1 and one(spark, s.last_index(F.array(F.lit(5), F.lit(1)), lambda v: v > 4)) == 0
    assert one(spark, s.tenant_style(F.lit("*DEFAULT*"), "lower")) == "*DEFAULT*"
    assert one(spark, s.uri_matches(F.lit("rabbitmq://queue/one/two"), "rabbitmq://queue/*")) and not one(spark, s.uri_matches(F.lit("http://a/b"), "http://c"))


def test_hashes(spark):
    for text in ("", "a", "hello world", "é漢", "😀 smile", "ab\0cd", "z" * 90):
        assert one(spark, s.utf8_byte_hash(F.lit(text))) == s.byte_hash(text)
        assert one(spark, s.stable_hash(F.lit(text))) == s.paired_hash(text, 5381, True)
        assert one(spark, s.deterministic_hash(F.lit(text))) == s.paired_hash(text, (5381 << 16) + 5381, False)
    assert one(spark, s.stable_hash(F.lit(None).cast("string"))) is None
    assert s.byte_hash("ab") == 31 * 97 + 98 and -(1 << 31) <= s.byte_hash("z" * 99) < 1 << 31


def test_times(spark):
    at = datetime(2024, 5, 6, 7, 8, 9, 123000, tzinfo=timezone.utc)
    assert one(spark, s.comb_timestamp(F.lit(s.comb_guid(at)))).replace(tzinfo=timezone.utc) == at
    assert one(spark, s.duration_seconds(F.lit("5 minutes"))) == 300 and one(spark, s.duration_seconds(F.lit("12:30"))) == 45000 and one(spark, s.duration_seconds(F.lit("x"))) is None
    now = datetime(2024, 5, 8, 12, tzinfo=timezone.utc)
    assert s.relative_date("TODAY-3", now) == datetime(2024, 5, 5, tzinfo=timezone.utc) and s.relative_date("FRIDAY 08:30", now) == datetime(2024, 5, 10, 8, 30, tzinfo=timezone.utc)
    hull = s.time_range_merge(F.lit(1), F.lit(None).cast("int"), F.lit(0), F.lit(9))
    assert one(spark, hull[0]) == 0 and one(spark, hull[1]) is None
    assert one(spark, s.longer_than(F.lit(datetime(2024, 1, 1)), F.lit(datetime(2024, 1, 3)), timedelta(days=1)))


def test_registry_and_tag_queries():
    r = EventTypeRegistry()
    r.register("base", "x int")
    r.register("derived", "x int", ("base",))
    assert r.assignable("base") == ["base", "derived"] and r.depth("derived") == 1
    q = TagQuery().or_tag("a", 1).and_events("x").or_tag("b", 2)
    assert [(c.tag_type, c.event_types) for c in q.conditions] == [("a", ("x",)), ("b", ())] and not TagQuery().for_tag("a", 1).conditions
    assert TagQuery.from_dict(q.to_dict()).conditions == q.conditions


def test_patches(spark):
    doc = F.struct(F.array(F.lit(1), F.lit(2), F.lit(1)).alias("xs"), F.struct(F.lit("v").alias("a")).alias("in"), F.create_map(F.lit("k"), F.lit(1)).alias("m"))
    p = Patch(doc).remove("xs", 1, every=False).insert("xs", 9, 7).duplicate("in.a", "in.b", "top").rename("in.a", "c").append_key("m", "k", 5).remove_where("xs", lambda x: x == 9).remove_key("m", "z")
    got = one(spark, p.column())
    assert got["xs"] == [2, 1] and got["in"].asDict() == {"b": "v", "c": "v"} and got["m"] == {"k": 5} and got["top"] == "v"
