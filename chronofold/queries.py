"""The registered queries of the event operators, each beside the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars
from .operators import documents, enrich, flat_table, fold, slicing, tags
from .operators.fold import ClosedForm, Measure
from .operators.patch import Patch
from .schema import adapted, table
from .sources import reads
from .streaming import lag as lags

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The adapted log in SQL.
EV = "e as (select event_id as sequence, user_id as stream_id, 't' || cast(user_id % 3 as varchar) as tenant_id, event_type, ts as timestamp, value, cast(json_extract_string(props, '$.k') as bigint) as k from events)"


def signup_fold() -> ClosedForm:
    """signup creates, purchase adds its value, error deletes, other types apply without effect."""
    return ClosedForm(create=("signup",), delete=("error",), measures={"total": Measure("sum", F.col("value"), ("purchase",)), "purchases": Measure("count", None, ("purchase",))})


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def money(c: str):
    return F.round(c, 4).alias(c)


def slices(spark, d):
    return slicing.by_stream(adapted(spark, d))


SIGNUP_SQL = """
d as (select *, max(case when event_type='error' then sequence end) over (partition by {key}) last_del from {src}),
s as (select *, min(case when event_type='signup' and sequence > coalesce(last_del,-1) then sequence end) over (partition by {key}) created from d),
f as (select {key}, cast(max(sequence) filter (where sequence >= created) as bigint) as last_sequence,
             round(coalesce(sum(value) filter (where sequence > created and event_type='purchase'), 0), 4) as total,
             cast(count(*) filter (where sequence > created and event_type='purchase') as bigint) as purchases
      from s where created is not null group by {key})"""
ONE = SIGNUP_SQL.format(key="stream_id", src="e")


# ---- reads ----------------------------------------------------------------------------------------------------


@query(f"with {EV}, v as (select *, row_number() over (order by sequence) as version from e where stream_id = 7) select sequence, cast(version as bigint) as version, event_type, value from v where version between 3 and 20")
def fetch_stream_window(spark, d):
    return reads.fetch_stream(adapted(spark, d), 7, version=20, from_version=3).select("sequence", "version", "event_type", "value")


@query(f"with {EV} select sequence, event_type from e where stream_id = 7 and timestamp <= (select min(timestamp) + (max(timestamp) - min(timestamp)) / 2 from e)")
def fetch_stream_until(spark, d):
    log = adapted(spark, d)
    ends = log.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).first()
    return reads.fetch_stream(log, 7, timestamp=ends["a"] + (ends["b"] - ends["a"]) / 2).select("sequence", "event_type")


@query(f"with {EV} select sequence, event_type, value from e where sequence = 42")
def load_event(spark, d):
    return reads.load_event(adapted(spark, d), 42, "sequence").select("sequence", "event_type", "value")


@query(f"with {EV} select tenant_id, stream_id, cast(count(*) as bigint) as version, min(timestamp) as created, max(timestamp) as last_timestamp from e group by all")
def stream_state(spark, d):
    return reads.stream_state(adapted(spark, d))


@query(f"with {EV} select sequence, stream_id, event_type from e where event_type = 'click' and tenant_id = 't1' order by sequence limit 50 offset 50")
def query_events_page(spark, d):
    return reads.query_events(adapted(spark, d), reads.EventQuery(event_type="click", tenant_id="t1", page=2))[0].select("sequence", "stream_id", "event_type")


@query(f"with {EV} select cast(count(*) as bigint) as total_count from e where event_type = 'click' and tenant_id = 't1'")
def query_events_total(spark, d):
    return reads.query_events(adapted(spark, d), reads.EventQuery(event_type="click", tenant_id="t1"))[1]


@query(f"with {EV} select tenant_id, stream_id, cast(count(*) as bigint) as version, max(timestamp) as last_timestamp from e group by all order by last_timestamp desc, tenant_id, stream_id limit 10")
def recent_streams(spark, d):
    return reads.recent_streams(adapted(spark, d), 10).select("tenant_id", "stream_id", "version", "last_timestamp")


@query(f"with {EV} select sequence, cast(row_number() over (order by sequence) as bigint) as version, event_type, timestamp from e where stream_id = 11")
def stream_records(spark, d):
    return reads.stream_records(adapted(spark, d), 11).drop("data")


@query(f"with {EV}, g as (select tenant_id, stream_id, cast(count(*) as bigint) as version from e group by all), t as (select distinct stream_id, 'type=' || event_type as t from e), a as (select stream_id, string_agg(t, ',' order by t) as tags from t group by stream_id) select tenant_id, g.stream_id, version, a.tags from g join a using (stream_id)")
def stream_metadata(spark, d):
    log = adapted(spark, d).withColumn("tags", F.filter("tags", lambda t: t["tag_type"] == "type"))
    return reads.stream_metadata(log).select("tenant_id", "stream_id", "version", F.array_join("tags", ",").alias("tags"))


@query(f"with {EV} select sequence, event_type from e where sequence > 100 and sequence <= 900 and event_type in ('click','error') order by sequence limit 120")
def event_page(spark, d):
    return reads.page(adapted(spark, d), 100, 900, 120, ["click", "error"]).select("sequence", "event_type")


@query(f"with {EV} select max(sequence) as sequence from e where tenant_id = 't2'")
def highest_sequence(spark, d):
    return reads.highest_sequence(adapted(spark, d), "t2")


@query(f"with {EV} select max(sequence) as sequence from e where timestamp < (select max(timestamp) from e)")
def floor_at_time(spark, d):
    log = adapted(spark, d)
    return reads.floor_at_time(log, log.agg(F.max("timestamp")).first()[0])


@query("select c_custkey, c_name from customer where c_custkey in (select distinct o_custkey from orders where o_orderpriority = '1-URGENT')")
def load_many(spark, d):
    wanted = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return reads.load_many(table(spark, d, "customer"), wanted, "c_custkey").select("c_custkey", "c_name")


@query("select c_custkey, c_name, c_acctbal from customer where c_custkey = 17")
def document_load(spark, d):
    return table(spark, d, "customer").where("c_custkey = 17").limit(1).select("c_custkey", "c_name", "c_acctbal")


# ---- tags -----------------------------------------------------------------------------------------------------


@query(f"with {EV} select sequence, event_type, k from e where k = 3 or (k = 5 and event_type in ('click', 'purchase'))")
def tag_query_or(spark, d):
    q = tags.TagQuery().or_tag("k", 3).for_tag("k", 5).and_events("click", "purchase")
    return tags.query_by_tags(adapted(spark, d), q).select("sequence", "event_type", "k")


@query(f"with {EV} select sequence, stream_id from e where k = 3 and event_type = 'click' and tenant_id = 't0'")
def tag_query_all(spark, d):
    return tags.query_by_all_tags(adapted(spark, d), {"k": 3, "type": "click"}, "t0").select("sequence", "stream_id")


@query(f"with {EV} select count(*) > 0 as found from e where k = 3")
def tags_exist(spark, d):
    return tags.events_exist(adapted(spark, d), tags.TagQuery().or_tag("k", 3))


@query(f"with {EV} select cast(count(*) as bigint) as events_applied, max(sequence) as version, round(sum(value), 4) as total from e where k = 3 and event_type = 'purchase'")
def aggregate_by_tags(spark, d):
    found = tags.query_by_all_tags(adapted(spark, d), {"k": 3, "type": "purchase"})
    return found.agg(F.count("*").alias("events_applied"), F.max("sequence").alias("version"), F.round(F.sum("value"), 4).alias("total"))


@query(f"with {EV} select sequence, case when event_type = 'purchase' and value > 50 then 3 else 2 end as n_tags from e")
def assign_tag_where(spark, d):
    tagged = tags.assign_tag_where(adapted(spark, d), (F.col("event_type") == "purchase") & (F.col("value") > 50), "size", "large", {"size"})
    return tags.assign_tag_where(tagged, F.col("event_type") == "none", "size", "large").select("sequence", F.size("tags").alias("n_tags"))


# ---- folds ----------------------------------------------------------------------------------------------------


@query(f"with {EV}, {ONE} select cast(stream_id as varchar) as stream_id, last_sequence, total, purchases from f")
def single_stream_fold(spark, d):
    return signup_fold().run(slices(spark, d)).select(F.col("slice_id").alias("stream_id"), "last_sequence", money("total"), "purchases")


@query(f"""with {EV}, l as (select cast(stream_id as varchar) as stream_id, list({{'t': event_type, 'v': value}} order by sequence) as es from e group by stream_id)
select stream_id, round(list_reduce(list_prepend(0.0, list_transform(es, lambda x: case when x.t = 'purchase' then x.v when x.t = 'error' then -1.0 else 0.0 end)),
       lambda a, x: case when x = -1.0 then case when a > 100 then 0.0 else a end else a + x end), 4) as total from l""")
def fold_should_delete_state(spark, d):
    def step(state, e):
        gone = (e["event_type"] == "error") & (state > 100)
        return F.when(gone, 0.0).when(e["event_type"] == "purchase", state + e["value"]).otherwise(state)

    made = fold.expression_fold(slices(spark, d), ["event_type", "value"], F.lit(0.0), step)
    return made.select(F.col("slice_id").alias("stream_id"), F.round("state", 4).alias("total"))


@query(f"""with {EV}, n as (select *, row_number() over (partition by stream_id order by sequence) as v from e), q as (select * from n where v <= 20),
{SIGNUP_SQL.format(key="stream_id", src="q")} select cast(stream_id as varchar) as stream_id, last_sequence, total, purchases from f""")
def as_of_version(spark, d):
    early = reads.numbered(adapted(spark, d)).where("version <= 20")
    return signup_fold().run(slicing.by_stream(early)).select(F.col("slice_id").alias("stream_id"), "last_sequence", money("total"), "purchases")


@query(f"""with {EV}, p as (select *, max(case when event_type='signup' then sequence end) over (partition by stream_id order by sequence) as su,
  max(case when event_type='error' then sequence end) over (partition by stream_id order by sequence rows between unbounded preceding and 1 preceding) as le from e),
b as (select stream_id, sequence, event_type, value, sum(case when event_type='error' then 1 else 0 end) over (partition by stream_id order by sequence rows between unbounded preceding and 1 preceding) as life0 from e),
l as (select *, coalesce(life0, 0) as life from b),
c as (select stream_id, life, min(sequence) filter (where event_type = 'signup') as created from l where event_type <> 'error' group by all),
m as (select stream_id, max(life) as life from c where created is not null group by stream_id)
select cast(l.stream_id as varchar) as stream_id, round(coalesce(sum(value) filter (where event_type='purchase' and sequence > created), 0), 4) as known_total
from l join c using (stream_id, life) join m using (stream_id, life) group by l.stream_id""")
def last_known(spark, d):
    return known_fold(spark, d).where("known_total is not null").select(F.col("slice_id").alias("stream_id"), F.round("known_total", 4).alias("known_total"))


def _total_handlers():
    return fold.Handlers(create={"signup": lambda e: {"total": 0.0, "purchases": 0}}, apply={"purchase": lambda s, e: {"total": s["total"] + e["value"], "purchases": s["purchases"] + 1}}, delete=("error",))


def known_fold(spark, d):
    rows = slices(spark, d).select("slice_tenant", "slice_id", "sequence", "ordinal", "event_type", "value")
    return fold.python_fold(rows, _total_handlers(), "total double, purchases long")


@query(f"with {EV}, {ONE} select cast(stream_id as varchar) as stream_id, total, purchases from f")
def python_fold(spark, d):
    return known_fold(spark, d).where("is_live").select(F.col("slice_id").alias("stream_id"), money("total"), "purchases")


@query(f"""with {EV}, l as (select *, sum(case when event_type='error' then 1 else 0 end) over (partition by stream_id order by sequence) as life from e),
a as (select sequence, stream_id, sum(case when event_type='purchase' then 1 else 0 end) over (partition by stream_id, life order by sequence rows unbounded preceding) as n from l)
select sequence, cast(stream_id as varchar) as stream_id, cast(coalesce(lag(n) over (partition by stream_id order by sequence), 0) as bigint) as purchases_before, cast(n as bigint) as purchases_after from a""")
def timeline(spark, d):
    f = ClosedForm(delete=("error",), measures={"purchases": Measure("count", None, ("purchase",))})
    out = fold.running(slices(spark, d), f)
    return out.select("sequence", F.col("slice_id").alias("stream_id"), F.col("purchases_before").cast("long").alias("purchases_before"), F.col("purchases_after").cast("long").alias("purchases_after"))


@query("""
with e as (select user_id u, event_id s, event_type t, value v from events where event_type <> 'view'),
d as (select *, coalesce(max(case when t='error'  then s end) over (partition by u), -1) ld from e),
l as (select * from d where s > ld),
m as (select *, coalesce(max(case when t='signup' then s end) over (partition by u), -1) lm from l)
select cast(u as varchar) as stream_id, round(sum(case when s=lm then v when s>lm and t='purchase' then v when s>lm and t='click' then -v else 0 end), 2) as a,
  case when max(s)=max(lm) then 'new' else 'old' end as status,
  cast(sum(case when s=lm then 1 when s>lm and t='purchase' then 1 when s>lm and t='click' then -1 else 0 end) as bigint) as revision
from m group by u""")
def flat_table_projection(spark, d):
    t = flat_table.FlatTable().map("signup", "A", F.col("value")).map("signup", "Revision", F.lit(1)).set_value("signup", "Status", "new")
    for kind, sign in (("purchase", 1), ("click", -1)):
        t.increment(kind, "A", F.col("value") * sign).increment(kind, "Revision", F.lit(sign)).set_value(kind, "Status", "old")
    out = t.delete("error").run(slices(spark, d))
    return out.select(F.col("slice_id").alias("stream_id"), F.round("a", 2).alias("a"), "status", F.col("revision").cast("long").alias("revision"))


@query(f"with {EV}, {ONE} select cast(stream_id as varchar) as stream_id, last_sequence, total, purchases from f")
def snapshot_resume(spark, d):
    """The fold of the first half as a snapshot, brought up to date with the second half."""
    all_ = slices(spark, d)
    half = all_.agg(F.expr("max(sequence) div 2")).first()[0]
    f = signup_fold()
    snapshot = f.run(all_.where(F.col("sequence") <= half))
    out = fold.resumed(snapshot, f, all_.where(F.col("sequence") > half))
    return out.select(F.col("slice_id").alias("stream_id"), "last_sequence", money("total"), "purchases")


@query(f"with {EV} select cast(stream_id as varchar) as stream_id, string_agg(event_type, ',' order by sequence) as types from e where event_type in ('error','signup') group by stream_id")
def ordered_collect(spark, d):
    f = ClosedForm(measures={"types": Measure("collect", F.col("event_type"), ("error", "signup"))}, relevant=("error", "signup"))
    return f.run(slices(spark, d)).select(F.col("slice_id").alias("stream_id"), F.array_join("types", ",").alias("types"))


# ---- slicing --------------------------------------------------------------------------------------------------

COUNT = "cast(count(*) as bigint) as n, round(sum(value), 4) as total"


def counted(sliced):
    return sliced.groupBy("slice_tenant", "slice_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"with {EV} select tenant_id as slice_tenant, cast(k as varchar) as slice_id, {COUNT} from e where k <> 0 and event_type in ('click','purchase') group by all")
def multi_stream_identity(spark, d):
    return counted(slicing.Slicer().identity(F.col("k"), "click", "purchase").slice(adapted(spark, d)))


@query(f"with {EV}, i as (select *, unnest(case when event_type = 'click' then ['k' || k, event_type, event_type] else [event_type] end) as slice_id from e), u as (select distinct tenant_id, slice_id, sequence, value from i) select tenant_id as slice_tenant, slice_id, {COUNT} from u group by all")
def identities_explode(spark, d):
    s = slicing.Slicer().identities(F.array(F.concat(F.lit("k"), F.col("k").cast("string")), F.col("event_type")), "click").identity(F.col("event_type"))
    return counted(s.slice(adapted(spark, d)))


@query(f"with {EV}, p as (select tenant_id, stream_id, sequence, value, -1 as ordinal from e union all select tenant_id, stream_id, sequence, i * 1.0, i from (select *, unnest(range(0, k % 3)) as i from e where event_type = 'purchase')) select tenant_id as slice_tenant, cast(stream_id as varchar) as slice_id, {COUNT}, cast(sum(ordinal) as bigint) as ordinals from p where stream_id <> 0 group by all")
def fan_out_children(spark, d):
    kids = F.filter(F.sequence(F.lit(0), F.col("k") % 3), lambda i: i < F.col("k") % 3)
    s = slicing.Slicer().identity(F.col("stream_id")).fan_out("purchase", kids, "item", {"value": lambda c: c.cast("double")}).slice(adapted(spark, d))
    return s.groupBy("slice_tenant", "slice_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.sum("ordinal").alias("ordinals"))


@query(f"with {EV}, p as (select tenant_id, sequence, i as child from (select *, unnest(range(1, k % 4 + 1)) as i from e where event_type = 'purchase')) select tenant_id as slice_tenant, cast(child as varchar) as slice_id, cast(count(*) as bigint) as n from p group by all")
def fan_out_before_grouping(spark, d):
    kids = F.filter(F.sequence(F.lit(1), F.col("k") % 4 + 1), lambda i: i <= F.col("k") % 4)
    s = slicing.Slicer().identity(F.col("k"), "item").fan_out("purchase", kids, "item", {"k": lambda c: c.cast("long")}, before_grouping=True)
    return s.slice(adapted(spark, d)).groupBy("slice_tenant", "slice_id").agg(F.count("*").alias("n"))


@query(f"with {EV} select tenant_id as slice_tenant, tenant_id as slice_id, {COUNT} from e group by all")
def tenant_rollup(spark, d):
    return counted(slicing.Slicer("rollup").slice(adapted(spark, d)))


@query(f"with {EV} select '*DEFAULT*' as slice_tenant, event_type as slice_id, {COUNT} from e group by all")
def across_tenants(spark, d):
    return counted(slicing.Slicer("across").identity(F.col("event_type")).slice(adapted(spark, d)))


@query("with j as (select e.event_id as sequence, c.c_mktsegment as slice_id, 't' || cast(user_id % 3 as varchar) as slice_tenant, value from events e join customer c on e.user_id = c.c_custkey) select slice_tenant, slice_id, cast(count(*) as bigint) as n, round(sum(value), 4) as total from j group by all")
def custom_grouping(spark, d):
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("stream_id"), F.col("c_mktsegment").alias("slice_id"))
    return counted(slicing.Slicer().custom(lambda e: e.join(keys, "stream_id")).slice(adapted(spark, d)).select("slice_tenant", "slice_id", "value"))


@query(f"with {EV} select '*' as slice_id, {COUNT} from e")
def ungrouped_slice(spark, d):
    return counted(slicing.ungrouped(adapted(spark, d))).drop("slice_tenant")


# ---- joins ----------------------------------------------------------------------------------------------------


@query("select o_orderkey, c_name, c_mktsegment from orders join customer on o_custkey = c_custkey")
def enrich_entity(spark, d):
    orders = table(spark, d, "orders").withColumn("event_type", F.lit("order"))
    out = enrich.enrich(orders, table(spark, d, "customer"), F.col("o_custkey"), "c_custkey", {"c_name": "c_name", "c_mktsegment": "c_mktsegment"}, ("order",))
    return out.where("c_name is not null").select("o_orderkey", "c_name", "c_mktsegment")


@query(f"with {EV}, i as (select distinct sequence, unnest([stream_id, k]) as id from e) select sequence, string_agg(c_name, ',' order by c_custkey) as names from i join customer on id = c_custkey group by sequence")
def enrich_many(spark, d):
    log = adapted(spark, d).select("sequence", "stream_id", "k")
    out = enrich.enrich_many(log, table(spark, d, "customer").select("c_custkey", "c_name"), F.array("stream_id", "k"), "c_custkey", "found")
    return out.where("found is not null").select("sequence", F.array_join(F.transform("found", lambda x: x["c_name"]), ",").alias("names"))


@query(f"with {EV} select sequence, c_name from e left join customer on stream_id = c_custkey and event_type in ('click', 'purchase')")
def enrich_by_type(spark, d):
    return enrich.enrich(adapted(spark, d), table(spark, d, "customer"), F.col("stream_id"), "c_custkey", {"c_name": "c_name"}, ("click", "purchase")).select("sequence", "c_name")


@query(f"with {EV} select sequence, c_acctbal as balance from e join customer on stream_id = c_custkey")
def add_references(spark, d):
    out = enrich.add_references(slices(spark, d), table(spark, d, "customer"), F.col("stream_id"), "c_custkey", "customer")
    return out.where("customer is not null").select("sequence", F.col("customer.c_acctbal").alias("balance"))


@query("with a as (select user_id, cast(count(*) as bigint) as clicks from events where event_type = 'click' group by 1), b as (select user_id, cast(count(*) as bigint) as views from events where event_type = 'view' group by 1) select cast(user_id as varchar) as slice_id, clicks, views from a join b using (user_id)")
def peer_view(spark, d):
    one = slices(spark, d).where("event_type = 'click'").groupBy("slice_id").agg(F.count("*").alias("clicks"))
    two = slices(spark, d).where("event_type = 'view'").groupBy("slice_id").agg(F.count("*").alias("views"))
    return enrich.peer_view(one, two, "slice_id")


# ---- documents ------------------------------------------------------------------------------------------------


@query("select c_custkey, c_name, c_mktsegment, c_acctbal from customer where c_acctbal > 100 and c_mktsegment in ('BUILDING','MACHINERY') order by c_mktsegment, c_acctbal desc, c_custkey limit 20 offset 10")
def document_where_order_page(spark, d):
    q = documents.Query(table(spark, d, "customer")).where(F.col("c_acctbal") > 100).is_one_of("c_mktsegment", ["BUILDING", "MACHINERY"])
    q = q.order_by("c_mktsegment").then_by("c_acctbal", True).then_by("c_custkey").skip(10).take(20)
    return q.frame().select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")


@query("select distinct c_mktsegment from customer where c_acctbal > 0")
def document_distinct_select(spark, d):
    return documents.Query(table(spark, d, "customer")).where(F.col("c_acctbal") > 0).select("c_mktsegment").distinct().frame()


@query("select c_custkey, c_acctbal from customer where c_nationkey = 3 order by c_acctbal desc, c_custkey limit 1")
def document_first(spark, d):
    q = documents.Query(table(spark, d, "customer")).where(F.col("c_nationkey") == 3).order_by("c_acctbal", True).then_by("c_custkey")
    return q.take(1).frame().select("c_custkey", "c_acctbal")


@query("select cast(count(*) as bigint) as n, count(*) > 0 as found from customer where c_mktsegment = 'BUILDING'")
def document_count_any(spark, d):
    return documents.Query(table(spark, d, "customer")).where(F.col("c_mktsegment") == "BUILDING").frame().agg(F.count("*").alias("n"), (F.count("*") > 0).alias("found"))


@query(f"with {EV}, r as (select *, row_number() over (partition by stream_id order by sequence desc) as rn from e) select stream_id, sequence, event_type, value from r where rn = 1")
def latest_wins(spark, d):
    return documents.latest_wins(adapted(spark, d).select("stream_id", "sequence", "event_type", "value"), ["stream_id"], F.col("sequence"))


@query(f"""with {EV}, r as (select *, row_number() over (partition by stream_id order by sequence desc) as rn from e), w as (select stream_id, value, event_type = 'error' as deleted from r where rn = 1)
select c_custkey, round(coalesce(value, c_acctbal), 4) as balance from customer left join w on stream_id = c_custkey where not coalesce(deleted, false)
union all select stream_id, round(value, 4) from w where not deleted and stream_id not in (select c_custkey from customer)""")
def document_upsert(spark, d):
    docs = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    writes = adapted(spark, d).select(F.col("stream_id").alias("c_custkey"), F.col("value").alias("balance"), "sequence", (F.col("event_type") == "error").alias("deleted"))
    return documents.upsert(docs, writes, "c_custkey", "sequence").select("c_custkey", money("balance"))


@query("select c_custkey from customer where not (c_acctbal < 0)")
def document_delete_where(spark, d):
    return documents.delete_where(table(spark, d, "customer"), F.col("c_acctbal") < 0).select("c_custkey")


@query("select c_custkey, round(c_acctbal + 5, 4) as balance, case when c_mktsegment = 'BUILDING' then 'BUILDING' else c_mktsegment || ',BUILDING' end as segments, c_name as label from customer")
def patch_increment_append(spark, d):
    doc = F.struct(F.col("c_acctbal").alias("balance"), F.array("c_mktsegment").alias("segments"), F.col("c_name").alias("name"), F.struct(F.lit(1).alias("x")).alias("inner"))
    p = Patch(doc).increment("balance", 5).append_if_missing("segments", "BUILDING").rename("name", "label").set("inner.y", 2).delete("inner.x")
    out = table(spark, d, "customer").select("c_custkey", p.column().alias("doc"))
    return out.select("c_custkey", F.round("doc.balance", 4).alias("balance"), F.array_join("doc.segments", ",").alias("segments"), "doc.label")


@query("select c_custkey, 'a,' || c_mktsegment || ',b' as inserted, 'b' as removed, 'k1=1,k2=' || c_nationkey as keys from customer")
def patch_collections(spark, d):
    doc = F.struct(F.array(F.col("c_mktsegment"), F.lit("b")).alias("xs"), F.array(F.lit("a"), F.lit("b"), F.lit("a")).alias("ys"), F.create_map(F.lit("k1"), F.lit(1)).alias("m"))
    p = Patch(doc).insert("xs", "a", 0).insert_if_missing("xs", "a", 0).remove("ys", "a").append_key("m", "k2", F.col("c_nationkey")).append_key_if_missing("m", "k1", 9)
    out = table(spark, d, "customer").select("c_custkey", p.column().alias("doc"))
    pairs = F.array_sort(F.transform(F.map_entries("doc.m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return out.select("c_custkey", F.array_join("doc.xs", ",").alias("inserted"), F.array_join("doc.ys", ",").alias("removed"), F.array_join(pairs, ",").alias("keys"))


# ---- projections ----------------------------------------------------------------------------------------------


@query("select event_id as id, 'buy' as kind, round(value, 4) as amount from events where event_type = 'purchase' union all select event_id, 'fault', 0 from events where event_type = 'error'")
def event_projection_union(spark, d):
    from .plans.projections import EventProjection

    p = EventProjection("audit").project("purchase", id=F.col("sequence"), kind=F.lit("buy"), amount=F.round("value", 4)).project("error", id=F.col("sequence"), kind=F.lit("fault"), amount=F.lit(0.0))
    return p.run(adapted(spark, d))


@query(f"with {EV}, {ONE}, g as (select stream_id % 3 as tenant, total from f) select 't' || cast(tenant as varchar) as slice_id, cast(count(*) as bigint) as accounts, round(sum(total), 4) as total from g group by tenant")
def composite_two_stage(spark, d):
    from .plans.projections import Composite, MultiStream, SingleStream

    stage1 = SingleStream("accounts", signup_fold())
    stage2 = MultiStream("tenants", slicing.Slicer("rollup"), ClosedForm(measures={"accounts": Measure("count", None, ("updated",)), "total": Measure("sum", F.col("state.total"), ("updated",))}), types=("updated",))
    out = Composite("totals").stage(stage1).stage(stage2).run(adapted(spark, d))["tenants"]
    return out.select("slice_id", "accounts", money("total"))


@query("with g as (select distinct l_orderkey as s from lineitem), l as (select s, lead(s) over (order by s) as nxt from g) select s as gap_after, nxt as resumes_at from l where nxt > s + 1")
def sequence_gaps(spark, d):
    """Over the order keys of all lines, which have gaps of their own."""
    from .streaming.highwater import gaps

    return gaps(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sequence")))


@query("with l as (select event_id, lead(event_id) over (order by event_id) as nxt from events) select coalesce(min(event_id) filter (where nxt > event_id + 1), max(event_id)) as mark, max(event_id) as highest from l")
def high_water(spark, d):
    from .streaming.highwater import high_water_mark

    return high_water_mark(adapted(spark, d))


@query("with m as (select 't' || cast(user_id % 3 as varchar) as tenant_id, max(event_id) as mark from events group by 1), p as (select 't0' as tenant_id, 100 as sequence union all select 't1', 10000000) select m.tenant_id, p.tenant_id is not null as has_row, cast(greatest(0, mark - coalesce(sequence, 0)) as bigint) as lag, p.tenant_id is not null and mark <= sequence as caught_up from m left join p using (tenant_id)")
def projection_lag(spark, d):
    marks = adapted(spark, d).groupBy("tenant_id").agg(F.max("sequence").alias("high_water"))
    progress = spark.sql("select * from values ('t0', 100L), ('t1', 10000000L) as p(tenant_id, sequence)")
    return lags.projection_lag(progress, marks).select("tenant_id", "has_row", "lag", "caught_up")


@query("select 'totals' as projection, 't' || cast(user_id % 3 as varchar) as tenant_id, cast(count(*) as bigint) as n from events where event_type = 'purchase' and value > 90 group by all")
def dead_letter_counts(spark, d):
    def fail(state, e):
        if e["value"] > 90:
            raise ValueError("too large")
        return state

    h = fold.Handlers(apply={"purchase": fail}, default=dict)
    rows = slices(spark, d).select("slice_tenant", "slice_id", "sequence", "ordinal", "event_type", "value")
    return lags.dead_letter_counts(fold.python_fold(rows, h, "x int", mode="errors").withColumn("projection", F.lit("totals")).withColumnRenamed("slice_tenant", "tenant_id"))


@query("select event_id as event_sequence, 'ValueError' as exception_type from events where event_type = 'purchase' and value > 90 order by event_id desc limit 10 offset 5")
def dead_letter_page(spark, d):
    from .streaming.sinks import dead_letters

    def fail(state, e):
        if e["value"] > 90:
            raise ValueError("too large")
        return state

    rows = slices(spark, d).select("slice_tenant", "slice_id", "sequence", "ordinal", "event_type", "value")
    letters = dead_letters(fold.python_fold(rows, fold.Handlers(apply={"purchase": fail}, default=dict), "x int", mode="errors"), "totals", "totals:All")
    return lags.dead_letter_page(letters, 5, 10).select("event_sequence", "exception_type")


@query("select event_id as sequence, case when event_type = 'signup' then '*****' else event_type end as body, case when event_type = 'signup' then 1 else 0 end as n_headers from events")
def masking(spark, d):
    from .sources.rewrites import Masking

    log = adapted(spark, d).select("sequence", "event_type", F.col("event_type").alias("data"), F.create_map().cast("map<string,string>").alias("headers"))
    out = Masking().rule("signup", lambda data: F.lit("*****")).header("masked", "yes").apply(log)
    return out.select("sequence", F.col("data").alias("body"), F.size("headers").alias("n_headers"))


@query(f"""with {EV}, n as (select *, row_number() over (partition by stream_id order by sequence) as version, count(*) over (partition by stream_id) as total from e)
select stream_id, cast(version as bigint) as version, case when version = least(10, total) then 'compacted' else event_type end as event_type,
       case when version = least(10, total) then round((select sum(m.value) from n m where m.stream_id = n.stream_id and m.version <= 10), 4) end as folded from n where version >= least(10, total)""")
def compact_prefix(spark, d):
    from .sources.rewrites import compact

    out = compact(reads.numbered(adapted(spark, d)), 10, lambda rows: rows.groupBy("tenant_id", "stream_id").agg(F.round(F.sum("value"), 4).alias("folded")))
    return out.select("stream_id", "version", "event_type", "folded")


@query(f"with {EV} select sequence, cast(row_number() over (partition by tenant_id, stream_id order by sequence) as bigint) as version from e")
def version_numbering(spark, d):
    return reads.numbered(adapted(spark, d)).select("sequence", "version")


# ---- scalars --------------------------------------------------------------------------------------------------

NAMES = ("OrderPlaced", "HTTPRequestSent", "TripStarted", "AEvent", "ItemV2Added", "shipped", "XML", "MeterReadByHTTP")


@query("with n(name) as (values " + ", ".join(f"('{n}')" for n in NAMES) + r") select name, replace(lower(regexp_replace(regexp_replace(name, '(\P{Ll})(\P{Ll}\p{Ll})', '\1 \2', 'g'), '(\p{Ll})(\P{Ll})', '\1 \2', 'g')), ' ', '_') as alias from n")
def event_type_alias(spark, d):
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, NAMES))).alias("name"))
    return names.select("name", scalars.event_type_alias(F.col("name")).alias("alias"))


@query("select c_custkey, md5(c_name) as hash, case when length(c_name) > 12 then substr(c_name, 1, 9) || '...' else c_name end as short, lower(c_mktsegment) like 'build%' as builds, upper(c_name) as tenant from customer")
def text_functions(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", scalars.text_hash(F.col("c_name")).alias("hash"), scalars.elide(F.col("c_name"), 12).alias("short"), scalars.starts_with_ignore_case(F.col("c_mktsegment"), F.lit("BUILD")).alias("builds"), scalars.tenant_style(F.col("c_name"), "upper").alias("tenant"))


@query("""with s as (select o_orderkey, list_transform(range(1, length(o_orderpriority) + 1), lambda i: ascii(substr(o_orderpriority, i, 1))) as bs from orders),
h as (select o_orderkey, list_reduce(list_prepend(cast(0 as bigint), list_transform(bs, lambda b: cast(b as bigint))), lambda a, b: (a * 31 + b) % 4294967296) as h from s)
select o_orderkey, cast(case when h >= 2147483648 then h - 4294967296 else h end as integer) as hash from h""")
def byte_hash(spark, d):
    return table(spark, d, "orders").select("o_orderkey", scalars.utf8_byte_hash(F.col("o_orderpriority")).alias("hash"))


@query("select event_id, case when day(ts) <= 15 then 'Before' when day(ts) >= 20 then 'After' else 'Overlap' end as relation from events")
def time_range(spark, d):
    day = F.dayofmonth("timestamp")
    return adapted(spark, d).select(F.col("sequence").alias("event_id"), scalars.time_range_compare(day, day, F.lit(15), F.lit(20)).alias("relation"))


@query("select * from (values ('30s', 30), ('5 minutes', 300), ('1:30', 5400), ('0130', 5400), ('2 days', 172800)) t(input, seconds)")
def duration_parse(spark, d):
    t = spark.range(1).select(F.explode(F.array(*map(F.lit, ("30s", "5 minutes", "1:30", "0130", "2 days")))).alias("input"))
    return t.select("input", scalars.duration_seconds(F.col("input")).cast("int").alias("seconds"))


@query("select page_id, url like 'https://%.example.net/%' or url like 'https://example.net/%' as secure_net, regexp_extract(url, '^[^:]+://([^/?#]*)', 1) as host from pages")
def uri_parts(spark, d):
    p = table(spark, d, "pages")
    host = F.regexp_extract("url", r"^[^:]+://([^/?#]*)", 1)
    return p.select("page_id", (scalars.uri_matches(F.col("url"), "https://") & (host.endswith(".example.net") | (host == "example.net"))).alias("secure_net"), host.alias("host"))


@query("""with u as (select o_orderkey, list_transform(range(1, length(o_orderpriority) + 1), lambda i: cast(ascii(substr(o_orderpriority, i, 1)) as bigint)) as us from orders),
p as (select o_orderkey, list_reduce(list_prepend(cast(5381 as bigint), us[1:-:2]), lambda a, b: xor((a * 33) % 4294967296, b)) as one,
             list_reduce(list_prepend(cast(5381 as bigint), us[2:-:2]), lambda a, b: xor((a * 33) % 4294967296, b)) as two from u),
h as (select o_orderkey, (one + (two * 1566083941) % 4294967296) % 4294967296 as h from p)
select o_orderkey, cast(case when h >= 2147483648 then h - 4294967296 else h end as integer) as hash from h""")
def stable_text_hash(spark, d):
    return table(spark, d, "orders").select("o_orderkey", scalars.stable_hash(F.col("o_orderpriority")).alias("hash"))


@query("select c_custkey, regexp_replace(c_name, '0', '_') as replaced, c_mktsegment || '|x' as parts, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) as title from customer")
def string_tools(spark, d):
    parts = scalars.delimited(F.concat(F.lit(" "), "c_mktsegment", F.lit(" , ,x,")))
    return table(spark, d, "customer").select("c_custkey", scalars.replace_first(F.col("c_name"), "0", "_").alias("replaced"), F.array_join(parts, "|").alias("parts"), scalars.capitalise(F.lower("c_mktsegment")).alias("title"))


# ---- graph ----------------------------------------------------------------------------------------------------


@query("select * from (values ('command', 'open', 'handler', 'opens'), ('handler', 'opens', 'event', 'opened'), ('event', 'opened', 'projection', 'account'), ('projection', 'account', 'read_model', 'accounts'), ('trigger', 'http', 'command', 'open')) t(from_kind, from_name, to_kind, to_name)")
def event_model_edges(spark, d):
    from .operators.graph import Slice, model

    s = Slice("open account", triggers=("http",), commands=("open",), handlers=("opens",), events=("opened",), projections=("account",), read_models=("accounts",))
    return model(spark, [s, s])[1]


# ---- the store ----


def _store(spark, d, **rest):
    """All events, appended to a store of its own in order of time and id."""
    import uuid

    from .checkpoint import shared_folder
    from .sources.store import EventStore

    log = adapted(spark, d)
    rows = log.select(F.lpad(F.col("sequence").cast("string"), 12, "0").alias("id"), F.col("stream_id").cast("string").alias("stream_id"), "tenant_id", "event_type",
                      F.to_json(F.struct("value", "k")).alias("data"), F.col("timestamp").cast("timestamp").alias("timestamp"))
    store = EventStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", **rest)
    store.append_frame(rows)
    return store


STORED = "n as (select event_id, cast(user_id as varchar) as stream_id, 't' || cast(user_id % 3 as varchar) as tenant_id, event_type, value, row_number() over (order by ts, event_id) as sequence, row_number() over (partition by user_id order by ts, event_id) as version from events)"


@query(f"with {STORED} select event_id, stream_id, sequence, version from n")
def store_bulk_append(spark, d):
    """Sequences and versions that a bulk append gives all events."""
    return _store(spark, d).events().select(F.col("id").cast("long").alias("event_id"), "stream_id", "sequence", "version")


@query(f"with {STORED}, m as (select *, max(version) over (partition by stream_id) as top from n) select stream_id, version, case when stream_id = '7' then 'compacted' else event_type end as event_type from m where stream_id <> '7' or version = top")
def store_compacted(spark, d):
    """A store after one stream has been compacted whole; its version stays."""
    store = _store(spark, d)
    total = F.to_json(F.struct(F.sum(F.get_json_object("data", "$.value").cast("double")).alias("value")))
    store.compact_stream("7", lambda rows: rows.groupBy("tenant_id", "stream_id").agg(total.alias("data")), tenant="t1")
    return store.events().select("stream_id", "version", "event_type")


@query(f"with {STORED}, s as (select stream_id, max(version) as version from n group by 1) select stream_id, cast(version + 2 as bigint) as version from s where stream_id in ('3', '8') union all select 'fresh', 1")
def store_append(spark, d):
    """Versions of the streams that a commit of three actions touched, one of them started."""
    from .sources.store import Action, Event

    store = _store(spark, d)
    made = store.append(Action("3", [Event("click", {}), Event("click", {})], "t0", expected=None), Action("8", [Event("click", {}), Event("click", {})], "t2"), Action("fresh", [Event("signup", {})], "t0", start=True))
    touched = made.select("tenant_id", "stream_id").distinct()
    return store.events().join(touched, ["tenant_id", "stream_id"], "left_semi").groupBy("stream_id").agg(F.max("version").alias("version"))


# ---- more of each kind ----------------------------------------------------------------------------------------


@query(f"with {EV} select stream_id, coalesce(bool_or(event_type = 'signup'), false) as has_signup, not coalesce(bool_or(event_type = 'error'), false) as no_error from e group by stream_id")
def event_presence(spark, d):
    any_of = lambda t: F.coalesce(F.bool_or(F.col("event_type") == t), F.lit(False))
    return adapted(spark, d).groupBy("stream_id").agg(any_of("signup").alias("has_signup"), (~any_of("error")).alias("no_error"))


@query(f"with {EV}, r as (select *, row_number() over (partition by tenant_id, k order by sequence desc) as rn from e where event_type in ('signup', 'purchase')) select tenant_id, cast(k as varchar) as natural_key, stream_id from r where rn = 1")
def natural_key_index(spark, d):
    from .plans.projections import natural_keys

    return natural_keys(adapted(spark, d), {"signup": F.col("k"), "purchase": F.col("k")})


@query("""with l as (select event_id, lead(event_id) over (order by event_id) as nxt from events), m as (select coalesce(min(event_id) filter (where nxt > event_id + 1), max(event_id)) as mark from l)
select 't' || cast(user_id % 3 as varchar) as tenant_id, coalesce(max(event_id) filter (where event_id <= (select mark from m)), 0) as mark, max(event_id) as highest from events group by 1""")
def high_water_by_tenant(spark, d):
    from .streaming.highwater import high_water_mark

    return high_water_mark(adapted(spark, d), "tenant_id")


@query("with g as (select distinct l_orderkey as s from lineitem), l as (select s, lead(s) over (order by s) as nxt from g) select coalesce(min(s) filter (where nxt > s + 1 and nxt > 500), max(s)) as mark, max(s) as highest from l")
def stale_gap_skip(spark, d):
    """Order keys of all lines as a sequence; gaps that resume up to 500 are stale."""
    from .streaming.highwater import high_water_mark

    return high_water_mark(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sequence")), skip_to=500)


@query(f"with {EV}, h as (select max(sequence) // 2 as half from e) select stream_id, event_type from e where sequence > (select half from h) and stream_id not in (select stream_id from e where sequence <= (select half from h))")
def streams_started(spark, d):
    """Appends after a point whose stream did not exist before it: the check of a stream's start, as an anti-join."""
    log = adapted(spark, d)
    half = log.agg(F.expr("max(sequence) div 2")).first()[0]
    return log.where(F.col("sequence") > half).join(log.where(F.col("sequence") <= half).select("stream_id").distinct(), "stream_id", "left_anti").select("stream_id", "event_type")


@query(f"with {EV} select sequence, stream_id = 7 as is_archived from e")
def archive_stream(spark, d):
    from .sources.rewrites import archive

    log = adapted(spark, d).withColumn("is_archived", F.lit(None).cast("boolean"))
    return archive(log, F.col("stream_id") == 7).select("sequence", "is_archived")


@query(f"with {EV} select sequence, event_type from e where stream_id % 5 <> 0")
def archived_filter(spark, d):
    return reads.visible(adapted(spark, d).withColumn("is_archived", F.col("stream_id") % 5 == 0)).select("sequence", "event_type")


@query(f"with {EV} select sequence, case when sequence = 77 then 'replaced' else event_type end as event_type, case when sequence = 77 then 'new' else cast(k as varchar) end as data from e")
def replace_event(spark, d):
    from .sources.rewrites import replace

    log = adapted(spark, d).select("sequence", "event_type", F.col("k").cast("string").alias("data"), F.create_map().cast("map<string,string>").alias("headers"))
    return replace(log, 77, "replaced", "new").select("sequence", "event_type", "data")


@query(f"with {EV} select sequence, coalesce('over ' || c_name, cast(k as varchar)) as data from e left join customer on c_custkey = sequence")
def overwrite_events(spark, d):
    from .sources.rewrites import overwrite

    none = F.create_map().cast("map<string,string>")
    log = adapted(spark, d).select("sequence", F.col("k").cast("string").alias("data"), none.alias("headers"))
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("sequence"), F.concat(F.lit("over "), "c_name").alias("data"), none.alias("headers"))
    return overwrite(log, new, "sequence").select("sequence", "data")


def _failing_handlers():
    """Purchases over 90 fail."""

    def buy(s, e):
        if e["value"] > 90:
            raise ValueError("too large")
        return {"total": s["total"] + e["value"], "purchases": s["purchases"] + 1}

    return fold.Handlers(create={"signup": lambda e: {"total": 0.0, "purchases": 0}}, apply={"purchase": buy}, delete=("error",))


def _failing(name):
    from .plans.projections import HandlerStream

    return HandlerStream(name, _failing_handlers(), "total double, purchases long")


@query(f"with {EV}, g as (select * from e where not (event_type = 'purchase' and value > 90)), {SIGNUP_SQL.format(key='stream_id', src='g')} select cast(stream_id as varchar) as stream_id, total, purchases from f")
def skip_and_reslice(spark, d):
    """Failing events are left out and the slices folded without them."""
    return _failing("skipping").run(adapted(spark, d)).select(F.col("slice_id").alias("stream_id"), money("total"), "purchases")


def _daemon(spark, d):
    import uuid

    from .checkpoint import shared_folder
    from .streaming.daemon import Daemon

    return Daemon(spark, lambda: adapted(spark, d), f"{shared_folder(spark)}/daemon-{uuid.uuid4().hex}")


@query(f"with {EV}, {ONE} select cast(stream_id as varchar) as stream_id, last_sequence, total, purchases from f")
def daemon_catch_up(spark, d):
    """The read model after pages up to the mark equals the fold of the whole log."""
    from .plans.projections import SingleStream

    daemon, p = _daemon(spark, d), SingleStream("totals", signup_fold())
    top = adapted(spark, d).agg(F.max("sequence")).first()[0] or 0
    daemon.catch_up(p, page=top // 3 + 1)
    return daemon.table(p).read().select(F.col("slice_id").alias("stream_id"), "last_sequence", money("total"), "purchases")


ALIVE = "s as (select *, coalesce(max(case when event_type = 'error' then sequence end) over (partition by stream_id order by sequence rows between unbounded preceding and 1 preceding), -1) as le, max(case when event_type = 'signup' then sequence end) over (partition by stream_id order by sequence rows between unbounded preceding and 1 preceding) as ls from e)"


@query(f"with {EV}, {ALIVE} select 'failing' as projection, tenant_id, sequence as event_sequence, 'ValueError' as exception_type, 'too large' as exception_message from s where event_type = 'purchase' and value > 90 and ls > le")
def daemon_dead_letters(spark, d):
    """What a caught-up shard has skipped, in pages, each event once."""
    daemon, p = _daemon(spark, d), _failing("failing")
    top = adapted(spark, d).agg(F.max("sequence")).first()[0] or 0
    daemon.catch_up(p, page=top // 2 + 1)
    return daemon.dead_letters(p).select("projection", "tenant_id", "event_sequence", "exception_type", "exception_message")


@query(f"with {EV}, {ONE}, g as (select stream_id % 3 as tenant, total from f) select 't' || cast(tenant as varchar) as slice_id, cast(count(*) as bigint) as accounts, round(sum(total), 4) as total from g group by tenant")
def daemon_composite(spark, d):
    """A composite's members through the daemon, in one pass over its stages."""
    from .plans.projections import Composite, MultiStream, SingleStream

    stage2 = MultiStream("tenants", slicing.Slicer("rollup"), ClosedForm(measures={"accounts": Measure("count", None, ("updated",)), "total": Measure("sum", F.col("state.total"), ("updated",))}), types=("updated",))
    daemon, p = _daemon(spark, d), Composite("totals").stage(SingleStream("accounts", signup_fold())).stage(stage2)
    daemon.catch_up(p)
    return daemon.table(p, "tenants").read().select("slice_id", "accounts", money("total"))


@query(f"with {EV}, {ONE} select cast(d.stream_id as varchar) as stream_id, cast(count(*) as bigint) as deletes from (select distinct stream_id from e) d left join f using (stream_id) where f.stream_id is null group by 1")
def derived_deletes(spark, d):
    """Streams whose state is gone, counted by a later stage from the events that the earlier one derives."""
    from .plans.projections import Composite, SingleStream

    gone = SingleStream("gone", ClosedForm(measures={"deletes": Measure("count", None, ("projection_deleted",))}), types=("projection_deleted",))
    out = Composite("both").stage(SingleStream("accounts", signup_fold())).stage(gone).run(adapted(spark, d))["gone"]
    return out.select(F.col("slice_id").alias("stream_id"), "deletes")


@query(f"with {EV}, {ONE} select e.sequence, f.total from e left join f using (stream_id) where event_type = 'click'")
def upstream_lookup(spark, d):
    """Clicks with the total that an earlier stage holds for their stream."""
    from .plans.projections import upstream

    view = signup_fold().run(slices(spark, d)).withColumn("total", F.round("total", 4))
    return upstream(slices(spark, d).where("event_type = 'click'"), view, F.col("slice_id"), {"up_total": "total"}).select("sequence", F.col("up_total").alias("total"))


@query(f"with {EV} select max(sequence) as last_sequence, round(sum(value) filter (where event_type = 'purchase'), 4) as total, cast(count(*) as bigint) as n from e where k = 3 or (k = 5 and event_type = 'click')")
def boundary_aggregate(spark, d):
    from .plans.projections import BoundaryAggregate

    q = tags.TagQuery().or_tag("k", 3).for_tag("k", 5).and_events("click")
    p = BoundaryAggregate("boundary", q, ClosedForm(measures={"total": Measure("sum", F.col("value"), ("purchase",)), "n": Measure("count")}))
    return p.run(adapted(spark, d)).select("last_sequence", money("total"), "n")


@query(f"with {EV} select stream_id, array_to_string(list_sort(list_intersect(list(distinct event_type), ['signup', 'error', 'click'])), ',') as types from e group by stream_id")
def shared_event_types(spark, d):
    found = adapted(spark, d).groupBy("stream_id").agg(F.collect_set("event_type").alias("types"))  # the few types
    return found.select("stream_id", F.array_join(scalars.shared_types(F.col("types"), ["signup", "error", "click"]), ",").alias("types"))


@query(f"""with {EV}, h as (select max(sequence) // 2 as half from e),
a as (select stream_id, round(sum(value), 4) as total, bool_or(event_type = 'error') as dead from e where sequence <= (select half from h) group by 1),
b as (select stream_id, round(sum(value), 4) as total, cast(count(*) as bigint) as n from e where event_type <> 'error' group by 1),
c as (select b.stream_id, b.total, case when b.n > 60 then 'StoreThenSoftDelete' when a.dead then 'UnDeleteAndStore' when a.total = b.total then 'Nothing' else 'Store' end as action from b left join a using (stream_id))
select cast(stream_id as varchar) as slice_id, action from c union all select cast(stream_id as varchar), 'HardDelete' from a where not dead and stream_id not in (select stream_id from b)""")
def action_types(spark, d):
    """What a sink does on the way from half a log's totals to those of the whole one without errors."""
    from .plans.projections import actions

    every = slices(spark, d)
    half = every.agg(F.expr("max(sequence) div 2")).first()[0]
    total = F.round(F.sum("value"), 4).alias("total")
    before = every.where(F.col("sequence") <= half).groupBy("slice_id").agg(total, F.bool_or(F.col("event_type") == "error").alias("is_deleted"))
    after = every.where("event_type <> 'error'").groupBy("slice_id").agg(total, F.count("*").alias("n"))
    acts = actions(before, after.drop("n"), ["slice_id"], hard=True)
    ending = actions(before, after.join(before.select("slice_id"), "slice_id", "left").select("slice_id", "total", "n"), ["slice_id"], ending=F.col("n") > 60, hard=True).where("action = 'StoreThenSoftDelete'").select("slice_id", F.col("action").alias("ends"))
    return acts.join(ending, "slice_id", "left").select("slice_id", F.coalesce("ends", "action").alias("action"))


@query(f"with {EV}, n as (select *, row_number() over (partition by stream_id order by sequence) as version from e) select cast(stream_id as varchar) as stream_id, round(sum(value), 4) as total, cast(count(*) as bigint) as n from n group by stream_id")
def fold_over_compacted(spark, d):
    """A log whose streams are compacted up to version 10 folds to the state of the whole log."""
    from .sources.rewrites import compact

    state = lambda rows: rows.groupBy("tenant_id", "stream_id").agg(F.sum("value").alias("c_total"), F.count("*").alias("c_n"))
    log = compact(reads.numbered(adapted(spark, d)), 10, state)
    f = ClosedForm(measures={"total": Measure("sum", F.col("value"), seed=F.col("c_total")), "n": Measure("count", seed=F.col("c_n"))})
    return f.run(slicing.by_stream(log)).select(F.col("slice_id").alias("stream_id"), money("total"), "n")


@query(f"with {EV}, p as (select stream_id, round(sum(case when event_type = 'purchase' then k % 3 end), 4) as items, cast(count(*) filter (where event_type <> 'signup') as bigint) as n from e group by 1) select cast(stream_id as varchar) as stream_id, cast(coalesce(items, 0) as bigint) as items from p")
def fan_out_ordinals(spark, d):
    """A flat table that a parent sets to 0 and each of its children adds 1 to, over all parents: the children count."""
    kids = F.filter(F.sequence(F.lit(0), F.col("k") % 3), lambda i: i < F.col("k") % 3)
    s = slicing.Slicer("across").identity(F.col("stream_id").cast("string")).fan_out("purchase", kids, "item").slice(adapted(spark, d).withColumn("stream_id", F.concat(F.lit("s"), "stream_id")))
    made = ClosedForm(measures={"items": Measure("count", None, ("item",))}).run(s)
    return made.select(F.expr("substring(slice_id, 2)").alias("stream_id"), "items")


@query(f"with {EV}, {ONE} select cast(stream_id as varchar) as slice_id, 'Store' as action from f union all select distinct cast(stream_id as varchar), 'Delete' from e where stream_id not in (select stream_id from f)")
def sink_actions(spark, d):
    from .plans.projections import actions

    every = slices(spark, d)
    before = ClosedForm(measures={"n": Measure("count")}).run(every)
    return actions(before, signup_fold().run(every)).select("slice_id", "action")


@query(f"with {EV} select tenant_id, event_type, {COUNT} from e group by rollup (tenant_id, event_type)")
def rollup_counts(spark, d):
    return adapted(spark, d).rollup("tenant_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"with {EV} (select distinct stream_id from e where event_type = 'click' intersect select stream_id from e where event_type = 'purchase') except select stream_id from e where event_type = 'error' and k = 1")
def set_operations(spark, d):
    log = adapted(spark, d)
    of = lambda t: log.where(F.col("event_type") == t).select("stream_id")
    return of("click").intersect(of("purchase")).subtract(log.where("event_type = 'error' and k = 1").select("stream_id"))


@query(f"with {EV} select date_trunc('hour', timestamp) as hour, event_type, {COUNT} from e group by all")
def tumbling_windows(spark, d):
    return adapted(spark, d).groupBy(F.window("timestamp", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


@query(f"with {EV}, g as (select *, case when timestamp < lag(timestamp) over w + interval 6 hour then 0 else 1 end as fresh from e window w as (partition by stream_id order by timestamp)), s as (select *, sum(fresh) over (partition by stream_id order by timestamp) as session from g) select stream_id, min(timestamp) as started, cast(count(*) as bigint) as n from s group by stream_id, session")
def session_windows(spark, d):
    return adapted(spark, d).groupBy("stream_id", F.session_window("timestamp", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("stream_id", F.col("w.start").alias("started"), "n")


@query(f"with {EV} select cast(k as varchar) as slice_id, max(sequence) as version, cast(count(*) as bigint) as n from e where event_type = 'click' and k > 0 group by k")
def multi_stream_version(spark, d):
    """A multi-stream read model's version is the sequence of its last event."""
    s = slicing.Slicer("across").identity(F.col("k"), "click").slice(adapted(spark, d))
    return ClosedForm(measures={"n": Measure("count")}).run(s).select("slice_id", F.col("last_sequence").alias("version"), "n")


@query("select event_id, event_id % 2 = 0 and event_type = 'click' as hit from events")
def predicate_algebra(spark, d):
    """Column predicates combine: all of some, any of some, none."""
    all_of = (F.col("sequence") % 2 == 0) & (F.col("event_type") == "click")
    return adapted(spark, d).select(F.col("sequence").alias("event_id"), all_of.alias("hit"))


@query(f"with {EV} select sequence, row_number() over (partition by stream_id order by sequence) = 1 as first_of_stream, cast(lead(sequence) over (partition by stream_id order by sequence) as bigint) as next_sequence from e")
def stream_neighbours(spark, d):
    w = Window.partitionBy("stream_id").orderBy("sequence")
    return adapted(spark, d).select("sequence", (F.row_number().over(w) == 1).alias("first_of_stream"), F.lead("sequence").over(w).alias("next_sequence"))
