"""Operator 1: mix sources to target weights by Poisson replication.

A source's mean repetition rate is its share of the output times the output's size over the
source's own size, in characters. A document draws one number in [0, 1) from a hash of seed and id
and inverts the Poisson distribution with that mean: its count of copies is the number of cumulative
probabilities that do not exceed the draw. Copies are exploded and shuffled globally by a hash of
(seed, id, copy): dealt to partitions by it and sorted by it inside.

The draw depends on nothing but seed and id, so lost tasks repeat it. Only the table of sources is
joined, with integer sizes that do not depend on the order of summation; it is broadcast only if it
has at most ``BROADCAST_SOURCES`` rows and ``BROADCAST_CELLS`` probabilities, else the documents are dealt out by source with salt.
A null source is a source of its own; null or empty texts have size 0 and share their source's
rate; a source of total size 0 and a source without weight get no copies. Rows with the same
id get the same number of copies. ``copy_no``, ``n_copies`` and ``shuffle_key`` replace input
columns of these names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, fresh, table

SEED = "mix-1"
#: Without weights, a source's share goes with its size to this power.
TEMPERATURE = 0.5
#: The output's size over the input's.
EPOCHS = 1.0
BROADCAST_SOURCES = 100_000
#: Cumulative probabilities of all sources together, for the same.
BROADCAST_CELLS = 8_000_000
SALTS = 64


def uniform(seed: str, doc_id: Column) -> Column:
    """52 bits of md5 over seed and id as a number in [0, 1)."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def cumulative(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... far enough that what is left is under any draw's step."""
    last = (rate + 12 * F.sqrt(rate) + 40).cast("int")
    # the state holds ln k!'s part of ln P(k); summed from k = 0, so nothing underflows into a wrong start
    zero = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("total"), F.array(F.exp(-rate)).alias("out"))

    def step(state: Column, k: Column) -> Column:
        log_p = state["log_p"] + F.log(rate) - F.log(k.cast("double"))
        total = state["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.array_append(state["out"], total).alias("out"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), zero, step, lambda s: s["out"])).otherwise(F.array(F.lit(2.0)))


def rates(docs: DataFrame, weights: Mapping[str, float] | None, temperature: float, epochs: float, source: str, text: str) -> DataFrame:
    """One row per source: (mix_source__, rate). The sizes are checkpointed, so texts are read once for them."""
    size = F.coalesce(F.length(text), F.lit(0)).cast("long")
    sizes = checkpointed(docs.groupBy(F.col(source).alias("mix_source__")).agg(F.sum(size).alias("size")))
    if weights is None:
        share = F.pow(F.col("size").cast("double"), F.lit(temperature))
    else:
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("mix_source__") == name, float(weight)).otherwise(share)
    sizes = sizes.withColumn("share", F.when(F.col("size") > 0, share).otherwise(0.0))
    whole = sizes.agg(F.sum(F.round(F.col("share") * 1e6).cast("decimal(38,0)")).cast("double").alias("shares"), F.sum("size").alias("total"))
    rated = sizes.join(F.broadcast(whole), F.lit(True))  # one row
    rate = F.when((F.col("size") > 0) & (F.col("shares") > 0), F.round(F.col("share") * 1e6) / F.col("shares") * F.col("total") * epochs / F.col("size")).otherwise(0.0)
    return rated.select("mix_source__", rate.alias("rate"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = EPOCHS, seed: str = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text", names: tuple[str, str, str] = ("copy_no", "n_copies", "shuffle_key")) -> DataFrame:
    """``docs`` repeated to the target weights, plus copy_no (from 1), n_copies and shuffle_key under these ``names``."""
    copy_no, n_copies, shuffle_key = names
    docs = docs.drop(*names)
    its_source, its_cdf, salt = fresh(docs, "mix_source__", "mix_cdf__", "mix_salt__")
    rated = rates(docs, weights, temperature, epochs, source, text)
    seen = rated.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("rate") + 12 * F.sqrt("rate") + 42), F.lit(0.0)).alias("cells")).first()
    table_ = rated.select(F.col("mix_source__").alias(its_source), cumulative(F.col("rate")).alias(its_cdf))
    if seen["n"] <= BROADCAST_SOURCES and seen["cells"] <= BROADCAST_CELLS:
        joined = docs.join(F.broadcast(table_), F.col(source).eqNullSafe(F.col(its_source)))
    else:
        left = docs.withColumn(salt, F.pmod(F.xxhash64(doc_id), F.lit(SALTS)))
        right = table_.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        joined = left.join(right, F.col(source).eqNullSafe(F.col(its_source)) & (left[salt] == right[salt])).drop(left[salt]).drop(right[salt])
    drawn = uniform(seed, F.col(doc_id))
    count = F.transform(F.array(drawn), lambda u: F.size(F.filter(its_cdf, lambda c: c <= u)))[0].cast("long")  # the draw once per row
    copies = joined.withColumn(n_copies, count).drop(its_source, its_cdf).where(F.col(n_copies) > 0).withColumn(copy_no, F.explode(F.sequence(F.lit(1), F.col(n_copies))))
    return copies.withColumn(shuffle_key, F.md5(F.concat_ws("|", F.lit(f"{seed}|order"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(copy_no).cast("string")).cast("binary")))


def shuffle(mixed: DataFrame, key: str = "shuffle_key") -> DataFrame:
    """The global order: dealt by the key's hash, sorted by the key in each partition."""
    return mixed.repartition(key).sortWithinPartitions(key)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return shuffle(mix(docs))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mixture in its global order, with the columns of ``docs``, whatever their names."""
    names = fresh(docs, "copy_no", "n_copies", "shuffle_key")
    return shuffle(mix(docs, names=tuple(names)), names[2]).select(*docs.columns)


ORACLE_SQL = f"""
with recursive
z as (select source, cast(sum(coalesce(length(text), 0)) as bigint) as size from documents group by source),
w as (select source, size, round(case when size > 0 then pow(cast(size as double), {TEMPERATURE}) else 0 end * 1e6) as share from z),
t as (select cast(sum(cast(share as decimal(38,0))) as double) as shares, cast(sum(size) as double) as total from w),
r as (select source, case when size > 0 and shares > 0 then share / shares * total * {EPOCHS} / size else 0 end as rate from w, t),
c(source, rate, k, log_p, cdf) as (
  select source, rate, 0, -rate, exp(-rate) from r where rate > 0
  union all
  select source, rate, k + 1, log_p + ln(rate) - ln(k + 1), cdf + exp(log_p + ln(rate) - ln(k + 1)) from c where k < rate + 12 * sqrt(rate) + 40),
l as (select source, list(cdf) as cdfs from c group by source),
d as (select *, cast(('0x' || substr(md5('{SEED}|' || coalesce(cast(doc_id as varchar), '')), 1, 13)) as bigint) / {float(2**52)} as u from documents),
n as (select d.doc_id, d.text, d.lang, d.source, d.n_chars, cast(len(list_filter(l.cdfs, lambda x: x <= d.u)) as bigint) as n_copies
      from d join l on d.source is not distinct from l.source),
e as (select *, unnest(range(1, n_copies + 1)) as copy_no from n where n_copies > 0)
select doc_id, text, lang, source, n_chars, n_copies, copy_no,
       md5('{SEED}|order|' || coalesce(cast(doc_id as varchar), '') || '|' || cast(copy_no as varchar)) as shuffle_key
from e"""
