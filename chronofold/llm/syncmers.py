"""Operator 5: document fingerprints from closed syncmers, in DataFrame functions only.

A text of any length is read as *units*, pieces of runs of characters other than white space. A unit ends at the run's end, or with a
character of ``CUT``; where neither follows within ``REACH`` characters, one character is a unit. So where units are cut
depends on the ``REACH`` characters around only, wherever a run began, and no text is one endless unit. Characters of scripts
that write no spaces are all in ``CUT``. ``K - 1`` empty units stand before the first unit and after the last one.
Of all k-mers (K units in a row) those are kept whose smallest s-mer, by a 64-bit hash, is the first or the last one
inside: a choice that depends on nothing outside the k-mer and those characters, so what two texts share
yields the same anchors wherever it stands. Of any ``K - S`` neighbouring k-mers one at least is kept, so every
text with a unit has an anchor, and texts that begin alike share anchors however short they are.

A fingerprint is the 32-bit hashes of all kept k-mers in order, beside their positions: the number of the
k-mer's first unit, negative where it begins with empty ones. Likeness matches anchors by order: the distinct anchors that two
texts share stand in a row in either text; ``linked`` counts those that follow the same one in both rows, and the
first; likeness is twice that number over the sum of both numbers of distinct anchors. Two empty fingerprints are alike in full.

The next document in ascending order of (doc_id, hash of text) comes from a window over ranges:
quantiles cut the ids into ranges of about ``RANGE_ROWS`` rows, an id that fills several ranges (and the null id) is cut further by the
hash, and beyond ``RANGES`` ranges each is cut again by quantiles of its own, so a task's share does not grow with the table. The first row of each
range is also sent to the end of the range before it (of the first one to the last). Texts are shuffled once, and
fingerprints are made behind that shuffle.

Null texts are empty. Null ids come first. Rows that share id and text follow each other (all in one range); the
only row of a table is its own next. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Characters that end a unit: some letters and digits, ASCII marks, and all from U+0700 on (most scripts without spaces, and all of East Asia).
CUT, REACH = r"[ioIO37!-/:-@\[-`{-~\x{700}-\x{10FFFF}]", 16
UNITS = rf"\S{{0,{REACH - 1}}}?{CUT}|\S{{1,{REACH}}}(?!\S)|\S"
#: Units of a k-mer and of an s-mer.
K, S = 5, 2
#: Rows of a range aimed at; ranges of the first cut, and of each of them in the second; ranges that a task gets on average.
RANGE_ROWS, RANGES, FINER, PER_TASK = 625, 4096, 1024, 4
#: Ranges whose first rows are broadcast; of more they are joined by a shuffle.
BROADCAST_RANGES = 100_000


def _bind(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once per row (a lambda variable, not a repeated expression)."""
    return F.transform(F.array(value), fn)[0]


def fingerprint(text: Column) -> Column:
    """struct(hash array<int>, pos array<int>): the closed syncmers of a text, in order."""
    inner, pad = K - S + 1, F.array_repeat(F.lit(""), K - 1)

    def closed(h: Column, i: Column) -> Column:
        """The least of the s-mers' hashes from i on is at an edge."""
        return F.least(F.get(h, i), F.get(h, i + (inner - 1))) <= F.least(*[F.get(h, i + j) for j in range(1, inner - 1)])

    def made(u: Column) -> Column:
        n = F.size(u)
        smers = F.zip_with(F.slice(u, F.lit(1), n - 1), F.slice(u, F.lit(2), n - 1), lambda a, b: F.xxhash64(a, b))  # S is 2
        kept = _bind(smers, lambda h: F.filter(F.sequence(F.lit(0), n - K), lambda i: closed(h, i)))
        return _bind(kept, lambda at: F.struct(F.transform(at, lambda i: F.hash(*[F.get(u, i + j) for j in range(K)])).alias("hash"), F.transform(at, lambda i: i - (K - 1)).alias("pos")))

    none = F.array().cast("array<int>")
    units = F.regexp_extract_all(text, F.lit(UNITS), F.lit(0))
    return _bind(units, lambda u: F.when(F.size(u) > 0, _bind(F.concat(pad, u, pad), made)).otherwise(F.struct(none.alias("hash"), none.alias("pos"))))


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of hashes in order: the share of distinct anchors that follow the same one in both."""

    def pairs(x: Column) -> Column:
        n = F.greatest(F.size(x) - 1, F.lit(0))
        return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(2), n), lambda p, q: F.xxhash64(p, q))

    def share(x: Column, y: Column) -> Column:
        linked = _bind(F.array_intersect(x, y), lambda c: F.when(F.size(c) == 0, 0).otherwise(1 + F.size(F.array_intersect(pairs(c), pairs(F.array_intersect(y, x))))))
        whole = F.size(x) + F.size(y)
        return F.when(whole == 0, 1.0).otherwise(2 * linked / whole)

    return _bind(F.array_distinct(a), lambda x: _bind(F.array_distinct(b), lambda y: share(x, y)))


def ranged(rows: DataFrame) -> tuple[DataFrame, int]:
    """(``rows`` (doc_id, h, ...) plus ``range``, the number of ranges); ranges follow the order of (doc_id, h), nulls first."""
    fractions = [i / RANGES for i in range(1, RANGES)]
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids"), F.percentile_approx("doc_id", fractions, RANGES * 10).alias("q")).first()
    wanted = -(-seen["n"] // RANGE_ROWS)
    first = min(wanted, RANGES)
    picked = [seen["q"][i * RANGES // first - 1] for i in range(1, first)] if seen["q"] else []
    cuts = sorted(set(picked))
    times = [1, *(picked.count(c) for c in cuts)]  # an id that is several cuts fills as many ranges
    nulls = -(-(seen["n"] - seen["ids"]) // RANGE_ROWS)
    begins = [nulls + sum(times[:i]) for i in range(len(times))]
    share = (F.shiftrightunsigned("h", 1) / F.lit(float(1 << 63))).cast("double")  # of the hash in its range, 0 to 1, in an order that ``h`` follows below
    of = lambda n: F.least(F.floor(share * n), n - 1).cast("long")
    if not cuts:
        place = F.lit(begins[0]).cast("long")
    else:
        step = max(1, round(len(cuts) ** 0.5))
        rows_of = [cuts[i : i + step] for i in range(0, len(cuts), step)]
        below = lambda values, x: F.size(F.filter(values, lambda c: c <= x))
        fine, coarse = F.array(*[F.array(*map(F.lit, r)) for r in rows_of]), F.array(*[F.lit(r[0]) for r in rows_of])
        index = _bind(below(coarse, F.col("doc_id")), lambda r: F.when(r == 0, 0).otherwise((r - 1) * step + below(F.get(fine, r - 1), F.col("doc_id"))))
        several = {c: n for c, n in zip(cuts, times[1:], strict=True) if n > 1}
        hot = F.lit(0).cast("long")
        for c, n in several.items():  # at most half of RANGES
            hot = F.when(F.col("doc_id") == c, of(F.lit(n))).when(F.col("doc_id") > c, F.lit(n - 1)).otherwise(F.lit(0)) + hot
        place = index.cast("long") + nulls + hot
    out = rows.withColumn("range", F.when(F.col("doc_id").isNull(), of(F.lit(max(nulls, 1)))).otherwise(place))
    if wanted <= RANGES:
        return out, nulls + sum(times)
    per = min(FINER, -(-wanted // RANGES))
    again = out.groupBy("range").agg(F.percentile_approx("doc_id", [i / per for i in range(1, per)], per * 10).alias("cuts"))  # at most 2 RANGES rows of FINER ids
    out = out.join(F.broadcast(again), "range").withColumn("range", F.col("range") * per + F.coalesce(F.size(F.filter(F.array_distinct("cuts"), lambda c: c <= F.col("doc_id"))), F.lit(0)))
    return out.drop("cuts"), (nulls + sum(times)) * per


def with_next(docs: DataFrame, made: dict[str, Column], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, ``made``, next_text, next_...) of every row and the one after it; the last is followed by the first."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, n = ranged(rows.withColumn("h", F.xxhash64("text")))
    key = F.shiftrightunsigned("h", 1)  # the order by which ids are cut further
    firsts = rows.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", key.alias("key"), "h")).alias("first"))
    order = Window.orderBy("range")  # a row for each range
    firsts = firsts.withColumn("before", F.coalesce(F.lag("range").over(order), F.max("range").over(Window.partitionBy())))
    firsts = firsts.select(F.col("range").alias("frange"), F.col("first.doc_id").alias("fid"), F.col("first.h").alias("fh"), F.col("before"))
    if n <= BROADCAST_RANGES:
        firsts = F.broadcast(firsts)  # a row of five numbers for each range
    marked = rows.join(firsts, (F.col("range") == F.col("frange")) & F.col("doc_id").eqNullSafe(F.col("fid")) & (F.col("h") == F.col("fh")), "left")
    spots = F.array_compact(F.array(F.struct("range", F.lit(0).alias("end")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("range"), F.lit(1).alias("end")))))
    sent = marked.select("doc_id", "text", "h", F.inline(spots)).repartition(-(-n // PER_TASK), "range").withColumns(made)
    window = Window.partitionBy("range").orderBy("end", F.asc_nulls_first("doc_id"), F.shiftrightunsigned("h", 1), "h")
    after = {f"next_{c}": F.lead(c).over(window) for c in ("text", *made)}
    return sent.withColumns(after).where("end = 0").drop("h", "range", "end")


def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = with_next(docs, {"mark": fingerprint(F.col("text"))})
    cut = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next_text", F.lit(1), cut))
    pairs = pairs.withColumn("edited", edited).withColumn("edited_mark", fingerprint(F.col("edited")))
    return pairs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("mark.hash").alias("fingerprint"),
        F.col("edited_mark.hash").alias("edited_fingerprint"),
        likeness(F.col("mark.hash"), F.col("edited_mark.hash")).alias("near_edited"),
        likeness(F.col("mark.hash"), F.col("next_mark.hash")).alias("near_next"),
        F.col("mark.pos").alias("positions"),
        F.col("edited_mark.pos").alias("edited_positions"),
    )
