"""Operator 4: toxicity by a small convolutional text classifier.

Words (runs of ASCII letters and digits and of bytes over 127, A-Z lower-cased) are hashed to
rows of an embedding table, and so are their first four bytes; a word's vector is the sum of both. Filters one, two and three words wide slide over the whole
text, their maxima over all positions feed a linear layer. Everything is trained in numpy by
Adam; the first embedding coordinate starts from each bucket's smoothed log odds, the rest small and
random with a fixed seed. Because filters are linear, scoring multiplies the table with all
filters once and then only gathers, adds and takes maxima, in blocks of bounded size.

The threshold is calibrated by language, on a part of the training rows that the weights have not
seen. The language is read from the text by fixed function words, never from the column; the score
is the logistic of the distance to that threshold, so 0.5 is the decision.

Only the labelled sample is bounded (``POSITIVES`` and ``NEGATIVES`` rows and ``TRAIN_CHARS`` characters in expectation, by a hash of
the id). Null and empty texts are scored like a text without words. Labels other than 0 and 1 teach
nothing; of several labels of an id the toxic one counts. Without labels of both kinds every
score is 0. ``score`` and ``predicted`` replace input columns of these names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, fresh, hash_words, hold_out, map_arrow, small_batches, table, text_bytes, trim, with_arrow

#: Rows for words, then for beginnings of words; the row PAD after them is zero.
BUCKETS, BEGINNINGS = 1 << 15, 1 << 14
PAD, LEAD = BUCKETS + BEGINNINGS, 4
WIDTH, FILTERS, SIZES = 8, 8, (1, 2, 3)
POSITIVES, NEGATIVES = 2500, 5000
#: Characters of the labelled sample, in expectation; of longer texts fewer are drawn.
TRAIN_CHARS = 64_000_000
BLOCK = 1 << 16
#: Function words that tell a text's language for its threshold.
WORDS = {
    "en": "the of and to for in is that it with was on by as this be".split(),
    "de": "der die und den von das zu sich mit des auf nicht im ist dem ein".split(),
    "fr": "le et les du une que est pour qui dans par au sur pas avec aux".split(),
    "es": "el y los las del por con su para al como pero sus le ha lo".split(),
}
_WORD = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
assert SPACE[32]


def buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows of each word, shape (n, 2); offsets of texts), each text followed by two pads."""
    data, offsets = text_bytes(column)
    data = _WORD[data]
    words, first = hash_words(data, offsets)
    begins, _ = hash_words(data, offsets, LEAD)
    texts = len(offsets) - 1
    out = np.full((len(words) + 2 * texts, 2), PAD, np.int32)
    at = np.arange(len(words)) + 2 * np.repeat(np.arange(texts), np.diff(first))
    out[at, 0] = words % np.uint64(BUCKETS)
    out[at, 1] = begins % np.uint64(BEGINNINGS) + np.uint64(BUCKETS)
    return out, first + 2 * np.arange(texts + 1)


class Net:
    """The classifier's weights; ``table`` has one column per filter and offset, then languages."""

    def __init__(self, log_odds: np.ndarray):
        rng = np.random.default_rng(7)
        self.embed = (0.1 * rng.standard_normal((PAD + 1, WIDTH))).astype(np.float32)
        self.embed[:, 0] = log_odds
        self.embed[PAD] = 0
        self.filters = [(0.3 * rng.standard_normal((w, WIDTH, FILTERS))).astype(np.float32) for w in SIZES]
        for f in self.filters:
            f[:, 0, : FILTERS // 2] = np.abs(f[:, 0, : FILTERS // 2])
        self.bias = np.zeros(len(SIZES) * FILTERS, np.float32)
        self.out = (0.3 * np.abs(rng.standard_normal(len(SIZES) * FILTERS))).astype(np.float32)
        self.shift = np.float32(-1.0)
        self.thresholds = {"": 0.0}

    def projected(self) -> np.ndarray:
        cols = [self.embed @ f[j] for f in self.filters for j in range(len(f))]
        marks = np.zeros((PAD + 1, len(WORDS)), np.float32)
        for k, words in enumerate(WORDS.values()):
            ids, first = buckets(pa.array(words))
            marks[ids[first[:-1], 0], k] = 1
        return np.ascontiguousarray(np.hstack([*cols, marks]), dtype=np.float32)

    def pooled(self, seen: np.ndarray, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(maxima per text and filter, function words per text and language)."""
        texts, n = len(first) - 1, len(ids)
        maxima = np.full((texts, len(self.bias)), -np.inf, np.float32)
        hits = np.zeros((texts, len(WORDS)), np.float64)
        padded, ends = _padded(ids), np.concatenate([first[1:] - 2, first[1:] - 1])
        for at in range(0, n, BLOCK):
            end = min(n, at + BLOCK)
            got = seen[padded[at : end + max(SIZES) - 1, 0]]
            got += seen[padded[at : end + max(SIZES) - 1, 1]]
            parts, c = [], 0
            for w in SIZES:
                parts.append(sum(got[j : j + end - at, c + j * FILTERS : c + (j + 1) * FILTERS] for j in range(w)))
                c += w * FILTERS
            low = int(np.searchsorted(first, at, "right")) - 1
            high = int(np.searchsorted(first, end, "left"))
            cuts = np.maximum(first[low:high], at) - at
            sums = np.hstack(parts)
            sums[ends[(ends >= at) & (ends < end)] - at] = 0  # windows that begin behind a text's last word do not look into the next text
            maxima[low:high] = np.maximum(maxima[low:high], np.maximum.reduceat(sums, cuts, axis=0))
            hits[low:high] += np.add.reduceat(got[: end - at, c:], cuts, axis=0)
        return maxima, hits

    def logits(self, maxima: np.ndarray) -> np.ndarray:
        return np.maximum(maxima + self.bias, 0) @ self.out + self.shift

    def thresholds_of(self, hits: np.ndarray) -> np.ndarray:
        langs = [*WORDS]
        best = np.argmax(hits, 1)
        return np.array([self.thresholds.get(langs[b] if hits[i, b] else "", self.thresholds[""]) for i, b in enumerate(best)])

    def train(self, texts: list[np.ndarray], y: np.ndarray, epochs: int = 6, batch: int = 64) -> None:
        rng = np.random.default_rng(11)
        params = [self.embed, *self.filters, self.bias, self.out]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                mine = order[at : at + batch]
                ids = np.concatenate([texts[i] for i in mine])
                sizes = np.array([len(texts[i]) for i in mine])
                first = np.concatenate([[0], np.cumsum(sizes)])
                padded = _padded(ids)
                x = self.embed[padded[:, 0]] + self.embed[padded[:, 1]]
                conv = np.hstack([sum(x[j : j + len(ids)] @ f[j] for j in range(len(f))) for f in self.filters])
                maxima = np.maximum.reduceat(conv, first[:-1], axis=0)
                where = np.empty(maxima.shape, np.int64)
                rows, cols = np.nonzero(conv == np.repeat(maxima, sizes, axis=0))
                where[np.repeat(np.arange(len(mine)), sizes)[rows[::-1]], cols[::-1]] = rows[::-1]
                hidden = np.maximum(maxima + self.bias, 0)
                p = 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.shift, -30, 30)))
                d = ((p - y[mine]) * weight[mine] / len(mine)).astype(np.float32)
                back = np.where(hidden > 0, d[:, None] * self.out, 0)
                grads = [np.zeros_like(p_) for p_ in params]
                for k, f in enumerate(self.filters):
                    cut = slice(k * FILTERS, (k + 1) * FILTERS)
                    for j in range(len(f)):
                        spot = padded[where[:, cut] + j]
                        grads[1 + k][j] = np.einsum("bfd,bf->df", self.embed[spot].sum(2), back[:, cut])
                        for own in (0, 1):
                            np.add.at(grads[0], spot[:, :, own], back[:, cut, None] * f[j].T[None])
                grads[0][PAD] = 0
                grads[-2], grads[-1] = back.sum(0), hidden.T @ d
                self.shift -= np.float32(0.02) * d.sum()
                step += 1
                for p_, g, a, b in zip(params, grads, m, v, strict=True):
                    a *= 0.9
                    a += 0.1 * g
                    b *= 0.999
                    b += 0.001 * g * g
                    p_ -= 0.005 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-7)

    def calibrate(self, texts: list[np.ndarray], y: np.ndarray, share: np.ndarray) -> None:
        """A threshold for each language with enough rows of both kinds, and one for the others."""
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        maxima, hits = self.pooled(self.projected(), np.concatenate(texts), first)
        z, langs = self.logits(maxima), [*WORDS]
        own = np.array([langs[b] if hits[i, b] else "" for i, b in enumerate(np.argmax(hits, 1))])
        for name in ["", *langs]:
            mine = np.ones(len(z), bool) if not name else own == name
            if not name or min(y[mine].sum(), (1 - y[mine]).sum()) >= 15:
                self.thresholds[name] = _cut(z[mine], y[mine], share[mine])


def _padded(ids: np.ndarray) -> np.ndarray:
    return np.concatenate([ids, np.full((max(SIZES) - 1, 2), PAD, np.int32)])


def _cut(z: np.ndarray, y: np.ndarray, share: np.ndarray) -> float:
    """The logit with the least weighted error; the middle of the widest gap among equals."""
    order = np.argsort(z, kind="stable")
    z, y, share = z[order], y[order], share[order]
    wrong = np.concatenate([[0], np.cumsum(y * share)]) + np.concatenate([np.cumsum(((1 - y) * share)[::-1])[::-1], [0]])
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    gap = max(best, key=lambda k: edges[k + 1] - edges[k])
    return float((edges[gap] + edges[gap + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, text: str = "text", doc_id: str = "doc_id", positives: int = POSITIVES, negatives: int = NEGATIVES) -> Net | None:
    """Learn from the labels of documents where ``usable`` (over ``label_id``) holds."""
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("label_id").isNotNull() & F.col("toxic").isin(0, 1) & usable)
    known = known.groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(sizes) < 2:
        return None
    u = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("label_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = known.where(u < F.when(F.col("toxic") == 1, positives / sizes[1]).otherwise(negatives / sizes[0]))
    rows = docs.select(doc_id, F.col(text).alias("text")).join(F.broadcast(drawn), F.col(doc_id) == F.col("label_id"))  # at most about positives + negatives rows
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    if chars > TRAIN_CHARS:
        again = F.pmod(F.xxhash64(F.lit("toxicity chars"), F.col("label_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
        rows = rows.where(again < TRAIN_CHARS / chars)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, first = buckets(batch.column("text"))
        made = [ids[first[i] : first[i + 1]].astype(np.uint16).tobytes() for i in range(batch.num_rows)]
        return pa.RecordBatch.from_arrays([batch.column("label_id"), batch.column("toxic"), pa.array(made, pa.binary())], names=["label_id", "toxic", "ids"])

    got = sorted((r["label_id"], r["toxic"], bytes(r["ids"])) for r in map_arrow(rows.select("label_id", "toxic", "text"), run, "label_id long, toxic int, ids binary").collect())
    texts = [np.frombuffer(b, np.uint16).astype(np.int32).reshape(-1, 2) for _, _, b in got]
    y = np.array([t for _, t, _ in got], np.float32)
    if not len(y) or y.min() == y.max():
        return None
    aside = np.arange(len(y)) % 4 == 3
    odds = np.zeros((2, PAD + 1))
    for t, toxic, skip in zip(texts, y, aside, strict=True):
        if not skip:
            odds[int(toxic), np.unique(t)] += 1
    n1, n0 = y[~aside].sum(), (1 - y[~aside]).sum()
    log_odds = np.clip(np.log((odds[1] + 0.5) / (n1 + 1)) - np.log((odds[0] + 0.5) / (n0 + 1)), -2, 4) * (odds.sum(0) >= 3)
    log_odds[PAD] = 0
    net = Net((0.5 * log_odds).astype(np.float32))
    net.train([t for t, s in zip(texts, aside, strict=True) if not s], y[~aside])
    share = np.where(y > 0, sizes[1] / max(1, y.sum()), sizes[0] / max(1, (1 - y).sum()))
    rest = aside if 0 < y[aside].sum() < aside.sum() else ~aside
    net.calibrate([t for t, s in zip(texts, rest, strict=True) if s], y[rest], share[rest])
    del got, texts
    trim()
    return net


def score(docs: DataFrame, net: Net | None, text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` plus score (0 to 1) and predicted (0 or 1), under these names."""
    if net is None:
        return docs.drop(*names).withColumns({names[0]: F.lit(0.0), names[1]: F.lit(0)})
    built: list = []

    def run(batch: pa.RecordBatch) -> dict:
        if not built:
            built.append(net.projected())
        maxima, hits = net.pooled(built[0], *buckets(batch.column(text)))
        p = 1 / (1 + np.exp(-np.clip((net.logits(maxima) - net.thresholds_of(hits)).astype(np.float64), -50, 50)))
        return {names[0]: pa.array(p), names[1]: pa.array((p >= 0.5).astype(np.int32))}

    return with_arrow(docs, run, f"{names[0]} double, {names[1]} int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(docs, table(spark, sf_dir, "labels"), ~hold_out(F.col("label_id"), 5, 0))
    return score(docs.withColumn("held_out", hold_out(F.col("doc_id"), 5, 0)), net).select("doc_id", "held_out", "score", "predicted")


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted toxic go; columns stay as they are."""
    small_batches(spark)
    net = fit(docs, table(spark, sf_dir, "labels"), ~hold_out(F.col("label_id"), 5, 0))
    names = fresh(docs, "score__", "predicted__")
    return score(docs, net, names=tuple(names)).where(F.col(names[1]) == 0).select(*docs.columns)
