"""Operator 9: language identification by family, then one-versus-one linear SVMs.

Features are hashed byte bigrams and trigrams of the whole lower-cased text (everything ASCII but
letters reads as one space), square-rooted and scaled to unit length. Linear SVMs (squared hinge,
trained in numpy) first tell the language families apart, one against one; within the chosen family
one SVM per pair of languages votes, ties going to the larger sum of margins.

Only the sample of labelled rows is bounded (``SAMPLE`` rows in expectation, drawn by a hash of the id at
one rate per language); their features are made on executors and collected as the numbers and counts of those that occur.
Prediction reads every text whole.

Null texts and texts without a letter get ``und`` with score 0, as does everything when there is
nothing to learn from. With one learned language every text with a letter gets it. Null and empty
``lang`` values teach nothing. Repeated rows are predicted each on their own. ``lang_pred`` and
``score`` replace input columns of these names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, fresh, hold_out, map_arrow, small_batches, table, text_bytes, trim, with_arrow

#: Languages of a family; others are families of their own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "cjk": ("zh", "ja", "ko"),
}
DIMENSIONS = 4096
SAMPLE = 4000
UNKNOWN = "und"
#: Bytes as features see them.
_SEEN = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in LOWER], np.uint8)
_CELLS = 1 << 19


def family(lang: str) -> str:
    base = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, langs in FAMILIES.items() if base in langs), f"={lang}")


def counts(data: np.ndarray, offsets: np.ndarray):
    """Yield (first text, n-gram counts of some whole texts as a dense matrix)."""
    texts = len(offsets) - 1
    for low in range(0, texts, _CELLS // DIMENSIONS):
        high = min(texts, low + _CELLS // DIMENSIONS)
        begin, end = offsets[low], offsets[high]
        sizes = np.diff(offsets[low : high + 1])
        owner = np.repeat(np.arange(high - low), sizes + 1)
        padded = np.full(end - begin + (high - low) + 2, 32, np.uint32)
        padded[1 + np.arange(end - begin) + np.repeat(np.arange(high - low), sizes)] = _SEEN[data[begin:end]]
        out = np.zeros((high - low) * DIMENSIONS, np.int64)
        for at in range(0, len(owner), 1 << 20):
            part = padded[at : at + (1 << 20) + 2]
            two = part[:-2] * np.uint32(257) + part[1:-1]
            three = (two * np.uint32(257) + part[2:]) * np.uint32(2654435761)
            two *= np.uint32(2246822519)
            own = owner[at : at + (1 << 20)] * DIMENSIONS
            for code in (two, three):
                out += np.bincount(own + (code[: len(own)] >> np.uint32(20)).astype(np.int64), minlength=len(out))
        yield low, out.reshape(high - low, DIMENSIONS)


def scaled(matrix: np.ndarray) -> np.ndarray:
    """Square roots at unit length; a matrix of 32-bit floats is changed in place."""
    x = matrix.astype(np.float32, copy=False)
    np.sqrt(x, out=x)
    x /= np.maximum(np.sqrt(np.einsum("nd,nd->n", x, x)), 1e-9)[:, None]
    return x


def svm(x: np.ndarray, sign: np.ndarray, penalty: float = 1e-5, steps: int = 120) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss; accelerated full gradients."""
    weight = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    for k in range(steps):
        slack = weight * sign * np.maximum(0, 1 - sign * (x @ v[:-1] + v[-1]))
        grad = -2 * np.append(x.T @ slack, slack.sum()) + penalty * v
        new = v - np.float32(0.25) * grad
        w, v = new, new + np.float32(k / (k + 3)) * (new - w)
    return w


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]):
        names = np.array(langs, object)
        self.families: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.families.setdefault(family(lang), []).append(lang)
        groups = np.array([family(name) for name in langs], object)
        self.order = sorted(self.families)
        self.top = self._pairs(x, groups, self.order)
        self.inner = {f: self._pairs(x if (groups == f).all() else x[groups == f], names[groups == f], ls) for f, ls in self.families.items()}

    @staticmethod
    def _pairs(x, labels, classes) -> np.ndarray:
        made = []
        for a, b in combinations(classes, 2):
            mine = (labels == a) | (labels == b)
            made.append(svm(x if mine.all() else x[mine], np.where(labels[mine] == a, 1, -1).astype(np.float32)))
        return np.array(made, np.float32).reshape(len(made), x.shape[1] + 1)

    @staticmethod
    def _vote(x, pairs, classes) -> tuple[np.ndarray, np.ndarray]:
        """(winning class, its confidence) by votes, then margins."""
        votes, sums = np.zeros((len(x), len(classes))), np.zeros((len(x), len(classes)))
        margin = x @ pairs[:, :-1].T + pairs[:, -1] if len(pairs) else np.zeros((len(x), 0))
        for k, (a, b) in enumerate(combinations(range(len(classes)), 2)):
            m = np.clip(margin[:, k], -2, 2)
            votes[:, a] += m >= 0
            votes[:, b] += m < 0
            sums[:, a] += m
            sums[:, b] -= m
        best = np.argmax(votes + sums / (1 + 4 * len(classes)), 1)
        others = [1 / (1 + np.exp(-4 * np.clip(margin[:, k] if a == c else -margin[:, k], -8, 8))) * (best == c) + (best != c) for c in range(len(classes)) for k, (a, b) in enumerate(combinations(range(len(classes)), 2)) if c in (a, b)]
        return best, np.prod(others, 0) if others else np.ones(len(x))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        best, score = self._vote(x, self.top, self.order)
        out = np.empty(len(x), object)
        for k, name in enumerate(self.order):
            if (mine := best == k).any():
                inner, sure = self._vote(x[mine], self.inner[name], self.families[name])
                out[mine] = np.array(self.families[name], object)[inner]
                score[mine] *= sure
        return out.tolist(), score


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model | None:
    """Learn from the rows where ``usable`` holds; None without any."""
    rows = docs.where(usable & F.col(lang).isNotNull() & (F.col(lang) != "") & has_letter(F.col(text)))
    sizes = {r["k"]: r["n"] for r in rows.groupBy(F.col(lang).alias("k")).agg(F.count("*").alias("n")).collect()}  # one row per language
    if not sizes:
        return None
    rate = F.lit(0.0)
    for k, n in sizes.items():
        rate = F.when(F.col(lang) == k, F.lit(max(sample / len(sizes), 25) / n)).otherwise(rate)
    u = F.pmod(F.xxhash64(F.lit("langid"), F.col(doc_id)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.where(u < rate).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [r for _, c in counts(*text_bytes(batch.column("text"))) for r in c]
        at = [np.flatnonzero(r) for r in rows]
        made = [pa.array([x.tobytes() for x in xs], pa.binary()) for xs in ([i.astype(np.int16) for i in at], [r[i].astype(np.float32) for r, i in zip(rows, at, strict=True)])]
        return pa.RecordBatch.from_arrays([batch.column("lang"), *made], names=["lang", "at", "n"])

    got = sorted((r["lang"], bytes(r["at"]), bytes(r["n"])) for r in map_arrow(drawn, run, "lang string, at binary, n binary").collect())  # the bounded sample, at most DIMENSIONS features each
    if not got:
        return None
    x = np.zeros((len(got), DIMENSIONS), np.float32)
    for row, (_, at, n) in zip(x, got, strict=True):
        row[np.frombuffer(at, np.int16)] = np.frombuffer(n, np.float32)
    model = Model(scaled(x), [k for k, *_ in got])
    del x, got
    trim()
    return model


def predict(docs: DataFrame, model: Model | None, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` plus lang_pred and score, under these names."""
    if model is None:
        return docs.drop(*names).withColumns({names[0]: F.lit(UNKNOWN), names[1]: F.lit(0.0)})

    letter = fresh(docs, "has_letter__")[0]

    def run(batch: pa.RecordBatch) -> dict:
        langs, scores = [], []
        for _, c in counts(*text_bytes(batch.column(text))):
            got, sure = model.predict(scaled(c))
            langs += got
            scores.append(sure)
        letters = batch.column(letter).to_numpy(zero_copy_only=False)
        score = np.where(letters, np.concatenate(scores), 0.0)
        return {names[0]: pa.array([k if ok else UNKNOWN for k, ok in zip(langs, letters, strict=True)]), names[1]: pa.array(score)}

    return with_arrow(docs.withColumn(letter, has_letter(F.col(text))), run, f"{names[0]} string, {names[1]} double").drop(letter)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = hold_out(F.col("doc_id"), 5, 0)
    model = fit(docs, ~held)
    return predict(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without an identifiable language go; columns stay as they are."""
    small_batches(spark)
    model = fit(docs, ~hold_out(F.col("doc_id"), 5, 0))
    names = fresh(docs, "lang_pred__", "score__")
    return predict(docs, model, names=tuple(names)).where(F.col(names[0]) != UNKNOWN).select(*docs.columns)
