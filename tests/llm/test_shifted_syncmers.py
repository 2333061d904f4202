"""Long texts that are shifted by a character stay alike, with or without spaces."""

import random

import pytest
from pyspark.sql import functions as F

from chronofold.llm import syncmers
from chronofold.llm.syncmers import fingerprint, likeness

KINDS = {
    "chinese": [chr(c) for c in range(0x4E00, 0x4E00 + 800)],
    "thai": [chr(c) for c in range(0x0E01, 0x0E2F)],
    "base64": list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    "hex": list("0123456789abcdef"),
    "no cuts": list("bcdfg"),
}


@pytest.mark.parametrize("kind", KINDS)
def test_shifted_copies_are_alike(spark, kind):
    rng = random.Random(3)
    text = "".join(rng.choice(KINDS[kind]) for _ in range(4000))
    copies = [rng.choice(KINDS[kind]) + text, text[:2000] + rng.choice(KINDS[kind]) + text[2000:], text[1:], text + "x"]
    other = "".join(rng.choice(KINDS[kind]) for _ in range(4000))
    df = spark.createDataFrame([(text, c) for c in [*copies, other]], "a string, b string")
    got = [r[0] for r in df.select(likeness(fingerprint(F.col("a"))["hash"], fingerprint(F.col("b"))["hash"])).collect()]
    assert min(got[:-1]) > 0.9 and got[-1] < 0.3


def units(text):
    """The units of ASCII texts without white space but the blank, by hand."""
    out = []
    for run in text.split(" "):
        at = 0
        while at < len(run):
            ends = [k for k in range(at, min(len(run), at + 16)) if run[k] in "ioIO37" or not run[k].isalnum()]
            stop = ends[0] + 1 if ends else len(run) if len(run) - at <= 16 else at + 1
            out.append(run[at:stop])
            at = stop
    return out


def anchors(text):
    """(units of each closed syncmer, position), by brute force."""
    import xxhash

    seen = units(text)
    if not seen:
        return []
    u, k, s = [""] * (syncmers.K - 1) + seen + [""] * (syncmers.K - 1), syncmers.K, syncmers.S

    def hash_of(words):
        h = 42
        for w in words:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        return h - (1 << 64) if h >= 1 << 63 else h

    out = []
    for i in range(len(u) - k + 1):
        inner = [hash_of(u[j : j + s]) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((tuple(u[i : i + k]), i - (k - 1)))
    return out


def near(a, b):
    a, b = (list(dict.fromkeys(w for w, _ in anchors(t))) for t in (a, b))
    x, y = [w for w in a if w in b], [w for w in b if w in a]
    linked = len(set(zip(x, x[1:], strict=False)) & set(zip(y, y[1:], strict=False))) + bool(x)
    return 2 * linked / (len(a) + len(b)) if a or b else 1.0


TEXTS = ["", " ", "a", "ab cd", "one two three four five six seven eight nine ten", "one two three four five six seven eight nine TEN and more",
         "bcd" * 30, "x.y.z! " * 12, "eight nine ten one two three four five six seven", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaai rest"]


def test_fingerprints_and_likeness_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").withColumn("m", fingerprint(F.col("t")))
    got = {r["i"]: list(zip(r["m"]["hash"], r["m"]["pos"], strict=True)) for r in df.collect()}
    meaning = {}
    for i, t in enumerate(TEXTS):
        want = anchors(t)
        assert [p for _, p in got[i]] == [p for _, p in want]
        for (h, _), (words, _) in zip(got[i], want, strict=True):
            assert meaning.setdefault(words, h) == h
    assert len(set(meaning.values())) == len(meaning)
    two = df.select("i", F.col("m.hash").alias("a")).crossJoin(df.select(F.col("i").alias("j"), F.col("m.hash").alias("b")))
    for r in two.select("i", "j", likeness(F.col("a"), F.col("b")).alias("near")).collect():
        assert r["near"] == pytest.approx(near(TEXTS[r["i"]], TEXTS[r["j"]])), (r["i"], r["j"])


def test_every_length_shares_anchors_with_the_next(spark):
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefghklmnp") for _ in range(4)) for _ in range(150))
    df = spark.createDataFrame([(text[:n], text[: n + 1]) for n in range(6, 700, 7)], "a string, b string")
    near_ = [r[0] for r in df.select(likeness(fingerprint(F.col("a"))["hash"], fingerprint(F.col("b"))["hash"])).collect()]
    assert min(near_) > 0 and min(near_[12:]) > 0.6


@pytest.mark.parametrize("sizes", [(2500, 4096, 1024), (3, 4096, 1024), (3, 4, 8)])
def test_the_next_document_in_any_cut_of_ranges(spark, monkeypatch, sizes):
    for name, value in zip(("RANGE_ROWS", "RANGES", "FINER"), sizes, strict=True):
        monkeypatch.setattr(syncmers, name, value)
    rows = [(i * 3, f"text {i}") for i in range(40)] + [(30, f"copy {i}") for i in range(25)] + [(None, f"null {i}") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["text"]): r["next_text"] for r in syncmers.with_next(df, {}).collect()}
    h = {r["text"]: (r["h"] >> 1 & (1 << 63) - 1, r["h"]) for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *h[r[1]]))
    assert got == {r: order[(k + 1) % len(order)][1] for k, r in enumerate(order)}
