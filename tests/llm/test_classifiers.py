"""The two classifiers against loops, and their accuracy on documents they have not learnt from."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronofold.llm import langid, toxicity
from chronofold.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"
needs_data = pytest.mark.skipif(not os.path.exists(SF), reason="no test data")


def small_net():
    net = toxicity.Net((0.1 * np.random.default_rng(2).standard_normal(toxicity.PAD + 1)).astype(np.float32))
    rng = np.random.default_rng(3)
    net.embed = (rng.standard_normal(net.embed.shape)).astype(np.float32)
    net.embed[toxicity.PAD] = 0
    net.filters = [rng.standard_normal(f.shape).astype(np.float32) for f in net.filters]
    return net


def test_convolution_and_pooling_equal_loops():
    net = small_net()
    texts = ["you are a fool and a clown", "one", "", "alpha beta", "word " * 300 + "end"]
    ids, first = toxicity.buckets(pa.array(texts))
    maxima, _ = net.pooled(net.projected(), ids, first)
    for t in range(len(texts)):
        own = [net.embed[a] + net.embed[b] for a, b in ids[first[t] : first[t + 1] - 2]]  # two empty words end a text
        for k, f in enumerate(net.filters):
            padded = own + [np.zeros(toxicity.WIDTH, np.float32)] * (len(f) - 1)
            sums = [sum(padded[i + j] @ f[j] for j in range(len(f))) for i in range(len(own))]
            sums.append(np.zeros(toxicity.FILTERS))  # behind the last word
            assert np.allclose(maxima[t, k * toxicity.FILTERS : (k + 1) * toxicity.FILTERS], np.max(sums, 0), atol=1e-3), (t, k)


def test_feature_counts_equal_loops():
    texts = ["Ab, c", "", "ein Wort 12 zwei", "x" * 700]
    data, offsets = langid.text_bytes(pa.array(texts))
    got = np.concatenate([c for _, c in langid.counts(data, offsets)])
    for t, text in enumerate(texts):
        seen = [32, *(int(langid._SEEN[b]) for b in text.encode()), 32, 32]
        want = np.zeros(langid.DIMENSIONS, np.int64)
        for i in range(len(text.encode()) + 1):
            two = (seen[i] * 257 + seen[i + 1]) % 2**32
            nxt = seen[i + 2]
            want[(two * 2246822519) % 2**32 >> 20] += 1
            want[((two * 257 + nxt) * 2654435761) % 2**32 >> 20] += 1
        # the last trigram looks one byte on, into the next text's first or the end
        assert abs(got[t] - want).sum() <= 2 and got[t].sum() == want.sum()
    assert got[3].max() > 255


def test_votes_and_margins_choose_the_language():
    rng = np.random.default_rng(0)
    centres = {"en": 0, "de": 1, "fr": 2, "es": 3}
    langs = [k for k in centres for _ in range(40)]
    x = rng.random((160, 16)).astype(np.float32) * 0.2
    x[np.arange(160), [centres[k] * 4 for k in langs]] += 1
    model = langid.Model(x / np.linalg.norm(x, axis=1, keepdims=True), langs)
    assert set(model.order) == {"germanic", "romance"}
    got, score = model.predict(x / np.linalg.norm(x, axis=1, keepdims=True))
    assert got == langs and score.min() > 0 and score.max() <= 1


@needs_data
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op9_language_id"](spark, SF).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred != 'und'")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right"), F.count("*").alias("n")).first()
    assert r["n"] > 100 and r["right"] > 0.97
    labels = spark.read.parquet(f"{SF}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    got = QUERIES["op4_toxicity"](spark, SF).join(labels, "doc_id").where("toxic is not null")
    rows = got.groupBy("held_out", "toxic").agg(F.avg("predicted").alias("flagged"), F.count("*").alias("n")).collect()
    flagged = {(r["held_out"], r["toxic"]): r["flagged"] for r in rows}
    assert flagged[False, 1] > 0.95 and flagged[False, 0] < 0.02 and flagged[True, 1] > 0.85 and flagged[True, 0] < 0.02
