"""The language model tells words apart by context beyond the most frequent ones, and stays normalised."""

import numpy as np
from pyspark.sql import functions as F

from chronofold.llm import lmscore


def test_rare_words_are_told_apart_by_context(spark):
    common = [f"c{i}" for i in range(200)]
    rows = [(k, " ".join(common), True) for k in range(60)]
    rows += [(1000 + k, f"left{k % 20} right{k % 20}", True) for k in range(400)]
    rows += [(5000 + 2 * k, f"left{k} right{k}", False) for k in range(20)]
    rows += [(5001 + 2 * k, f"left{k} right{(k + 7) % 20}", False) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(2)
    got = {r["doc_id"]: r["score"] for r in lmscore.score(df, F.col("learn")).where("doc_id >= 5000").collect()}
    assert sum(got[5000 + 2 * k] > got[5001 + 2 * k] + 0.1 for k in range(20)) >= 18


def test_probabilities_sum_to_one():
    model = lmscore.Model(np.arange(40, dtype=np.int64) * 7919, 23)
    model.weigh(np.arange(model.slots, dtype=float), np.ones(model.slots))
    model.finish(model.params * 3)
    for code in (0, 5 * model.slots + 9, model.end * model.slots + model.end):
        p = 10 ** model.log10(np.full(model.slots, code), np.arange(model.slots))
        assert abs(p.sum() - 1) < 1e-5


def test_training_meets_every_trigram(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "STEPS", 1)
    rows = [(" ".join(f"w{i}" for i in range(k, k + 10)),) for k in range(0, 20_000, 10)]
    df = spark.createDataFrame(rows, "text string").repartition(3)
    words = np.array([r["word"] for r in lmscore.word_counts(df).collect()], np.int64)
    assert len(words) == 20_000
    model = lmscore.Model(words, 1)
    model.weigh(np.ones(model.slots), np.ones(model.slots))
    before = model.params.copy()
    lmscore.train(df, model, 22_000, 200_000)
    # every word is a target once, so its row moves
    start = before[model.slots : 2 * model.slots, : lmscore.WIDTH]
    assert np.all(np.any(model.q[: model.own, : lmscore.WIDTH] != start[: model.own], axis=1))
