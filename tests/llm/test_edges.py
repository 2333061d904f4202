"""Every operator and stage on odd and on empty tables, against brute force where rows are defined."""

import binascii
import hashlib
import math
from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline
from chronofold.llm import lmscore, mixing, ngramjoin, topk, urls
from chronofold.llm.bpe import VOCABULARY, Codec
from chronofold.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_empty_results(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_empty_tables(spark, empty_dir, name):
    docs = spark.read.parquet(f"{empty_dir}/documents.parquet")
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, empty_dir).count() == 0


def documents(spark, odd_dir):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{odd_dir}/documents.parquet").collect()]


def words_of(text):
    return text.encode().lower().split()


def test_mixing(spark, odd_dir):
    rows = QUERIES["op1_mix_sources"](spark, odd_dir).collect()
    assert Counter((r["doc_id"], r["copy_no"], r["source"]) for r in rows)
    by_id = Counter(r["doc_id"] for r in rows)
    assert all(r["copy_no"] <= r["n_copies"] for r in rows)
    # repeated rows of an id get the same number of copies
    assert by_id[3] % 2 == 0
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    assert {r["source"] for r in mixing.mix(docs, weights={"b": 1.0}, epochs=5.0).collect()} <= {"b"}


def test_mixing_beyond_the_broadcast_bound(spark, odd_dir, monkeypatch):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    want = sorted((str(r["doc_id"]), r["copy_no"]) for r in mixing.mix(docs, epochs=3.0).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted((str(r["doc_id"]), r["copy_no"]) for r in mixing.mix(docs, epochs=3.0).collect()) == want


def test_poisson_rates(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'abcd' as text", "if(id % 4 = 0, 'a', 'b') as source")
    rows = mixing.mix(docs, weights={"a": 3.0, "b": 1.0}).groupBy("source").count().collect()
    got = {r["source"]: r["count"] for r in rows}
    assert abs(got["a"] - 15_000) < 500 and abs(got["b"] - 5_000) < 300


def test_bpe(spark, odd_dir):
    codec = Codec(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    want = []
    for i, t in documents(spark, odd_dir):
        ids = codec.core.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in QUERIES["op2_byte_bpe"](spark, odd_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert Counter(got) == Counter(want)


def test_urls(spark, odd_dir):
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in QUERIES["op3_url_filter"](spark, odd_dir).collect()}
    assert got == {
        (1, "a.example.com", "/en/7", "example.com/en/7", "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"),
        (4, "sub.example.net", "/de/9", "net/de/", "block"), (5, "h.org", "/xxx", None, "block"), (6, "h.org", "/adult-casino", None, "block"), (None, "com", "/en/", "com/en/", "block"),
    }
    v = urls.Vocabulary(("bad",), {"free": 0.5, "hot": 0.5, "pills": 1.0}, 2.0)
    assert v.rejects("http://x/bad.html")[0] and not v.rejects("http://x/badger")[0]
    assert not v.rejects("http://x/free/free/free/hot")[0] and v.rejects("http://x/free/hot/pills")[0]
    assert not v.rejects("http://x/pills/pills")[0]


def test_scores_are_defined(spark, odd_dir):
    for name in ("op4_toxicity", "op9_language_id"):
        rows = QUERIES[name](spark, odd_dir).collect()
        assert len(rows) == 18 and all(0 <= r["score"] <= 1 and not math.isnan(r["score"]) for r in rows)
        assert all(r["held_out"] == (binascii.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0) for r in rows)
    langs = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert langs[4] == langs[5] == langs[6] == langs[11] == "und" and langs[0] != "und"


def test_syncmers(spark, odd_dir):
    docs = sorted(documents(spark, odd_dir), key=lambda d: (d[0] is not None, d[0] or 0))
    rows = {}
    for r in QUERIES["op5_syncmers"](spark, odd_dir).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert any(r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() for r in rows[i])
    assert rows[0][0]["fingerprint"] == rows[1][0]["fingerprint"] and rows[0][0]["near_next"] == 1.0
    assert rows[5][0]["near_edited"] == 1.0


def brute_components(docs, n, percent):
    sets = []
    for _, t in docs:
        w = words_of(t)
        sets.append({tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    ids = {g: min((docs[i][0] for i in range(len(docs)) if group[i] == g and docs[i][0] is not None), default=None) for g in set(group)}
    return [(docs[i][0], len(sets[i]), ids[group[i]] if sets[i] else docs[i][0]) for i in range(len(docs))]


def test_ngram_join(spark, odd_dir):
    got = Counter(tuple(r) for r in QUERIES["op6_ngram_jaccard"](spark, odd_dir).collect())
    assert got == Counter(brute_components(documents(spark, odd_dir), 4, 85))


@pytest.mark.parametrize(("n", "percent", "chunk"), [(4, 85, 2_000_000), (5, 80, 2_000_000), (2, 70, 60), (4, 85, 200)])
def test_ngram_join_on_edited_copies(spark, n, percent, chunk):
    import random

    rng, docs = random.Random(n * percent + chunk), []
    for i in range(90):
        if docs and rng.random() < 0.7:
            w = rng.choice(docs)[1].split()
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice("pqrst")
            w = w[: max(1, len(w) - rng.randrange(0, 5))]
        else:
            w = [rng.choice("abcdefghijklmnop") + str(rng.randrange(30)) for _ in range(rng.choice([1, 3, 6, 20, 60, 150]))]
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = ngramjoin.jaccard_components(df, n, percent, chunk=chunk).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter(brute_components(docs, n, percent))


def test_keep_one_keeps_one(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    out = ngramjoin.keep_one(spark, docs, odd_dir)
    assert out.columns == docs.columns
    kept = Counter(r["doc_id"] for r in out.collect())
    brute = brute_components(documents(spark, odd_dir), 5, 80)
    assert sum(kept.values()) == len({c for _, n, c in brute if n}) + sum(1 for _, n, _ in brute if not n)
    assert set(kept.values()) == {1}


def test_top_k(spark, odd_dir):
    data = spark.read.parquet(f"{odd_dir}/embeddings.parquet").collect()
    rows = {(r["vec_id"], tuple(math.floor(256 * x) for x in r["embedding"])) for r in data if r["vec_id"] is not None and r["embedding"] is not None and all(x is not None and math.isfinite(x) for x in r["embedding"])}
    want = set()
    for q, v in rows:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v))[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in QUERIES["op7_top_k"](spark, odd_dir).collect()} == want


def test_top_k_in_chunks(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    data = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(4)
    one = topk.top_k(df, df.where("vec_id % 5 = 0"), k=3)
    many = topk.top_k(df, df.where("vec_id % 5 = 0"), k=3, query_bytes=800)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) and one.count() == 240


@pytest.mark.parametrize("block_chars", [lmscore.BLOCK_CHARS, 50_000])
def test_lm_counts(spark, odd_dir, monkeypatch, block_chars):
    from pyspark.sql import functions as F

    from chronofold.llm.common import hold_out

    monkeypatch.setattr(lmscore, "STEPS", 10)
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    got = lmscore.score(docs, ~hold_out(F.col("doc_id"), 7, 2), block_chars=block_chars).collect()
    held = lambda i: binascii.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count = Counter()
    for i, t in documents(spark, odd_dir):
        if not held(i):
            count.update([*words_of(t), None])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t in documents(spark, odd_dir):
        tokens = [*words_of(t), None]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens)
        want[(i, len(tokens), sum(count[w] > 0 for w in tokens), n, round(base, 4))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_licences(spark, odd_dir):
    rows = {r["doc_id"]: r for r in QUERIES["op10_licence_scan"](spark, odd_dir).collect()}
    assert rows[13]["licences"] == "CC-BY-NC-4.0,MIT" and rows[13]["n_sentences"] == 3 and rows[0]["licences"] == "" and rows[4]["n_sentences"] == 0


def test_pipeline_rows(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, odd_dir)
        assert "text" in docs.columns
    out = corpus_pipeline.STAGES[-1][1](spark, docs, odd_dir).collect()
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in out)
