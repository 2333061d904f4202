"""Pipeline stages keep columns that bear the names the operators use themselves."""

import pytest

import corpus_pipeline

NAMES = ("stay_id", "stay_set", "set_id", "set_id__", "doubt__", "first__", "copy_no", "n_copies", "shuffle_key", "mix_source__", "mix_cdf__", "mix_salt__", "component", "component_id",
         "has_letter__", "lang_pred", "lang_pred__", "score", "score__", "predicted", "hot__", "rows", "n_shingles", "block", "Copy_No_")


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES[:-1]], ids=lambda s: s[0])
def test_clashing_columns_come_back_as_they_were(spark, odd_dir, stage):
    texts = ["one two three four five six seven eight nine ten eleven twelve " + "abcdefgh"[k % 4] * 3 for k in range(12)] + [None, ""]
    rows = [(k, t, "en", "s", 1, *(-k * 100 - j for j in range(len(NAMES)))) for k, t in enumerate(texts)]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` long" for n in NAMES)
    docs = spark.createDataFrame(rows, ddl)
    out = stage[1](spark, docs, odd_dir)
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    assert got and set(got) <= set(rows)
