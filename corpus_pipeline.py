"""The corpus pipeline: five stages over ``documents``, each one of the training-data operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``. A cluster job writes each stage as Parquet and hands the reread table to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronofold.llm.bpe import encode_stage
from chronofold.llm.common import checkpointed, table
from chronofold.llm.langid import keep_identified
from chronofold.llm.mixing import mix_stage
from chronofold.llm.ngramjoin import keep_one
from chronofold.llm.toxicity import keep_clean

STAGES = [
    ("toxicity", keep_clean),
    ("language_id", keep_identified),
    ("near_duplicates", keep_one),
    ("mixing", mix_stage),
    ("byte_bpe", encode_stage),
]

#: A trained classifier and shingle components over its output have no SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are checkpointed, since the next reads them more than once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
