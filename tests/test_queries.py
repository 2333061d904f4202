"""Every event query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from chronofold.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    show = lambda v: "" if pd.isna(v) else f"{v:.7g}" if isinstance(v, float) else str(v)
    return sorted("|".join(map(show, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_imports_without_the_training_data_package(tmp_path):
    import subprocess
    import sys

    block = "import sys; sys.modules['corpus_pipeline'] = None\n"
    code = block + "import importlib.abc\nclass Gone(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path=None, target=None):\n        if name.startswith('chronofold.llm') or name == 'corpus_pipeline':\n            raise ModuleNotFoundError(name=name)\nsys.modules.pop('corpus_pipeline'); sys.meta_path.insert(0, Gone())\nimport __spark_entry__ as e\nassert 'single_stream_fold' in e.queries() and not [k for k in e.queries() if k.startswith('op')]"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(__file__)), check=False).returncode == 0
