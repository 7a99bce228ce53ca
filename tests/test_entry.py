import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from spindrift.plans import catalogue

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def norm(rows):
    return sorted((tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_against_oracle(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, D)
    want = oracle.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    assert norm(map(tuple, df.collect())) == norm(tuple(r[i] for i in order) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_corpus_operators(tmp_path):
    top = Path(entry.__file__).resolve().parent
    shutil.copytree(top / "spindrift", tmp_path / "spindrift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q06_forecast' in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)
