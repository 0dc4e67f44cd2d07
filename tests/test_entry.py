import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entries
from jobs import queries as jobs
from lectern.plans import catalogue
from tests.conftest import ROOT

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_the_registry_works_without_the_training_data_operators():
    code = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "lectern.llm") or name.startswith("lectern.llm."):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert "bm25_topk" in e.queries() and "pipeline" not in e.queries() and set(e.oracle_sql()) <= set(e.queries())
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}).returncode == 0


def test_a_missing_library_is_not_taken_for_a_missing_subpackage():
    code = """
import importlib.util, sys
if importlib.util.find_spec("lectern.llm") is not None and importlib.util.find_spec("corpus_pipeline") is not None:
    class Block:
        def find_spec(self, name, path=None, target=None):
            if name == "ahocorasick":
                raise ModuleNotFoundError(name, name=name)
    sys.meta_path.insert(0, Block())
    try:
        import __spark_entry__
    except ModuleNotFoundError:
        sys.exit(0)
    sys.exit(1)
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}).returncode == 0


def _normal(rows, columns):
    def value(x):
        if isinstance(x, bool) or x is None:
            return x
        return round(float(x), 6) if isinstance(x, (int, float)) or type(x).__name__ == "Decimal" else str(x)

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no sample tables")
@pytest.mark.parametrize("name", sorted(catalogue.SQL | jobs.SQL))
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    sql = entries.oracle_sql()[name]
    result = entries.queries()[name](spark, DATA)
    expected = db.sql(sql).fetchall()
    columns = [d[0] for d in db.execute(sql).description]
    assert sorted(result.columns) == sorted(columns)
    assert _normal([tuple(r) for r in result.collect()], result.columns) == _normal(expected, columns)
