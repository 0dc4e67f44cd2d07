import os

import duckdb
import pytest

import __spark_entry__ as entries
from lectern.llm import queries
from tests.test_entry import DATA, TABLES, _normal


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no sample tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    result = entries.queries()[name](spark, DATA)
    expected = db.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    rows = expected.fetchall()
    assert sorted(result.columns) == sorted(columns)
    assert _normal([tuple(r) for r in result.collect()], result.columns) == _normal(rows, columns)
