"""Every registered query against its SQL on the smallest tables."""

import __spark_entry__ as entry
import pytest
from compare import duck, duck_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["person_id", "contra_vote_score"]
    assert df.count() > 0


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, con, key):
    cols, rows = spark_rows(QUERIES[key](spark, FOLDER))
    if key in ORACLES:
        assert (cols, rows) == duck_rows(con, ORACLES[key])
    else:
        assert rows
