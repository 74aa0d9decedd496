"""Every registered query against its SQL twin, with tiny blocks."""

import check
import pytest
from conftest import DATA

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLES:
        error = check.compare(df, duck, ORACLES[name])
        assert error is None or error == "EMPTY" and not duck.execute(ORACLES[name]).fetchall()
    else:
        assert df.count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
