"""Every query of the engine against its SQL, on whole tables."""

import oracle
import pytest

from quillweave.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    assert oracle.spark_rows(QUERIES[name](spark, SF)) == oracle.duck_rows(duck, SQL[name])


def test_entry_imports():
    import __spark_entry__ as e

    assert set(SQL) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
