"""Every query of the core with SQL gives what the SQL gives; the others run and keep their schema."""

import pytest
from compare import database, same

import __spark_entry__ as entry
from lectern.plans import changes, library, references, retrieval

CORE = {**references.QUERIES, **library.QUERIES, **retrieval.QUERIES, **changes.QUERIES}
SQL = {**references.SQL, **library.SQL, **retrieval.SQL, **changes.SQL}


@pytest.fixture(scope="module")
def con(data):
    return database(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, con, name):
    same(CORE[name](spark, data).toPandas(), con.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_runs(spark, data, name):
    assert CORE[name](spark, data).count() > 0


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_index_recall(spark, data):
    assert retrieval.knn_recall(spark, data).first()["recall"] >= 0.9


def test_entry(spark, data):
    assert entry.entry(spark).columns == ["table_name", "period", "kind", "records"]
