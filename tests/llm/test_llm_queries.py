"""The queries of the subpackage: against SQL where there is one, else that they run and keep their columns."""

import pytest
from compare import database, same

from lectern.llm.queries import QUERIES
from lectern.llm.sql import SQL

COLUMNS = {
    "p1_found": {"name_a", "name_b"}, "p2_found": {"job_id", "defect"}, "p4_found": {"transcript_id", "cut"}, "p5_found": {"id_a", "id_b"},
    "p7_found": {"transcript_id"}, "p9_found": {"doc_id", "item_id"}, "p10_found": {"doc_id"},
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, name):
    same(QUERIES[name](spark, data).toPandas(), database(data).sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.count() > 0
    if name in COLUMNS:
        assert set(df.columns) == COLUMNS[name]
        assert df.count() == df.distinct().count()
