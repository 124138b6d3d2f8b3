"""The pN_ queries against their SQL on the smallest tables, or their form where there is none."""

import pytest
from conftest import DATA, same

from graphloom.llm import queries as q

FORMS = {
    "p1_found": {"entity_id", "field_name"}, "p6_found": {"table_name", "record_id", "type_id"}, "p8_ids": {"doc_id", "ids"}, "p10_found": {"doc_id"},
    "p4_groups": {"doc_id", "class_id", "group_id", "n_class", "n_links"},
}


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_against_sql(spark, duck, name):
    same(spark, duck, q.QUERIES[name], q.SQL[name])


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL)))
def test_runs(spark, name):
    if not DATA.exists():
        pytest.skip("no test tables here")
    df = q.QUERIES[name](spark, str(DATA))
    rows = df.collect()
    assert set(df.columns) == FORMS.get(name, set(df.columns))
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
