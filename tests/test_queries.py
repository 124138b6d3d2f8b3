"""Every core query against its SQL on the smallest tables."""

import pytest
from conftest import DATA, same

from graphloom.plans import graph_queries, key_graph, level_queries

MODULES = [graph_queries, level_queries, key_graph]
CASES = {n: (q, m.SQL.get(n)) for m in MODULES for n, q in m.QUERIES.items()}


@pytest.mark.parametrize("name", [n for n, (_, s) in CASES.items() if s])
def test_against_sql(spark, duck, name):
    same(spark, duck, *CASES[name])


@pytest.mark.parametrize("name", [n for n, (_, s) in CASES.items() if not s])
def test_runs(spark, name):
    if not DATA.exists():
        pytest.skip("no test tables here")
    df = CASES[name][0](spark, str(DATA))
    assert df.columns and df.count() >= 0


def test_entry_point():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(CASES) <= set(e.queries())


def test_core_stands_alone():
    from pathlib import Path

    root = Path(graph_queries.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "graphloom.llm" not in f.read_text(), f
