import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{ROOT / 'tests'}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").config("spark.log.level", "ERROR").config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    if not DATA.exists():
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(rows):
    """Rows as sorted tuples of strings, by column name."""
    return sorted(tuple(str(r[k]) for k in sorted(r)) for r in rows)


def same(spark, duck, query, sql):
    got = [r.asDict() for r in query(spark, str(DATA)).collect()]
    rel = duck.execute(sql)
    names = [c[0] for c in rel.description]
    want = [dict(zip(names, r)) for r in rel.fetchall()]
    assert plain(got) == plain(want)
    if got and want:
        assert sorted(got[0]) == sorted(want[0])
