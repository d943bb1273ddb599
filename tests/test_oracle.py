"""Every registered query with SQL against DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from viatrix.plans import registry

NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(frame):
    def value(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        return f"{x:.7g}" if isinstance(x, float) else str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(value(x) for x in row) for row in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, sf_dir, name):
    ours = registry.queries()[name](spark, sf_dir).toPandas()
    if (sql := registry.oracle_sql().get(name)) is None:
        assert len(ours)
        return
    theirs = duck.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)
