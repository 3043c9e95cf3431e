"""Every query with SQL gives the rows of its SQL in DuckDB."""

import duckdb
import pytest

from lexiflow.plans import catalog
from lexiflow.sources.tables import TABLES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    value = lambda v: None if isinstance(v, float) and v != v else round(float(v), 5) + 0.0 if isinstance(v, float) else v
    return sorted(repr(tuple(value(r[k]) for k in order)) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_its_sql(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())
