"""Every registered query against its SQL in DuckDB."""

import duckdb
import pytest

from tessera import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"
#: Queries for rare rows, of which so small tables hold none.
MAY_BE_EMPTY = ("page_same_listing", "part_duplicate_components", "order_contains_supplier")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    return con


def rows(frame, columns):
    shown = lambda v: "null" if v is None or v != v else f"{v:.4f}" if isinstance(v, float) else str(v)
    return sorted(tuple(shown(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    found = plans.QUERIES[name](spark, DATA).toPandas()
    assert len(found) or name in MAY_BE_EMPTY
    if name in plans.ORACLES:
        want = duck.sql(plans.ORACLES[name]).df()
        columns = sorted(want.columns)
        assert sorted(found.columns) == columns
        assert rows(found, columns) == rows(want, columns)
