"""Every query that SQL can express, side by side with that SQL."""

import duckdb
import pytest

from marlstone.plans.catalogue import ORACLES, QUERIES
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(row):
    return tuple(round(x, 9) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sql):
    got = QUERIES[name](spark, DATA)
    if name not in ORACLES:
        assert got.count() >= 0
        return
    want = sql.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(repr(plain(r)) for r in got.select(*want.columns).collect()) == sorted(repr(plain(r)) for r in want.fetchall())
