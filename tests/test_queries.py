"""Every query against its SQL on the smallest driver tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from reelgrid.plans import records  # noqa: F401  registers more queries
from reelgrid.plans.queries import ORACLES, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")


def _plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = duck.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(_plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_alike(spark, name):
    one, two = (sorted(map(repr, QUERIES[name](spark, DIR).collect())) for _ in range(2))
    assert one == two and one
