"""Every query with an oracle gives DuckDB's rows at sf0.01."""

import math
from collections import Counter

import pytest

from tarn.plans.registry import ORACLES, QUERIES
from tarn.plans.views import load

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, db, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = db.sql(ORACLES[name]).select(*(f'"{c}"' for c in columns)).fetchall()
    got = Counter(tuple(map(plain, r)) for r in found.select(*columns).collect())
    assert got == Counter(tuple(map(plain, r)) for r in want)


def test_every_query_has_an_oracle():
    assert sorted(QUERIES) == sorted(ORACLES)


def test_shore_ring_covers_every_site(spark):
    found, pixels = QUERIES["shore_ring"](spark, SF), load(spark, SF, "v_pixels")
    assert found.count() == pixels.count()
    assert found.select("lake_id").distinct().count() == 100
