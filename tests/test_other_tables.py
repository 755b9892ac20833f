"""Queries against their SQL on keys and values that the test tables lack."""

import math
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tarn.plans import views
from tarn.plans.registry import ORACLES, QUERIES

SF = Path("/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


@pytest.fixture
def agrees(spark, tmp_path):
    """Whether a query gives its SQL's rows, some tables being made by the SQL given."""

    def compare(name: str, **made: str) -> Counter:
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for file in SF.glob("*.parquet"):
            path = tmp_path / file.name
            con.execute(f"COPY ({made.get(file.stem, f'FROM {str(file)!r}')}) TO '{path}'")
            con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{path}'")
        found = QUERIES[name](spark, str(tmp_path))
        columns = sorted(found.columns)
        want = con.sql(ORACLES[name]).select(*(f'"{c}"' for c in columns)).fetchall()
        got = Counter(tuple(map(plain, r)) for r in found.select(*columns).collect())
        assert got == Counter(tuple(map(plain, r)) for r in want)
        return got

    return compare


def suppliers(keys: str, balance: str = "100.0") -> str:
    return f"SELECT CAST(k AS bigint) AS s_suppkey, concat('Supplier ', k) AS s_name, CAST(1 AS int) AS s_nationkey, CAST({balance} AS double) AS s_acctbal FROM ({keys}) t(k)"


def test_places_by_distance_where_kilometres_tie(agrees):
    """Sites 37950 and 45050 have one distance in kilometres, but not one haversine."""
    assert agrees("distance_ranks", supplier=suppliers("VALUES (37950), (45050), (12)"))


def test_tiles_that_a_polygon_just_touches(agrees):
    """The corner of a tile lies on a side of site 2651's diamond."""
    assert agrees("polygon_tiles", supplier=suppliers("VALUES (2651), (13151), (9)"))[2651, "0_1"] == 1


def test_areas_at_half_a_hundredth(agrees):
    """1002.5 / 500 is just under 2.005 as a double; the SQL rounds it down."""
    found = agrees("report_units", supplier=suppliers("SELECT range FROM range(1, 400)", "k * 5 + 2.5"))
    assert any("2.00 km²" in row for row in found)


def test_tiles_beyond_a_pole_lead_back(agrees):
    """Diamonds whose corners lie beyond the grid's end, north and south."""
    assert len(agrees("tile_plan", supplier=suppliers("VALUES (689), (827), (643), (46), (1746), (5)"))) > 20


@pytest.mark.parametrize("name", ["index_statistics", "band_statistics"])
def test_pixels_are_shuffled_once_by_site_and_year(spark, name):
    """Rows lie by site and year from the first, so the statistics add no shuffle of pixels."""
    plan = QUERIES[name](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_tasks_of_pixels_grow_in_number_not_in_size(spark, monkeypatch):
    """Pixels and counts of pairs are dealt to as many tasks as the table's rows ask for."""
    monkeypatch.setattr(views, "TASK_ROWS", 500, raising=False)
    rows, cores = views.load(spark, str(SF), "lineitem").count(), spark.sparkContext.defaultParallelism
    held = views.load(spark, str(SF), "v_pixels").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert held <= 1000
    for name in ("lake_features_row", "glcm_texture"):
        plan = QUERIES[name](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
        dealt = set(re.findall(r"Exchange hashpartitioning\(.*, (\d+)\)", plan))
        assert dealt == {str(cores * math.ceil(rows / (500 * cores)))}


def test_pixels_of_windows_stay_in_their_task(spark):
    """Dense windows are put together once, and no window's array goes between tasks."""
    plan = QUERIES["dense_windows"](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "pixels#" not in plan
