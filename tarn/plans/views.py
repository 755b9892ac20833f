"""Views that give the test tables the shapes of the domain.

The same SQL text runs in Spark and in DuckDB.  A view names what it reads in
braces; tables are read from Parquet.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "v_embed": """
        SELECT CAST(floor(vec_id / 10) AS bigint) AS lake_id, CAST(2016 + vec_id % 10 AS int) AS year, embedding, label
        FROM {embeddings}""",
    "v_embed_shifted": "SELECT lake_id, CAST(year - 21 AS int) AS year, embedding FROM {v_embed}",
    "v_lakes": """
        SELECT s_suppkey AS lake_id, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS lake_name,
               r_name AS country, n_name AS state, round(abs(s_acctbal) / 500, 2) AS area_sqkm,
               abs(s_acctbal) / 500 >= 2 AS is_active,
               CASE WHEN s_suppkey % 7 <> 0 THEN CAST((s_suppkey * 37) % 1700 AS double) / 10 - 85 END AS center_lat,
               CASE WHEN s_suppkey % 7 <> 0 THEN CAST((s_suppkey * 53) % 3500 AS double) / 10 - 175 END AS center_lon,
               CASE WHEN s_suppkey % 5 <> 0 THEN CAST((s_suppkey * 37) % 1700 AS double) / 10 - 84.5 END AS pour_lat,
               CASE WHEN s_suppkey % 5 <> 0 THEN CAST((s_suppkey * 53) % 3500 AS double) / 10 - 174.5 END AS pour_lon
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "v_pixels": """
        SELECT l_suppkey AS lake_id, CAST(year(l_shipdate) AS int) AS year,
               CAST(l_orderkey % 12 AS int) AS r, CAST(l_partkey % 12 AS int) AS c,
               CAST(min(200 + l_linenumber * 37) AS double) AS b1, min(300 + l_quantity * 11) AS b2,
               min(350 + l_quantity * 9 + l_linenumber * 13) AS b3, CAST(min(250 + l_partkey % 500) AS double) AS b4,
               CAST(min(260 + l_partkey % 450) AS double) AS b5, CAST(min(240 + l_orderkey % 700) AS double) AS b6,
               CAST(min(230 + l_orderkey % 650) AS double) AS b7, CAST(min(100 + l_orderkey % 900) AS double) AS b8,
               CAST(min(110 + l_orderkey % 880) AS double) AS b8a, min(80 + round(l_discount * 100) * 50) AS b11,
               min(60 + round(l_tax * 100) * 40) AS b12, CAST(min(l_linenumber * 3) AS double) AS clear_count,
               max(CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 1 ELSE 0 END) = 0 AS valid
        FROM {lineitem} GROUP BY l_suppkey, year(l_shipdate), l_orderkey % 12, l_partkey % 12""",
    # bands of invalid pixels are null
    "v_bands": """
        SELECT lake_id, year, r, c, """
    + ", ".join(f"CASE WHEN valid THEN {b} END AS {b}" for b in "b1 b2 b3 b4 b5 b6 b7 b8 b8a b11 b12".split())
    + """, clear_count, valid FROM {v_pixels}""",
    "v_features": """
        SELECT lake_id, year, avg(b2) AS b2_mean, avg(b3) AS b3_mean, avg(b4) AS b4_mean, avg(b5) AS b5_mean,
               avg(b6) AS b6_mean, avg(b7) AS b7_mean, CASE WHEN (lake_id + year) % 11 <> 0 THEN avg(b8) END AS b8_mean,
               'completed' AS status, 2 AS feature_version
        FROM {v_pixels} WHERE valid GROUP BY lake_id, year""",
    "v_tiles": """
        SELECT o_custkey % 60 AS lake_id, CAST(year(o_orderdate) AS int) AS year,
               concat(CAST(o_orderkey % 3 AS string), '_', CAST(o_orderkey % 2 AS string)) AS tile_index,
               CASE min(CASE WHEN o_orderkey % 29 = 0 THEN 1 WHEN o_orderkey % 31 = 0 THEN 2 ELSE 3 END)
                    WHEN 1 THEN 'FAILED' WHEN 2 THEN 'PENDING' ELSE 'COMPLETED' END AS status,
               CAST(max(floor(o_totalprice)) AS bigint) AS file_size_bytes, max(o_orderdate) AS updated_at,
               concat('/data', CAST(min(o_orderkey % 2) AS string), '/', CAST(year(o_orderdate) AS string), '/lake_',
                      lpad(CAST(o_custkey % 60 AS string), 6, '0'), '/tile_', CAST(o_orderkey % 3 AS string), '_',
                      CAST(o_orderkey % 2 AS string), '.tif') AS image_path
        FROM {orders}
        GROUP BY o_custkey % 60, year(o_orderdate), o_orderkey % 3, o_orderkey % 2""",
    "v_images": """
        SELECT o_custkey % 60 AS lake_id, CAST(year(o_orderdate) AS int) AS year,
               CASE max(o_orderkey) % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'completed' ELSE 'merged' END AS status,
               CAST(sum(floor(o_totalprice)) AS bigint) AS file_size_bytes, max(o_orderdate) AS updated_at,
               CASE WHEN max(o_orderkey) % 5 = 0 THEN concat('error ', CAST(max(o_orderkey) % 7 AS string)) END AS error_message
        FROM {orders} GROUP BY o_custkey % 60, year(o_orderdate)""",
    "v_results": """
        SELECT lake_id, year, CASE WHEN (lake_id + year) % 7 = 0 THEN 'failed' ELSE 'completed' END AS status,
               CASE WHEN (lake_id * 3 + year) % 11 = 0 THEN 1 ELSE 2 END AS feature_version,
               CASE WHEN (lake_id + year) % 4 = 0 THEN updated_at - INTERVAL 1 DAY ELSE updated_at END AS updated_at
        FROM {v_images} WHERE (lake_id + 2 * year) % 5 <> 0""",
    "v_regions": """
        SELECT lake_id, CAST(year - 21 AS int) AS year, embedding,
               CASE WHEN (lake_id + year) % 13 <> 0 THEN embedding END AS lake_embedding,
               CASE WHEN (lake_id + year) % 3 <> 0 THEN embedding END AS shore_embedding,
               CASE WHEN (lake_id + year) % 3 = 0 THEN 1.0 WHEN lake_id % 4 = 0 THEN 0.6 ELSE 0.7 END AS lake_weight,
               CASE WHEN (lake_id + year) % 17 = 0 THEN 'failed' ELSE 'completed' END AS status,
               CASE WHEN (lake_id * 3 + year) % 19 = 0 THEN 1 ELSE 2 END AS embedding_version
        FROM {v_embed}""",
    "v_states": """
        SELECT n_name AS area_name, CAST(n_nationkey % 5 AS double) * 70 - 175 AS west,
               CAST(n_nationkey % 5 AS double) * 70 - 105 AS east,
               CAST(floor(n_nationkey / 5) * 34 - 85 AS double) AS south,
               CAST(floor(n_nationkey / 5) * 34 - 51 AS double) AS north
        FROM {nation} WHERE n_nationkey % 6 <> 5""",
    "v_tokens": """
        SELECT lake_id, year, CAST(label AS double) / 9 AS lake_frac, CAST((label + lake_id) % 4 AS double) / 4 AS shore_frac,
               CAST(1 AS double) AS valid_frac, embedding AS vec
        FROM (SELECT lake_id, CAST(2016 + year % 2 AS int) AS year, label, embedding FROM {v_embed}) t""",
    "v_series": "SELECT user_id % 20 AS lake_id, CAST(event_id % 37 AS int) AS year, max(value) AS value FROM {events} GROUP BY user_id % 20, event_id % 37",
}


def needs(name: str) -> list[str]:
    """Tables and views that a view reads."""
    return re.findall(r"\{(\w+)\}", VIEWS[name])


#: How a table's rows lie for a view, so that what groups or joins the view by site and
#: year needs no further shuffle of pixels.
LAID = {("v_pixels", "lineitem"): ("l_suppkey", "year(l_shipdate)")}
#: Rows of such a table that one task gets, about.  What follows keeps all of a task's
#: pixels in several aggregations at a time, so tasks grow in number, not in size.
TASK_ROWS = 200_000


def in_spark(sql: str) -> str:
    """A view's text for Spark, with rounding to places as DuckDB does it.

    DuckDB rounds the number times a power of ten, Spark its shortest decimals: of
    1002.5 / 500, a double just under 2.005, the one makes 2.0 and the other 2.01.
    """
    return re.sub(r"\bround\(([^,]*), (\d)\)", lambda m: f"round(({m[1]}) * 1e{m[2]}) / 1e{m[2]}", sql)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a view over tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(in_spark(VIEWS[name]), **{n: laid(load(spark, sf_dir, n), name, n) for n in needs(name)})


def laid(table: DataFrame, view: str, name: str) -> DataFrame:
    keys = LAID.get((view, name))
    return table.repartition(tasks(table), *map(F.expr, keys)) if keys else table


def tasks(table: DataFrame) -> int:
    """How many tasks share a table's rows, the same number for each core; Parquet counts by its footers."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return cores * max(1, math.ceil(table.count() / (TASK_ROWS * cores)))


def oracle(sql: str) -> str:
    """``sql`` for DuckDB, with the views it uses before it."""
    ordered: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in ordered:
                add(VIEWS[name])
                ordered.append(name)

    add(sql)
    if not ordered:
        return sql
    plain = {n: re.sub(r"\{(\w+)\}", r"\1", VIEWS[n]) for n in ordered}
    return "WITH " + ",\n".join(f"{n} AS ({text})" for n, text in plain.items()) + "\n" + sql
