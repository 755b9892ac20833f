"""Pixel statistics, indices and texture."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.constants import BANDS, INPUT_BANDS, INPUT_MEAN, INPUT_STD
from tarn.operators import pixels as px
from tarn.operators.texture import texture
from tarn.plans.base import query, rounded
from tarn.plans.views import tasks

_ALL = " AND ".join(f"{b} IS NOT NULL" for b in BANDS)
_X = "SELECT lake_id, year, r, c, " + ", ".join(f"{b} / 10000.0 AS {b}" for b in BANDS) + f" FROM v_bands WHERE {_ALL}"


def _ratio(top: str, bottom: str) -> str:
    return f"CASE WHEN abs({bottom}) > 1e-10 THEN ({top}) / ({bottom}) ELSE 0.0 END"


_INDEX = {
    "ndvi": _ratio("b8 - b4", "b8 + b4"),
    "evi": f"2.5 * ({_ratio('b8 - b4', 'b8 + 6 * b4 - 7.5 * b2 + 1')})",
    "savi": _ratio("(b8 - b4) * 1.5", "b8 + b4 + 0.5"),
    "msavi": "(2 * b8 + 1 - sqrt(greatest(0.0, (2 * b8 + 1) * (2 * b8 + 1) - 8 * (b8 - b4)))) / 2",
    "gci": f"({_ratio('b8', 'b3')}) - 1",
    "ndre": _ratio("b8a - b5", "b8a + b5"),
    "ndwi": _ratio("b3 - b8", "b3 + b8"),
    "mndwi": _ratio("b3 - b11", "b3 + b11"),
    "ndmi": _ratio("b8 - b11", "b8 + b11"),
    "awei": "4 * (b3 - b11) - (0.25 * b8 + 2.75 * b12)",
    "nbr": _ratio("b8 - b12", "b8 + b12"),
    "nbr2": _ratio("b11 - b12", "b11 + b12"),
    "bsi": _ratio("(b11 + b4) - (b8 + b2)", "(b11 + b4) + (b8 + b2)"),
    "ndbi": _ratio("b11 - b8", "b11 + b8"),
}
_R = lambda x: f"round({x}, 6) + 0.0"
_R12 = lambda x: f"round({x}, 12) + 0.0"

_BAND_SQL = "SELECT lake_id, year, " + ", ".join(
    f"{_R(f'{f}({b})')} AS {b}_{s}"
    for b in BANDS
    for f, s in (("avg", "mean"), ("stddev_pop", "std"), ("min", "min"), ("max", "max"), ("median", "median"))
) + " FROM v_bands GROUP BY lake_id, year"


@query(_BAND_SQL, "v_bands")
def band_statistics(spark, pixels):
    return rounded(px.band_statistics(pixels))


_CLEAR_SQL = f"""SELECT lake_id, year, round(avg(clear_count), 4) AS clear_mean, min(clear_count) AS clear_min, median(clear_count) AS clear_median
                 FROM v_bands WHERE {_ALL} GROUP BY lake_id, year"""


@query(_CLEAR_SQL, "v_bands")
def clear_obs_statistics(spark, pixels):
    return px.clear_statistics(pixels)


_PIXEL_SQL = f"""
    SELECT lake_id, year, n AS pixel_count, v AS valid_count, n - v AS nodata_count, round(v * 100.0 / n, 4) AS coverage_pct,
           round((n - v) * 100.0 / n, 4) AS cloud_pct, round(v * 1.0 / n, 6) AS valid_ratio
    FROM (SELECT lake_id, year, count(*) AS n, count(*) FILTER ({_ALL}) AS v FROM v_bands GROUP BY lake_id, year) t"""


@query(_PIXEL_SQL.replace("100.0", "CAST(100 AS double)").replace("1.0 /", "CAST(1 AS double) /"), "v_bands")
def pixel_statistics(spark, pixels):
    return px.pixel_statistics(pixels)


_VALID_WATER_SQL = f"""
    SELECT lake_id, year, water AS water_count, vegetation AS vegetation_count, soil AS soil_count,
           round(water / CAST(n AS double) * 100, 4) AS water_pct, round(vegetation / CAST(n AS double) * 100, 4) AS vegetation_pct,
           round(soil / CAST(n AS double) * 100, 4) AS soil_pct, round(water * 900.0 / 1e6, 6) AS water_km2,
           round((n - water) * 900.0 / 1e6, 6) AS land_km2,
           CASE WHEN n > water THEN round(water / CAST(n - water AS double), 6) ELSE 0.0 END AS water_land_ratio
    FROM (SELECT lake_id, year, count(*) AS n, count(*) FILTER (k = 'water') AS water,
                 count(*) FILTER (k = 'vegetation') AS vegetation, count(*) FILTER (k = 'soil') AS soil
          FROM (SELECT lake_id, year, CASE WHEN mndwi > 0 OR (ndwi > -0.05 AND ndvi < 0.1) THEN 'water'
                                           WHEN ndvi > 0.2 THEN 'vegetation' ELSE 'soil' END AS k
                FROM (SELECT lake_id, year, {", ".join(f"{_INDEX[i]} AS {i}" for i in ("ndvi", "ndwi", "mndwi"))} FROM ({_X}) x) i) k
          GROUP BY lake_id, year) t"""


_WATER_SQL = "SELECT k.lake_id, k.year, " + ", ".join(
    f"coalesce(t.{c}, 0) AS {c}"
    for c in "water_count vegetation_count soil_count water_pct vegetation_pct soil_pct water_km2 land_km2 water_land_ratio".split()
) + f" FROM (SELECT DISTINCT lake_id, year FROM v_bands) k LEFT JOIN ({_VALID_WATER_SQL}) t ON k.lake_id = t.lake_id AND k.year = t.year"


@query(_WATER_SQL, "v_bands")
def water_statistics(spark, pixels):
    return px.water_statistics(pixels)


@query(f"SELECT lake_id, year, r, c, {', '.join(f'{_R(sql)} AS {n}' for n, sql in _INDEX.items())} FROM ({_X}) x", "v_bands")
def spectral_indices_pixels(spark, pixels):
    return rounded(px.index_pixels(pixels))


_INDEX_SQL = " UNION ALL ".join(
    f"""SELECT lake_id, year, '{n}' AS index_name, {_R12(f'avg({sql})')} AS mean, {_R12(f'stddev_pop({sql})')} AS std,
        {_R12(f'min({sql})')} AS min, {_R12(f'max({sql})')} AS max, {_R12(f'median({sql})')} AS median,
        {_R12(f'quantile_cont({sql}, 0.25)')} AS p25, {_R12(f'quantile_cont({sql}, 0.75)')} AS p75
        FROM ({_X}) x GROUP BY lake_id, year"""
    for n, sql in _INDEX.items()
)


@query(_INDEX_SQL, "v_bands")
def index_statistics(spark, pixels):
    return rounded(px.index_statistics(pixels), digits=12)


_SUM = " + ".join(BANDS)
_SUMMARY_SQL = f"""
    SELECT lake_id, year, round(bright, 6) AS visible_brightness, round(nir_red, 6) AS nir_red_difference,
           round(green_swir, 6) AS green_swir_difference, round(variance, 6) AS spectral_variance,
           round(-({" + ".join(f"CASE WHEN m_{b} > 0 THEN m_{b} / s * log2(m_{b} / s) ELSE 0 END" for b in BANDS)}) / log2(11), 6) AS spectral_entropy
    FROM (SELECT *, {" + ".join(f"m_{b}" for b in BANDS)} AS s FROM (
        SELECT lake_id, year, avg((b2 + b3 + b4) / 3) AS bright, avg(b8 - b4) AS nir_red, avg(b3 - b11) AS green_swir,
               avg(({" + ".join(f"({b} - m) * ({b} - m)" for b in BANDS)}) / 11) AS variance,
               {", ".join(f"avg({b}) AS m_{b}" for b in BANDS)}
        FROM (SELECT *, ({_SUM}) / 11 AS m FROM v_bands WHERE {_ALL}) p GROUP BY lake_id, year) a) t"""


@query(_SUMMARY_SQL, "v_bands")
def spectral_summary(spark, pixels):
    return px.spectral_summary(pixels)


_GLCM_SQL = """
    WITH ends AS (SELECT lake_id, year, min(b8) AS lo, max(b8) AS hi FROM v_bands WHERE b8 IS NOT NULL
                  GROUP BY lake_id, year HAVING count(*) >= 4),
    lv AS (SELECT p.lake_id, p.year, r, c,
                  CASE WHEN hi > lo THEN CAST(floor((b8 - lo) / (hi - lo) * 63) AS int) ELSE 0 END AS lvl
           FROM v_bands p JOIN ends e ON p.lake_id = e.lake_id AND p.year = e.year WHERE b8 IS NOT NULL),
    off AS (SELECT * FROM (VALUES (0, 0, 1), (1, -1, 1), (2, -1, 0), (3, -1, -1)) o(k, dy, dx)),
    pr AS (SELECT a.lake_id, a.year, k, a.lvl AS i, b.lvl AS j FROM lv a CROSS JOIN off
           JOIN lv b ON a.lake_id = b.lake_id AND a.year = b.year AND b.r = a.r + dy AND b.c = a.c + dx),
    cnt AS (SELECT lake_id, year, k, i, j, count(*) AS n FROM (SELECT * FROM pr UNION ALL SELECT lake_id, year, k, j, i FROM pr) s
            GROUP BY lake_id, year, k, i, j),
    p AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY lake_id, year, k) AS double) AS p FROM cnt),
    per AS (SELECT lake_id, year, k, sum((i - j) * (i - j) * p) AS contrast, sum(abs(i - j) * p) AS dissimilarity,
                   sum(p / (1 + (i - j) * (i - j))) AS homogeneity, sum(p * p) AS energy, -sum(p * log2(p)) AS entropy,
                   sum(i * p) AS mu, sum(i * i * p) AS sq, sum(i * j * p) AS pd
            FROM p GROUP BY lake_id, year, k)
    SELECT lake_id, year, round(avg(contrast), 6) AS glcm_contrast, round(avg(dissimilarity), 6) AS glcm_dissimilarity,
           round(avg(homogeneity), 6) AS glcm_homogeneity, round(avg(energy), 6) AS glcm_energy, round(avg(entropy), 6) + 0.0 AS glcm_entropy,
           round(avg(CASE WHEN sq - mu * mu > 1e-12 THEN (pd - mu * mu) / (sq - mu * mu) ELSE 0.0 END), 6) + 0.0 AS glcm_correlation
    FROM per GROUP BY lake_id, year"""


@query(f"SELECT * FROM ({_GLCM_SQL}) g", "v_bands", "lineitem")
def glcm_texture(spark, pixels, lineitem):
    return rounded(texture(pixels, tasks=tasks(lineitem)))


_WIDE_INDEX_SQL = "SELECT lake_id, year, " + ", ".join(
    f"{_R12(f'{f}({sql})')} AS {n}_{s}"
    for n, sql in _INDEX.items()
    for f, s in (("avg", "mean"), ("stddev_pop", "std"), ("min", "min"), ("max", "max"))
) + ", " + ", ".join(
    f"{_R12(f'quantile_cont({_INDEX[n]}, {p})')} AS {n}_{s}" for n in px.QUARTILED for p, s in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"))
) + f" FROM ({_X}) x GROUP BY lake_id, year"


@query(
    f"""SELECT * FROM ({_PIXEL_SQL.replace("100.0", "CAST(100 AS double)").replace("1.0 /", "CAST(1 AS double) /")}) p
        LEFT JOIN ({_CLEAR_SQL}) c USING (lake_id, year) LEFT JOIN ({_WATER_SQL}) w USING (lake_id, year)
        LEFT JOIN ({_SUMMARY_SQL}) s USING (lake_id, year) LEFT JOIN ({_BAND_SQL}) b USING (lake_id, year)
        LEFT JOIN ({_WIDE_INDEX_SQL}) i USING (lake_id, year) LEFT JOIN ({_GLCM_SQL}) g USING (lake_id, year)""",
    "v_bands",
    "lineitem",
)
def lake_features_row(spark, pixels, lineitem):
    """Every statistic of a site and year in one row."""
    wide = px.site_year_features(pixels).join(texture(pixels, tasks=tasks(lineitem)), ["lake_id", "year"], "left")
    of_index = [c for c in wide.columns if c.split("_")[0] in px.INDICES]
    rest = [c for c, kind in wide.dtypes if kind == "double" and c not in of_index]
    return rounded(rounded(wide, *of_index, digits=12), *rest)


@query(
    """
    SELECT lake_id, year, r, c, CASE WHEN t1.b4 IS NOT NULL THEN t1.b4 ELSE t2.b4 END AS b4, CASE WHEN t1.b8 IS NOT NULL THEN t1.b8 ELSE t2.b8 END AS b8
    FROM (SELECT lake_id, year, r, c, CASE WHEN b4 < 500 THEN b4 END AS b4, b8 FROM v_bands WHERE c < 8) t1
    FULL JOIN (SELECT lake_id, year, r, c, b4 + 1 AS b4, b8 + 1 AS b8 FROM v_bands WHERE c >= 4) t2 USING (lake_id, year, r, c)""",
    "v_bands",
)
def mosaic_first_valid(spark, pixels):
    """Two overlapping tiles with missing values, marked as nodata in one."""
    one = pixels.where("c < 8").withColumn("b4", F.when(F.col("b4") < 500, F.col("b4")).otherwise(65535.0)).withColumn("tile_order", F.lit(0))
    two = pixels.where("c >= 4").withColumn("b4", F.col("b4") + 1).withColumn("b8", F.col("b8") + 1).withColumn("tile_order", F.lit(1))
    return px.mosaic(px.without_nodata(one.unionByName(two)), ("b4", "b8"))


@query(
    """SELECT lake_id, year, CAST(floor(r / 4) AS bigint) AS r, CAST(floor(c / 4) AS bigint) AS c, round(avg(b4), 6) AS b4, round(avg(b8), 6) AS b8
       FROM v_bands GROUP BY lake_id, year, floor(r / 4), floor(c / 4)""",
    "v_bands",
)
def overview_blocks(spark, pixels):
    return rounded(px.overview(pixels, 4, ("b4", "b8")))


@query(
    """
    SELECT lake_id, CAST(year(taken_on) AS int) AS year, r, c, CAST(round(median(v)) AS int) AS b8, count(v) AS clear_count
    FROM (SELECT l_suppkey AS lake_id, l_shipdate AS taken_on, CAST(l_orderkey % 12 AS int) AS r, CAST(l_partkey % 12 AS int) AS c,
                 CASE WHEN l_tax * 10 >= 0.3 THEN l_quantity * 10 END AS v
          FROM lineitem WHERE l_discount * 400 < 20) t
    GROUP BY lake_id, year(taken_on), r, c""",
    "lineitem",
)
def temporal_median_composite(spark, lineitem):
    """Scenes under a fifth of cloud, pixels that are clear, and their median."""
    return px.composite(*_scenes(lineitem), ("b8",), "median", 20.0, 0.3)


def _scenes(lineitem):
    rows = lineitem.select(
        F.concat_ws(
            "-", *("l_orderkey l_linenumber l_partkey l_suppkey".split()), F.col("l_quantity").cast("long"), F.round(F.col("l_tax") * 100).cast("long")
        ).alias("scene_id"),
        F.col("l_suppkey").alias("lake_id"), F.col("l_shipdate").alias("taken_on"),
        (F.col("l_discount") * 400).alias("cloud_pct"), (F.col("l_orderkey") % 12).cast("int").alias("r"),
        (F.col("l_partkey") % 12).cast("int").alias("c"), (F.col("l_quantity") * 10).alias("b8"),
        (F.col("l_tax") * 10).alias("clear"),
    )
    return rows.drop("clear"), rows.select("scene_id", "r", "c", "clear").distinct()


_CLEAR_SCENES = """
    SELECT l_suppkey AS lake_id, l_shipdate AS taken_on, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS bigint), CAST(round(l_tax * 100) AS bigint)) AS scene_id,
           CAST(l_orderkey % 12 AS int) AS r, CAST(l_partkey % 12 AS int) AS c, CASE WHEN l_tax * 10 >= 0.3 THEN l_quantity * 10 END AS v
    FROM lineitem WHERE l_discount * 400 < 20"""


@query(
    f"""SELECT lake_id, CAST(year(taken_on) AS int) AS year, r, c, CAST(round(avg(v)) AS int) AS b8, count(v) AS clear_count
        FROM ({_CLEAR_SCENES}) t GROUP BY lake_id, year(taken_on), r, c""",
    "lineitem",
)
def temporal_mean_composite(spark, lineitem):
    return px.composite(*_scenes(lineitem), ("b8",), "mean", 20.0, 0.3)


@query(
    f"""SELECT lake_id, CAST(1996 AS int) AS year, r, c, CAST(round(max(v) FILTER (place = 1)) AS int) AS b8, count(v) AS clear_count
        FROM (SELECT *, row_number() OVER (PARTITION BY lake_id, r, c ORDER BY v IS NULL, taken_on DESC, scene_id DESC) AS place
              FROM ({_CLEAR_SCENES}) t WHERE year(taken_on) = 1996) p GROUP BY lake_id, r, c""",
    "lineitem",
)
def temporal_mosaic_composite(spark, lineitem):
    """The latest clear value of each pixel in one year's scenes."""
    return px.composite(*_scenes(lineitem), ("b8",), "mosaic", 20.0, 0.3, year=1996)


@query(
    "SELECT lake_id, year, r, c, "
    + ", ".join(f"round(coalesce(({b} - {m}) / {s}, 0.0), 6) + 0.0 AS {b}" for b, m, s in zip(INPUT_BANDS, INPUT_MEAN, INPUT_STD))
    + " FROM v_bands",
    "v_bands",
)
def standardised_input(spark, pixels):
    return rounded(px.standardised(pixels))


@query(
    """SELECT CAST(o_orderkey AS bigint) AS r, CAST(o_custkey AS bigint) AS c, CAST(floor(o_orderkey / 224) AS bigint) AS window_r,
              CAST(floor(o_custkey / 224) AS bigint) AS window_c,
              CAST(floor((o_orderkey % 224) / 16) * 14 + floor((o_custkey % 224) / 16) AS bigint) AS token_id FROM orders""",
    "orders",
)
def token_windows(spark, orders):
    return px.token_windows(orders.select(F.col("o_orderkey").alias("r"), F.col("o_custkey").alias("c")))
