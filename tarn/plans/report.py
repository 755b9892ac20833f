"""Report tables, series and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions.text import image_path, kilometres, method_label, milliseconds, report_time, similarity_color, slug, square_km, trend
from tarn.operators import forecasts as fc
from tarn.operators import reports
from tarn.operators.trajectories import analogs
from tarn.plans.base import query, rounded
from tarn.plans.forecast import _FORECAST, _LONG, _TWINS, ANCHOR, METHOD, SITE, _analogs
from tarn.plans.search import _NAME, analog_ctes, named


@query(
    f"""SELECT * FROM (WITH {analog_ctes("euclidean", 3, 2025)},
        l AS (SELECT *, {_NAME} AS display_name FROM v_lakes),
        h AS (SELECT center_lat AS la, center_lon AS lo FROM v_lakes WHERE lake_id = 3),
        t AS (SELECT a.*, display_name, pow(sin(radians(center_lat - la) / 2), 2)
                     + cos(radians(la)) * cos(radians(center_lat)) * pow(sin(radians(center_lon - lo) / 2), 2) AS d
              FROM (SELECT * FROM analog WHERE place <= 10) a LEFT JOIN l ON a.lake_id = l.lake_id CROSS JOIN h)
        SELECT CAST(place AS int) AS rank, lake_id, coalesce(display_name, concat('Lake ', lake_id)) AS name, start_year, end_year,
               round(shown, 6) AS similarity_score, CASE WHEN shown >= 0.9 THEN 'Excellent' WHEN shown >= 0.8 THEN 'Strong'
               WHEN shown >= 0.7 THEN 'Moderate' ELSE 'Low' END AS quality, round(6371.0 * 2 * atan2(sqrt(d), sqrt(1 - d)), 6) AS distance_km
        FROM t) z""",
    "v_embed",
    "v_lakes",
)
def report_analogs(spark, records, sites):
    rows = reports.analog_rows(analogs(records, 3, 2025, "euclidean"), named(sites), 3)
    return rounded(rows.select("rank", "lake_id", "name", "start_year", "end_year", "similarity_score", "quality", "distance_km"))


@query(
    f"""SELECT * FROM (WITH {_LONG}, {_TWINS}
        SELECT CAST(rank AS int) AS rank, lake_id, matched_year, CAST(fixed_weight AS double) AS fixed_weight,
               {", ".join(f'round(max(delta) FILTER (h = {h}), 6) + 0.0 AS "{h}"' for h in (1, 2, 3))}
        FROM con WHERE index_name = 'ndci' GROUP BY rank, lake_id, matched_year, fixed_weight) t""",
    "v_embed_shifted",
    "v_features",
)
def twin_delta_pivot(spark, records, features):
    rows = fc.contributions(fc.twin_deltas(_analogs(records), features, SITE))
    return rounded(reports.twin_delta_table(rows, "ndci"))


@query(
    f"""SELECT index_name, h, round(expected_value - current_value, 5) + 0.0 AS change FROM ({_FORECAST}) f""",
    "v_embed_shifted",
    "v_features",
)
def forecast_items(spark, records, features):
    rows = reports.forecast_items(rounded(fc.ecological_forecast(analogs(records, SITE, ANCHOR, METHOD, 20), features, SITE, ANCHOR)))
    return rounded(rows.select("index_name", "h", "change"), digits=5)


@query(
    """SELECT lake_id, round(avg(value), 6) AS mean, round(arg_min(value, year), 6) AS first, round(arg_max(value, year), 6) AS last,
              round(arg_max(value, year) - arg_min(value, year), 6) + 0.0 AS delta,
              CASE WHEN arg_max(value, year) > arg_min(value, year) THEN 'increasing' WHEN arg_max(value, year) < arg_min(value, year) THEN 'declining' ELSE 'stable' END AS trend
       FROM v_series GROUP BY lake_id""",
    "v_series",
)
def series_summary(spark, series):
    rows = reports.series_summary(series)
    return rounded(rows.withColumn("trend", trend(F.col("first"), F.col("last"))))


@query(
    """SELECT year, a.value AS one, b.value AS two, c.value AS three FROM (SELECT year, value FROM v_series WHERE lake_id = 1 AND year < 20) a
       FULL JOIN (SELECT year, value FROM v_series WHERE lake_id = 2 AND year > 10) b USING (year)
       FULL JOIN (SELECT year, value FROM v_series WHERE lake_id = 3 AND year % 2 = 0) c USING (year)""",
    "v_series",
)
def full_outer_series(spark, series):
    return reports.joined_series(
        ("one", series.where("lake_id = 1 AND year < 20")),
        ("two", series.where("lake_id = 2 AND year > 10")),
        ("three", series.where("lake_id = 3 AND year % 2 = 0")),
    )


@query(
    f"SELECT * FROM (WITH {_LONG} SELECT lake_id, index_name, year, round(value, 6) + 0.0 AS value FROM eco WHERE value IS NOT NULL) t",
    "v_features",
)
def index_value_maps(spark, features):
    """Nested maps of index and year, opened again."""
    nested = reports.index_values(fc.ecological_indices(features), fc.KEYS)
    outer = nested.select("lake_id", F.explode("index_values").alias("index_name", "by_year"))
    flat = outer.select("lake_id", "index_name", F.explode("by_year").alias("y", "value"))
    return rounded(flat.select("lake_id", "index_name", F.col("y").cast("int").alias("year"), "value"))


@query(
    "SELECT count(*) FILTER (status <> 'pending') AS done, count(*) AS total, round(count(*) FILTER (status <> 'pending') / 2.0, 6) AS per_minute FROM v_images",
    "v_images",
)
def run_progress(spark, images):
    return rounded(reports.progress(images, 120.0).select("done", "total", "per_minute"))


@query(
    """SELECT lake_id, concat('/data/2020/lake_', lpad(CAST(lake_id AS varchar), 6, '0'), '.tif') AS path,
              CASE WHEN lake_id % 10 = 0 THEN 'lake' ELSE trim(regexp_replace(state, '[^0-9A-Za-z]+', '_', 'g'), '_') END AS slug FROM v_lakes""",
    "v_lakes",
)
def file_names(spark, sites):
    return sites.select("lake_id", image_path(F.lit("/data"), F.lit(2020), F.col("lake_id")).alias("path"), slug(F.when(F.col("lake_id") % 10 == 0, " -- ").otherwise(F.col("state"))).alias("slug"))


@query(
    """SELECT lake_id, concat(format('{:,}', CAST(floor(round(area_sqkm * 100) / 100) AS bigint)), printf('.%02d', CAST(round(area_sqkm * 100) AS bigint) % 100), ' km²') AS area,
              CASE WHEN center_lat IS NULL THEN '—' ELSE concat(printf('%.1f', abs(center_lat)), ' km') END AS distance,
              CASE WHEN lake_id % 10 = 0 THEN '—' ELSE concat(lake_id % 10, ' ms') END AS took,
              CASE lake_id % 4 WHEN 0 THEN 'Cosine' WHEN 1 THEN 'Euclidean' WHEN 2 THEN 'KNN' ELSE 'other' END AS method,
              CASE WHEN lake_id % 20 >= 17 THEN '#22c55e' WHEN lake_id % 20 >= 14 THEN '#84cc16' WHEN lake_id % 20 >= 11 THEN '#eab308'
                   WHEN lake_id % 20 >= 8 THEN '#f97316' ELSE '#ef4444' END AS color
       FROM v_lakes""",
    "v_lakes",
)
def report_units(spark, sites):
    """Areas, distances, durations, methods and colours as a report shows them."""
    methods = F.array(*map(F.lit, ("cosine", "euclidean", "knn", "other")))
    place = F.col("lake_id")
    return sites.select(
        "lake_id",
        square_km(F.col("area_sqkm")).alias("area"),
        kilometres(F.abs("center_lat")).alias("distance"),
        milliseconds((place % 10).cast("double")).alias("took"),
        method_label(F.get(methods, (place % 4).cast("int"))).alias("method"),
        similarity_color((place % 20).cast("double") / 20).alias("color"),
    )


@query("SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%B %d, %Y at %I:%M %p IST') AS shown FROM events", "events")
def report_times(spark, events):
    return events.select("event_id", report_time(F.col("ts")).alias("shown"))
