"""Ecological and embedding forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.constants import ARROWS, INDEX_LABELS
from tarn.operators import forecasts as fc
from tarn.operators.trajectories import analogs
from tarn.plans.base import query, rounded
from tarn.plans.search import analog_ctes

SITE, ANCHOR, METHOD = 5, 2001, "euclidean"

_Z = lambda top, bottom: (
    f"CASE WHEN {top} IS NULL OR {bottom} IS NULL THEN NULL WHEN abs({bottom}) > 1e-10 THEN ({top}) / ({bottom}) ELSE 0.0 END"
)
_ECO = {
    "ndci": _Z("b5_mean - b4_mean", "b5_mean + b4_mean"),
    "ndvi": _Z("b8_mean - b4_mean", "b8_mean + b4_mean"),
    "ndwi": _Z("b3_mean - b8_mean", "b3_mean + b8_mean"),
    "turbidity": _Z("b4_mean - b3_mean", "b4_mean + b3_mean"),
    "red_edge_slope": "(b7_mean - b5_mean) / 10000.0 / 78.0 * 100.0",
}
_ECO = {k: v.replace("b5_mean + b4_mean IS", "(b5_mean + b4_mean) IS") for k, v in _ECO.items()}
_LONG = "eco AS (" + " UNION ALL ".join(
    f"SELECT lake_id, year, '{k}' AS index_name, {sql} AS value FROM v_features" for k, sql in _ECO.items()
) + ")"
_THRESHOLD = """
    grid AS (SELECT index_name, h FROM (VALUES ('ndci'), ('ndvi'), ('ndwi'), ('turbidity'), ('red_edge_slope')) i(index_name),
                                       (VALUES (1), (2), (3)) g(h)),
    chg AS (SELECT a.index_name, b.year - a.year AS h, median(abs(b.value - a.value)) AS change, count(*) AS samples
            FROM eco a JOIN eco b ON a.lake_id = b.lake_id AND a.index_name = b.index_name AND b.year - a.year BETWEEN 1 AND 3
            WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY a.index_name, b.year - a.year),
    thr AS (SELECT grid.index_name, grid.h, coalesce(samples, 0) AS samples,
                   CASE WHEN samples >= 30 AND change > 0 THEN change * 0.5
                        WHEN grid.index_name = 'red_edge_slope' THEN 0.001 ELSE 0.005 END AS threshold
            FROM grid LEFT JOIN chg ON grid.index_name = chg.index_name AND grid.h = chg.h)"""
_TWINS = f"""
    {analog_ctes(METHOD, SITE, ANCHOR, "v_embed_shifted")},
    cand AS (SELECT lake_id, end_year, shown, place FROM analog WHERE place <= 20 ORDER BY place LIMIT 10),
    dl AS (SELECT c.place, c.lake_id, c.end_year AS matched_year, c.shown, a.index_name, b.year - a.year AS h, b.value - a.value AS delta
           FROM cand c JOIN eco a ON a.lake_id = c.lake_id AND a.year = c.end_year
           JOIN eco b ON b.lake_id = a.lake_id AND b.index_name = a.index_name AND b.year - a.year BETWEEN 1 AND 3
           WHERE a.value IS NOT NULL AND b.value IS NOT NULL),
    tw AS (SELECT *, dense_rank() OVER (ORDER BY place) AS rank FROM dl),
    wt AS (SELECT *, CASE rank WHEN 1 THEN 0.28 WHEN 2 THEN 0.24 WHEN 3 THEN 0.20 WHEN 4 THEN 0.16 WHEN 5 THEN 0.12 ELSE 0.0 END AS fixed_weight
           FROM tw WHERE rank <= 5),
    con AS (SELECT *, CASE WHEN sum(fixed_weight) OVER w > 0 THEN CAST(fixed_weight AS double) / sum(fixed_weight) OVER w ELSE 0.0 END AS normalized_weight
            FROM wt WINDOW w AS (PARTITION BY index_name, h))"""
_FORECAST = f"""
    WITH {_LONG}, {_THRESHOLD}, {_TWINS},
    cur AS (SELECT index_name, value, year FROM eco WHERE lake_id = {SITE}
            AND year = (SELECT max(year) FROM v_features WHERE lake_id = {SITE} AND year <= {ANCHOR})),
    sc AS (SELECT index_name, h, sum(normalized_weight * delta) AS score, count(*) AS twins FROM con GROUP BY index_name, h),
    j AS (SELECT thr.index_name, thr.h, cur.year + thr.h AS forecast_year, cur.value AS current_value, coalesce(score, 0.0) AS score,
                 coalesce(twins, 0) AS twins, threshold
          FROM thr JOIN cur ON thr.index_name = cur.index_name LEFT JOIN sc ON thr.index_name = sc.index_name AND thr.h = sc.h)
    SELECT index_name, CAST(h AS int) AS h, CAST(forecast_year AS int) AS forecast_year, round(current_value, 6) AS current_value,
           round(score, 6) + 0.0 AS weighted_score, twins AS twins_contributing, round(threshold, 6) AS threshold,
           CASE WHEN twins < 2 THEN 'uncertain' WHEN score > threshold THEN 'up' WHEN score < -threshold THEN 'down' ELSE 'stable' END AS direction,
           round(current_value + score, 6) AS expected_value
    FROM j"""


@query(
    "SELECT lake_id, year, " + ", ".join(f"round({sql}, 6) + 0.0 AS {k}" for k, sql in _ECO.items()) + " FROM v_features", "v_features"
)
def ecological_indices(spark, features):
    return rounded(fc.ecological_indices(features).select("lake_id", "year", *fc.KEYS))


@query(
    f"SELECT * FROM (WITH {_LONG}, {_THRESHOLD} SELECT index_name, CAST(h AS int) AS h, round(threshold, 6) AS threshold, samples FROM thr) t",
    "v_features",
)
def noise_thresholds(spark, features):
    return rounded(fc.noise_thresholds(features))


_PAIRS = "(VALUES (1, 1994), (1, 1997), (2, 2030), (5, 1999), (100, 1996), (9999, 2000)) q(lake_id, max_year)"


@query(
    f"""SELECT CAST(lake_id AS bigint) AS lake_id, CAST(max_year AS int) AS max_year, year, round(b4_mean, 6) AS b4_mean FROM (
            SELECT f.*, max_year, row_number() OVER (PARTITION BY q.lake_id, max_year ORDER BY year DESC) AS back
            FROM v_features f JOIN {_PAIRS} ON f.lake_id = q.lake_id AND year <= max_year) t WHERE back = 1""",
    "v_features",
)
def asof_anchor(spark, features):
    pairs = [(1, 1994), (1, 1997), (2, 2030), (5, 1999), (100, 1996), (9999, 2000)]
    queries = spark.createDataFrame(pairs, "lake_id long, max_year int")
    return rounded(fc.latest_before(features, queries).select("lake_id", "max_year", "year", "b4_mean"))


@query(
    """SELECT f.lake_id, start_year, year, round(b5_mean, 6) AS b5_mean
       FROM v_features f JOIN (VALUES (3, 1998), (4, 2000), (9, 1990), (3, 2001)) q(lake_id, start_year) ON f.lake_id = q.lake_id AND year >= start_year""",
    "v_features",
)
def twin_band_history(spark, features):
    starts = spark.createDataFrame([(3, 1998), (4, 2000), (9, 1990), (3, 2001)], "lake_id long, start_year int")
    return rounded(fc.following_rows(features, starts).select("lake_id", "start_year", "year", "b5_mean"))


def _analogs(records):
    return analogs(records, SITE, ANCHOR, METHOD, 20)


@query(
    f"""SELECT * FROM (WITH {_LONG}, {_TWINS}
        SELECT CAST(rank AS int) AS rank, lake_id, matched_year, index_name, CAST(h AS int) AS h, round(delta, 6) + 0.0 AS delta FROM wt) t""",
    "v_embed_shifted",
    "v_features",
)
def twin_deltas(spark, records, features):
    found = fc.twin_deltas(_analogs(records), features, SITE)
    return rounded(found.select("rank", "lake_id", "matched_year", "index_name", "h", "delta"))


@query(
    f"""SELECT * FROM (WITH {_LONG}, {_TWINS}
        SELECT CAST(rank AS int) AS rank, lake_id, index_name, CAST(h AS int) AS h, CAST(fixed_weight AS double) AS fixed_weight,
               round(normalized_weight, 6) AS normalized_weight, round(normalized_weight * delta, 6) + 0.0 AS weighted_contribution FROM con) t""",
    "v_embed_shifted",
    "v_features",
)
def forecast_contributions(spark, records, features):
    found = fc.contributions(fc.twin_deltas(_analogs(records), features, SITE))
    return rounded(
        found.select("rank", "lake_id", "index_name", "h", "fixed_weight", "normalized_weight", "weighted_contribution")
    )


@query(f"SELECT * FROM ({_FORECAST}) f", "v_embed_shifted", "v_features")
def ecological_forecast(spark, records, features):
    return rounded(fc.ecological_forecast(_analogs(records), features, SITE, ANCHOR))


@query(
    f"""SELECT index_name, max(current_value) AS current_value, count(*) AS years, string_agg(direction, ',' ORDER BY forecast_year) AS directions
        FROM ({_FORECAST}) f GROUP BY index_name""",
    "v_embed_shifted",
    "v_features",
)
def nested_forecast(spark, records, features):
    """The forecast as nested rows, and what stands in them."""
    nested = fc.nested_forecast(fc.ecological_forecast(_analogs(records), features, SITE, ANCHOR))
    return rounded(
        nested.select(
            "index_name",
            "current_value",
            F.size("yearly_directions").cast("long").alias("years"),
            F.array_join("yearly_directions.direction", ",").alias("directions"),
        )
    )


@query(
    """SELECT lake_id, index_name, CAST(y + h AS int) AS forecast_year, 'uncertain' AS direction, CAST(0 AS double) AS weighted_score, 0 AS twins_contributing
       FROM (SELECT lake_id, max(year) AS y FROM v_features GROUP BY lake_id) a,
            (VALUES ('ndci'), ('ndvi'), ('ndwi'), ('turbidity'), ('red_edge_slope')) i(index_name), (VALUES (1), (2), (3)) g(h)""",
    "v_features",
)
def empty_forecast(spark, features):
    """What every site is told when it has no twins, from its latest year on."""
    return fc.empty_forecasts(features.groupBy("lake_id").agg(F.max("year").alias("anchor_year")))


_EMB = f"""
    {analog_ctes(METHOD, SITE, ANCHOR, "v_embed_shifted")},
    cand AS (SELECT * FROM analog WHERE place <= 20 ORDER BY place LIMIT 10),
    ok AS (SELECT c.place FROM cand c JOIN ev ON ev.lake_id = c.lake_id AND ev.year > c.end_year GROUP BY c.place HAVING count(*) >= 3),
    pick AS (SELECT c.* FROM cand c JOIN ok ON c.place = ok.place ORDER BY c.place LIMIT 5),
    w AS (SELECT *, 1 / (1 + (1 / greatest(shown, 1e-9) - 1)) AS raww FROM pick),
    chosen AS (SELECT *, raww / sum(raww) OVER () AS weight FROM w)"""


@query(
    f"SELECT * FROM (WITH {_EMB} SELECT lake_id, end_year, round(shown, 6) AS similarity_score, round(weight, 6) AS weight FROM chosen) t",
    "v_embed_shifted",
)
def analog_weights(spark, records):
    picked = fc.embedding_analogs(_analogs(records), records, SITE, 5, 3)
    return rounded(fc.analog_weights(picked, METHOD).select("lake_id", "end_year", "similarity_score", "weight"))


@query(
    f"""SELECT * FROM (WITH {_EMB},
        fut AS (SELECT c.place, c.weight, ev.e, row_number() OVER (PARTITION BY c.place ORDER BY ev.year) AS h
                FROM chosen c JOIN ev ON ev.lake_id = c.lake_id AND ev.year > c.end_year),
        x AS (SELECT h, weight, unnest(e) AS x, unnest(range(len(e))) AS axis FROM fut WHERE h <= 3)
        SELECT CAST({ANCHOR} + h AS int) AS forecast_year, CAST(axis AS int) AS axis, round(sum(weight * x) / sum(weight), 6) + 0.0 AS value
        FROM x GROUP BY h, axis) t""",
    "v_embed_shifted",
)
def embedding_forecast(spark, records):
    return rounded(fc.embedding_forecast(_analogs(records), records, SITE, ANCHOR, METHOD).withColumnRenamed("at", "axis"))


@query(
    f"""SELECT * FROM (WITH {_EMB},
        o AS (SELECT round(greatest(0.0, least(1.0, sum(weight * shown))), 3) AS overall FROM chosen)
        SELECT CAST({ANCHOR} + h AS int) AS forecast_year, round(overall * greatest(0.3, 1 - (h - 1) * 0.08), 3) AS confidence
        FROM o, (VALUES (1), (2), (3)) g(h)) t""",
    "v_embed_shifted",
)
def forecast_confidence(spark, records):
    picked = fc.embedding_analogs(_analogs(records), records, SITE, 5, 3)
    return fc.forecast_confidence(fc.analog_weights(picked, METHOD), ANCHOR, METHOD)


@query(
    "SELECT CAST(1990 + h AS int) AS forecast_year, round(CAST(greatest(0.05, 0.3 - (h - 1) * 0.04) AS double), 3) AS confidence FROM (VALUES (1), (2), (3), (4), (5)) g(h)",
    "v_embed_shifted",
)
def fallback_confidence(spark, records):
    """Without analogs the confidence is the fallback's, five years ahead."""
    picked = fc.embedding_analogs(analogs(records, SITE, 1990, METHOD), records, SITE, 5, 3)
    return fc.forecast_confidence(fc.analog_weights(picked, METHOD), 1990, METHOD)


_LABEL = "CASE index_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in INDEX_LABELS.items()) + " END"
_ARROW = "CASE direction " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ARROWS.items()) + " END"


@query(
    f"""SELECT index_name, h, concat({_LABEL}, ' @ ', forecast_year, ': ', {_ARROW}, ' (', direction, ') — weighted score = ',
              printf('%+.6f', weighted_score), ' (threshold ±', printf('%.6f', threshold), '), ', twins_contributing, ' twin(s) contributing.') AS audit
        FROM ({_FORECAST}) f""",
    "v_embed_shifted",
    "v_features",
)
def forecast_audit_text(spark, records, features):
    full = fc.forecast_audit(fc.ecological_forecast(_analogs(records), features, SITE, ANCHOR))
    return full.select("index_name", "h", "audit")
