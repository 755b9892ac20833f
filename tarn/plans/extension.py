"""Beyond the single query: hindcasts over all sites, and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.operators.forecasts import ecological_indices, long_form
from tarn.operators.trajectories import all_analogs
from tarn.plans.base import query, rounded
from tarn.plans.forecast import _LONG
from tarn.streaming.ingest import newest_per_key, windowed_counts

CUTOFF = 1999


@query(
    f"""SELECT * FROM (WITH {_LONG},
    ev AS (SELECT lake_id, year, CAST(embedding AS DOUBLE[]) AS e FROM v_embed_shifted WHERE year <= {CUTOFF}),
    q AS (SELECT lake_id AS query_id, e, row_number() OVER (PARTITION BY lake_id ORDER BY year) AS k FROM ev),
    c AS (SELECT *, row_number() OVER (PARTITION BY lake_id ORDER BY year) AS pos FROM ev),
    win AS (SELECT query_id, lake_id, pos - k AS st, min(year) AS start_year, max(year) AS end_year, avg(1 / (1 + list_distance(c.e, q.e))) AS raw
            FROM c JOIN q ON lake_id <> query_id GROUP BY query_id, lake_id, pos - k HAVING count(*) = 5),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id, lake_id ORDER BY raw DESC, start_year) AS rn FROM win),
    pick AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, lake_id) AS place FROM best WHERE rn = 1),
    ch AS (SELECT a.lake_id, a.index_name, a.year, b.value - a.value AS delta FROM eco a
           JOIN eco b ON a.lake_id = b.lake_id AND a.index_name = b.index_name AND b.year = a.year + 1 WHERE a.value IS NOT NULL AND b.value IS NOT NULL),
    said AS (SELECT query_id, index_name, avg(delta) AS said FROM pick JOIN ch ON pick.lake_id = ch.lake_id AND pick.end_year = ch.year
             WHERE place <= 5 AND end_year < {CUTOFF + 1} GROUP BY query_id, index_name)
    SELECT said.index_name, round(avg(abs(said - delta)), 6) AS mae, round(avg(CASE WHEN sign(said) = sign(delta) THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, count(*) AS sites
    FROM said JOIN ch ON ch.lake_id = query_id AND ch.index_name = said.index_name AND ch.year = {CUTOFF + 1} GROUP BY said.index_name) t""",
    "v_embed_shifted",
    "v_features",
)
def hindcast_mae_hitrate(spark, records, features):
    """Matched windows end before the year that is forecast from."""
    return rounded(hindcast(records.where(F.col("year") <= CUTOFF), features, CUTOFF, CUTOFF + 1))


def hindcast(records, features, anchor: int, cutoff: int, top_k: int = 5):
    """Error and hit rate by index when all sites are forecast one year from ``cutoff``.

    Searches are anchored at ``anchor``; the mean change of a site's analogs
    stands against its own.
    """
    picked = all_analogs(records, anchor, "euclidean", top_k)
    values = long_form(ecological_indices(features)).where("value IS NOT NULL")
    later = values.select("lake_id", "index_name", (F.col("year") - 1).alias("year"), F.col("value").alias("next"))
    change = values.join(later, ["lake_id", "index_name", "year"]).select(
        "lake_id", "index_name", "year", (F.col("next") - F.col("value")).alias("delta")
    )
    said = (
        picked.where(F.col("end_year") < cutoff)
        .join(change.withColumnRenamed("year", "end_year"), ["lake_id", "end_year"])
        .groupBy("query_id", "index_name")
        .agg(F.avg("delta").alias("said"))
    )
    was = change.where(F.col("year") == cutoff).select(F.col("lake_id").alias("query_id"), "index_name", F.col("delta").alias("was"))
    return (
        said.join(was, ["query_id", "index_name"])
        .groupBy("index_name")
        .agg(
            F.avg(F.abs(F.col("said") - F.col("was"))).alias("mae"),
            F.avg((F.signum("said") == F.signum("was")).cast("double")).alias("hit_rate"),
            F.count(F.lit(1)).alias("sites"),
        )
    )


@query(
    "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "events",
)
def event_windows(spark, events):
    return rounded(windowed_counts(events), digits=4)


@query(
    """SELECT user_id, event_type, event_id, ts FROM (
           SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS back FROM events) t WHERE back = 1""",
    "events",
)
def newest_events(spark, events):
    keyed = events.withColumn("at", F.struct("ts", "event_id"))
    return newest_per_key(keyed, ["user_id", "event_type"], "at").select("user_id", "event_type", "event_id", "ts")
