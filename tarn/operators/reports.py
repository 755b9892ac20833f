"""The tables behind a site's report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.geo import haversine_km
from tarn.functions.text import lat_lon, match_quality, percent, similarity_color


def analog_rows(analogs: DataFrame, sites: DataFrame, site: int) -> DataFrame:
    """Analogs in order with name, place, distance and labels."""
    home = sites.where(F.col("lake_id") == site).select(
        F.col("center_lat").alias("home_lat"), F.col("center_lon").alias("home_lon")
    )
    in_order = Window.orderBy(F.col("similarity_score").desc(), "lake_id")
    km = haversine_km(F.col("home_lat"), F.col("home_lon"), F.col("center_lat"), F.col("center_lon"))
    score = F.col("similarity_score")
    return (
        F.broadcast(analogs)
        .join(sites, "lake_id", "left")
        .join(F.broadcast(home))
        .select(
            F.row_number().over(in_order).alias("rank"),
            "lake_id",
            F.coalesce("display_name", F.format_string("Lake %s", "lake_id")).alias("name"),
            "start_year",
            "end_year",
            score.alias("similarity_score"),
            percent(score).alias("score_text"),
            match_quality(score).alias("quality"),
            similarity_color(score).alias("color"),
            km.alias("distance_km"),
            lat_lon(F.col("center_lat"), F.col("center_lon")).alias("place"),
        )
    )


def twin_delta_table(contributions: DataFrame, index_name: str, horizon: int = 3) -> DataFrame:
    """One row per twin, its changes side by side by year ahead."""
    return (
        contributions.where(F.col("index_name") == index_name)
        .groupBy("rank", "lake_id", "matched_year", "fixed_weight")
        .pivot("h", list(range(1, horizon + 1)))
        .agg(F.first("delta"))
    )


def series_summary(series: DataFrame) -> DataFrame:
    """Mean, first, last and change of a series (lake_id, year, value)."""
    known = series.where("value IS NOT NULL")
    return (
        known.groupBy("lake_id")
        .agg(F.avg("value").alias("mean"), F.min_by("value", "year").alias("first"), F.max_by("value", "year").alias("last"))
        .withColumn("delta", F.col("last") - F.col("first"))
    )


def joined_series(*series: tuple[str, DataFrame]) -> DataFrame:
    """Series (year, value) side by side by year; a year in any of them is a row."""
    (name, first), *rest = series
    out = first.select("year", F.col("value").alias(name))
    for name, other in rest:
        out = out.join(other.select("year", F.col("value").alias(name)), "year", "full_outer")
    return out


def forecast_items(forecast: DataFrame) -> DataFrame:
    """``forecast`` with the change and its share of the current value."""
    size = F.abs("current_value")
    return forecast.withColumn("change", F.col("expected_value") - F.col("current_value")).withColumn(
        "change_pct", F.when(size > 0, F.col("change") / F.when(size > 0, size) * 100)
    )


def index_values(indexed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per site: map of index to map of year to value."""
    pairs = F.array(*(F.struct(F.lit(k).alias("index_name"), F.round(k, 6).alias("value")) for k in keys))
    per_index = (
        indexed.select("lake_id", "year", F.inline(pairs))
        .where("value IS NOT NULL")
        .groupBy("lake_id", "index_name")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("year").cast("string"), "value")))).alias("by_year"))
    )
    return per_index.groupBy("lake_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("index_name", F.map_entries("by_year").alias("e"))))).alias("entries")
    ).select("lake_id", F.transform_values("entries", lambda _, e: F.map_from_entries(e)).alias("index_values"))


def progress(results: DataFrame, seconds: float) -> DataFrame:
    """One row: done, total, rate a minute and minutes left."""
    counts = results.agg(F.count_if(F.col("status") != "pending").alias("done"), F.count(F.lit(1)).alias("total"))
    rate = F.col("done") / (seconds / 60)
    return counts.withColumn("per_minute", rate).withColumn(
        "minutes_left", F.when(rate > 0, (F.col("total") - F.col("done")) / F.when(rate > 0, rate))
    )
