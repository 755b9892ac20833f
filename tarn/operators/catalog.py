"""Lists, counts and lookups of sites and their records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.constants import ACTIVE_KM2
from tarn.functions.text import contains_text
from tarn.functions.vectors import rendered


def site_count(sites: DataFrame, country: str | None = None) -> DataFrame:
    some = sites if country is None else sites.where(F.lower("country") == country.lower())
    return some.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_active").alias("active"))


def states(sites: DataFrame, country: str | None = None) -> DataFrame:
    some = sites if country is None else sites.where(F.lower("country") == country.lower())
    return some.where("state IS NOT NULL AND trim(state) <> ''").select("state").distinct().orderBy("state")


def search(sites: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Sites whose name as shown holds ``text``; nothing below three characters."""
    if len(text.strip()) < 3:
        return sites.limit(0)
    return sites.where(contains_text(F.col("display_name"), text)).orderBy("display_name", "lake_id").limit(
        min(max(limit, 1), 20)
    )


def markers(sites: DataFrame) -> DataFrame:
    """Active sites with a place: the centroid, else the pour point."""
    placed = sites.withColumns(
        {"lat": F.coalesce("center_lat", "pour_lat"), "lon": F.coalesce("center_lon", "pour_lon")}
    )
    return placed.where("is_active AND lat IS NOT NULL AND lon IS NOT NULL").select("lake_id", "display_name", "lat", "lon")


def activated(sites: DataFrame, least_km2: float = ACTIVE_KM2) -> DataFrame:
    return sites.withColumn("is_active", F.coalesce(F.col("area_sqkm") >= least_km2, F.lit(False)))


def latest_per_site(records: DataFrame, sites: DataFrame) -> DataFrame:
    """Each site's last record, with its site."""
    newest = Window.partitionBy("lake_id").orderBy(F.col("year").desc())
    return records.withColumn("back", F.row_number().over(newest)).where("back = 1").drop("back").join(sites, "lake_id")


def timeline(records: DataFrame, site: int) -> DataFrame:
    """A site's records in order, with the vector as text."""
    return records.where(F.col("lake_id") == site).orderBy("year").select(
        "lake_id", "year", rendered(F.col("embedding")).alias("vector"), F.size("embedding").alias("width")
    )


def histories(records: DataFrame) -> DataFrame:
    """One row per site with its whole history in order."""
    return records.groupBy("lake_id").agg(
        F.array_sort(F.collect_list(F.struct("year", "embedding"))).alias("records"), F.max("year").alias("last_year")
    )


def missing_years(records: DataFrame, years: list[int]) -> DataFrame:
    """Years asked for in which no site has a record."""
    asked = records.sparkSession.createDataFrame([(y,) for y in sorted(set(years))], "year int")
    return asked.join(records, "year", "left_anti")


def library_size(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count_distinct("lake_id").alias("lakes"), F.count_distinct("year").alias("years"), F.count(F.lit(1)).alias("records")
    )


def image_totals(images: DataFrame) -> DataFrame:
    """Images, bytes and sites by state and country of their site."""
    return images.groupBy("country", "state").agg(
        F.count(F.lit(1)).alias("images"),
        F.count_distinct("lake_id").alias("lakes"),
        F.coalesce(F.sum("file_size_bytes"), F.lit(0)).alias("bytes"),
        F.round(F.coalesce(F.sum("file_size_bytes"), F.lit(0)) / F.count(F.lit(1)), 2).alias("bytes_an_image"),
    )
