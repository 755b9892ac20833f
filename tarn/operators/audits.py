"""Integrity counts over the tables, by metric and year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.constants import EMBEDDING_VERSION, FEATURE_VERSION
from tarn.functions.text import path_root

KEYS = ["lake_id", "year"]


def verify_counts(
    sites: DataFrame, tiles: DataFrame, images: DataFrame, regions: DataFrame, features: DataFrame, years: list[int]
) -> DataFrame:
    """(table_name, one column a year): counts, and checks that should be 0.

    A table is read once for all its counts; checks are anti joins on the key.
    """
    within = F.col("year").isin(years)
    tiles, images, regions, features = (t.where(within) for t in (tiles, images, regions, features))
    status = F.col("status")
    done = (F.col("embedding_version") == EMBEDDING_VERSION) & (status == "completed")
    shore = done & F.col("shore_embedding").isNotNull()
    made = (status == "completed") & (F.col("feature_version") == FEATURE_VERSION)

    def counts(df: DataFrame, **metrics) -> DataFrame:
        each = df.groupBy("year").agg(*(m.alias(n) for n, m in metrics.items()))
        pairs = F.array(*(F.struct(F.lit(n).alias("table_name"), F.col(n).alias("n")) for n in metrics))
        return each.select("year", F.inline(pairs))

    def missing(name: str, rows: DataFrame, other: DataFrame) -> DataFrame:
        return counts(rows.join(other, KEYS, "left_anti"), **{name: F.count(F.lit(1))})

    merged_images = images.where(status == "merged")
    spark = sites.sparkSession
    asked = F.broadcast(spark.createDataFrame([(y,) for y in years], "year int"))
    active = sites.where("is_active").select("lake_id")
    parts = [
        counts(
            tiles,
            lake_tiles_completed=F.count_if(status == "COMPLETED"),
            lake_tiles_not_completed=F.count_if(status != "COMPLETED"),
        ),
        counts(
            images,
            lake_images_downloaded_not_merged=F.count_if(status == "completed"),
            lake_images_merged=F.count_if(status == "merged"),
            lake_images_failed=F.count_if(~status.isin("completed", "merged")),
        ),
        counts(
            regions,
            regions_v2_completed=F.count_if(done & F.col("embedding").isNotNull() & F.col("lake_embedding").isNotNull()),
            regions_v2_with_shore=F.count_if(shore),
            regions_v2_lake_weights_distinct=F.count_distinct(F.when(shore, F.col("lake_weight"))),
            regions_failed=F.count_if((status != "completed") | F.col("embedding").isNull()),
            regions_legacy_v1=F.count_if(F.coalesce("embedding_version", F.lit(1)) < EMBEDDING_VERSION),
        ),
        counts(
            features,
            lake_features_v2_completed=F.count_if(made),
            lake_features_failed=F.count_if(status != "completed"),
            lake_features_legacy_v1=F.count_if(
                (status == "completed") & (F.coalesce("feature_version", F.lit(1)) < FEATURE_VERSION)
            ),
        ),
        missing("check_merged_without_embedding", merged_images, regions.where(done)),
        missing("check_merged_without_features", merged_images, features.where(made)),
        missing("check_embedding_without_merged_image", regions.where(done), merged_images),
        missing("check_features_without_merged_image", features.where(status == "completed"), merged_images),
        counts(
            active.join(asked).join(images, KEYS, "left_anti"), check_active_lakes_without_image=F.count(F.lit(1))
        ),
        counts(active.join(asked), lakes_active=F.count(F.lit(1))),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    names = [
        "lakes_active", "lake_tiles_completed", "lake_tiles_not_completed", "lake_images_downloaded_not_merged",
        "lake_images_merged", "lake_images_failed", "regions_v2_completed", "regions_v2_with_shore",
        "regions_v2_lake_weights_distinct", "regions_failed", "regions_legacy_v1", "lake_features_v2_completed",
        "lake_features_failed", "lake_features_legacy_v1", "check_merged_without_embedding",
        "check_merged_without_features", "check_embedding_without_merged_image",
        "check_features_without_merged_image", "check_active_lakes_without_image",
    ]
    zero = spark.createDataFrame([(n,) for n in names], "table_name string").join(asked).withColumn("n", F.lit(0).cast("long"))
    return every.unionByName(zero).groupBy("table_name").pivot("year", years).agg(F.sum("n"))


def mergeable_years(tiles: DataFrame) -> DataFrame:
    """Years with completed tiles, newest first, and how many sites have them."""
    return (
        tiles.where(F.col("status") == "COMPLETED")
        .groupBy("year")
        .agg(F.count_distinct("lake_id").alias("lake_count"))
        .orderBy(F.col("year").desc())
    )


def year_roots(paths: DataFrame, root: str = "root") -> DataFrame:
    """Where a year's images lie: (year, root, lakes, last_used), newest first."""
    return (
        paths.where(F.col(root).isNotNull())
        .groupBy("year", root)
        .agg(F.count(F.lit(1)).alias("lakes"), F.max("updated_at").alias("last_used"))
        .orderBy("year", F.col("last_used").desc(), root)
    )


def output_patterns(tiles: DataFrame, default_root: str) -> DataFrame:
    """(year, output_path_pattern): where a year's merged images go, beside their tiles.

    The roots of a year's completed tiles, the one used last first; ``default_root``
    for years whose tiles lie elsewhere.
    """
    done = tiles.where(F.col("status") == "COMPLETED")
    per_site = done.groupBy(KEYS).agg(F.min("image_path").alias("path"), F.max("updated_at").alias("updated_at"))
    rooted = year_roots(per_site.withColumn("root", path_root(F.col("path"), F.col("year"))))
    newest = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("last_used").cast("timestamp"))).alias("age"), "root")))
    roots = rooted.groupBy("year").agg(newest["root"].alias("roots"))
    pattern = lambda root: F.concat_ws("/", root, F.col("year").cast("string"), F.lit("lake_{lake_id:06d}.tif"))
    known = F.coalesce("roots", F.array(F.lit(default_root)))
    years = done.select("year").distinct()
    return years.join(roots, "year", "left").select("year", F.array_join(F.transform(known, pattern), " · ").alias("output_path_pattern"))


def common_path(paths: DataFrame, column: str) -> DataFrame:
    """One row: the most frequent path; the smallest on ties."""
    counted = paths.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.col("n").desc(), column).limit(1).select(column)
