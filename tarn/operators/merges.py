"""Keyed merges and work lists; every write makes a new version of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.constants import EMBEDDING_VERSION
from tarn.functions.checks import years_checked

KEYS = ["lake_id", "year"]


def merged(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``old`` with the columns of ``new`` in its rows of the same key, and new rows.

    Columns that ``new`` lacks keep their values, and are null in new rows.  Of rows
    of ``new`` that repeat a key that with the largest ``order`` counts, a column that is
    not kept; without one, the largest by its columns.
    """
    others = [c for c in new.columns if c not in (*keys, order)]
    row = F.struct(*others) if others else F.lit(0)
    fresh = new.groupBy(*keys).agg((F.max(row) if order is None else F.max_by(row, order)).alias("_new"), F.lit(True).alias("_hit"))
    value = lambda c: F.when(F.col("_hit"), F.col(f"_new.{c}")).otherwise(F.col(c) if c in old.columns else None)
    out = [F.col(c) if c not in others else value(c).alias(c) for c in old.columns]
    out += [value(c).alias(c) for c in others if c not in old.columns]
    return old.join(fresh, keys, "full_outer").select(*out)


def with_centres(rows: DataFrame, lakes: DataFrame) -> DataFrame:
    """``rows`` with the centre of their lake; a lake that is not known is an error.

    A lake without a shape has its pour point instead.
    """
    at = lambda axis: F.coalesce(f"center_{axis}", f"pour_{axis}").alias(f"_{axis}")
    known = lakes.select("lake_id", at("lat"), at("lon"), F.lit(True).alias("_known")).dropDuplicates(["lake_id"])
    missing = F.raise_error(F.concat(F.lit("lake "), F.col("lake_id").cast("string"), F.lit(" is not known")))
    value = lambda axis: F.when(F.col("_known").isNull(), missing.cast("double")).otherwise(F.col(f"_{axis}"))
    return rows.join(known, "lake_id", "left").withColumns({"center_lat": value("lat"), "center_lon": value("lon")}).drop("_known", "_lat", "_lon")


def inserted_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks; one row a key."""
    return old.unionByName(new.join(old, keys, "left_anti").dropDuplicates(keys))


def merge_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows of ``new`` insert, and how many update."""
    known = old.select(*keys, F.lit(True).alias("known")).distinct()
    hit = new.join(known, keys, "left")
    return hit.agg(F.count_if(F.col("known").isNull()).alias("inserted"), F.count_if("known").alias("updated"))


def updated_from(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``target`` with columns of ``source`` where it has the key and a value."""
    fresh = source.select(*keys, *(F.col(c).alias(f"new_{c}") for c in columns))
    keep = lambda c: F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c)
    return target.join(fresh, keys, "left").select(*map(keep, target.columns))


def pruned(rows: DataFrame, current: DataFrame, keys: list[str], scope: list[str]) -> DataFrame:
    """``rows`` without those in the scopes of ``current`` whose key it lacks."""
    inside = rows.join(current.select(*scope).distinct(), scope, "left_semi")
    outside = rows.join(current.select(*scope).distinct(), scope, "left_anti")
    return outside.unionByName(inside.join(current, keys, "left_semi"))


def work_list(images: DataFrame, results: DataFrame, version: int, version_col: str) -> DataFrame:
    """Merged images without a current result: completed, of this version, and not older."""
    fresh = results.where((F.col("status") == "completed") & (F.col(version_col) == version)).select(
        *KEYS, F.col("updated_at").alias("done_at")
    )
    ready = images.where(F.col("status") == "merged").alias("i")
    same = [F.col(f"i.{k}") == F.col(f"r.{k}") for k in KEYS]
    current = F.col("r.done_at") >= F.col("i.updated_at")
    return ready.join(fresh.alias("r"), [*same, current], "left_anti")


def marked_failed(regions: DataFrame, failed: DataFrame, message: str) -> DataFrame:
    """``regions`` with the failed keys as failed rows without vectors."""
    hit = failed.select(*KEYS, F.lit(True).alias("bad")).distinct()
    out = regions.join(hit, KEYS, "left")
    bad = F.col("bad").isNotNull()
    void = [c for c in ("embedding", "lake_embedding", "shore_embedding") if c in regions.columns]
    changed = {c: F.when(~bad, F.col(c)) for c in void}
    changed["status"] = F.when(bad, "failed").otherwise(F.col("status"))
    changed["error_message"] = F.when(bad, F.lit(message))
    return out.withColumns(changed).drop("bad")


def tiles_after_plan(tiles: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of planned tiles: one whose box is unchanged keeps its status.

    Boxes are compared null-safe; a changed or new one is PENDING.  A completed
    tile of the same box keeps its path too; all others take the planned one.
    """
    keys = [*KEYS, "tile_index"]
    had = tiles.select(
        *keys, F.col("bbox").alias("_box"), F.col("status").alias("_status"), F.col("image_path").alias("_path"), F.lit(True).alias("_known")
    )
    same = F.coalesce(F.col("_known"), F.lit(False)) & F.col("bbox").eqNullSafe(F.col("_box"))
    planned = F.col("image_path") if "image_path" in plan.columns else F.lit(None).cast("string")
    return plan.join(had, keys, "left").select(
        *keys,
        "bbox",
        F.when(same, F.col("_status")).otherwise("PENDING").alias("status"),
        F.when(same & (F.col("_status") == "COMPLETED"), F.col("_path")).otherwise(planned).alias("image_path"),
    )


def pending_tiles(tiles: DataFrame) -> DataFrame:
    """Tiles that are not completed, or have no path."""
    done = (F.col("status") == "COMPLETED") & (F.coalesce("image_path", F.lit("")) != "")
    return tiles.where(~F.coalesce(done, F.lit(False)))


def rolled_up(tiles: DataFrame) -> DataFrame:
    """Status and size of each image from its tiles."""
    status = F.col("status")
    return (
        tiles.groupBy(KEYS)
        .agg(
            F.bool_and(status == "COMPLETED").alias("whole"),
            F.bool_or(status == "FAILED").alias("broken"),
            F.count_if(status == "COMPLETED").alias("tiles_completed"),
            F.count(F.lit(1)).alias("tiles"),
            F.coalesce(F.sum("file_size_bytes"), F.lit(0)).alias("size"),
        )
        .select(
            *KEYS,
            F.when(F.col("whole"), "completed").when(F.col("broken"), "failed").otherwise("downloading").alias("status"),
            F.when(F.col("whole"), F.col("size")).alias("file_size_bytes"),
            "tiles_completed",
            "tiles",
        )
    )


def refreshed(regions: DataFrame, sites: DataFrame, country: str) -> DataFrame:
    """``regions`` with the rows of a country's sites pending again."""
    own = sites.where(F.lower("country") == country.lower()).select("lake_id", F.lit(True).alias("own")).distinct()
    return (
        regions.join(own, "lake_id", "left")
        .withColumn("status", F.when(F.col("own"), "pending").otherwise(F.col("status")))
        .drop("own")
    )


def without_country(rows: DataFrame, country: str) -> DataFrame:
    """``rows`` less those of a country, whatever its case; rows of no country stay."""
    return rows.where(~F.coalesce(F.lower("country") == country.lower(), F.lit(False)))


def jobs(sites: DataFrame, years: list[int]) -> DataFrame:
    """(lake_id, year) to work on: every active site in every year asked for."""
    return sites.where("is_active").select("lake_id", F.explode(F.array(*map(F.lit, years_checked(years)))).alias("year"))


def permitted(permissions: DataFrame, key: str, master: str = "master") -> DataFrame:
    """One row: whether both the master switch and the key are on; absent is off."""
    on = lambda k: F.coalesce(F.bool_or(F.when(F.col("permission_key") == k, F.col("is_enabled"))), F.lit(False))
    return permissions.agg((on(master) & on(key)).alias("allowed"))


def permitted_keys(permissions: DataFrame, keys: DataFrame, master: str = "master") -> DataFrame:
    """``permitted`` for each permission_key of ``keys``."""
    on = permissions.groupBy("permission_key").agg(F.bool_or("is_enabled").alias("on"))
    switch = permissions.agg(F.coalesce(F.bool_or(F.when(F.col("permission_key") == master, F.col("is_enabled"))), F.lit(False)).alias("master"))
    return keys.join(on, "permission_key", "left").join(F.broadcast(switch)).select("permission_key", (F.col("master") & F.coalesce("on", F.lit(False))).alias("allowed"))


def run_counters(results: DataFrame, newest: int = 100) -> DataFrame:
    """One row of counts by status, with the newest errors."""
    status = F.col("status")
    recent = (
        results.where(F.col("error_message").isNotNull())
        .orderBy(F.col("updated_at").desc(), *KEYS)
        .limit(newest)
        .agg(F.array_sort(F.collect_list(F.struct("updated_at", *KEYS, "error_message"))).alias("errors"))
    )
    counts = results.agg(
        F.count_if(status.isin("completed", "merged")).alias("success"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status == "skipped").alias("skipped"),
        F.count(F.lit(1)).alias("total"),
    )
    return counts.join(F.broadcast(recent))


def current(version_col: str = "embedding_version", version: int = EMBEDDING_VERSION) -> Column:
    return (F.col("status") == "completed") & (F.col(version_col) == version)
