"""Work lists, merges, roll-ups and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.operators import audits, catalog, merges
from tarn.functions.text import path_root, path_year
from tarn.plans.base import query
from tarn.sources.tables import recordset

KEYS = ["lake_id", "year"]


@query(
    """SELECT i.lake_id, i.year FROM v_images i WHERE i.status = 'merged' AND NOT EXISTS (
           SELECT 1 FROM v_results r WHERE r.lake_id = i.lake_id AND r.year = i.year AND r.status = 'completed'
                  AND r.feature_version = 2 AND r.updated_at >= i.updated_at)""",
    "v_images",
    "v_results",
)
def stale_work_list(spark, images, results):
    return merges.work_list(images, results, 2, "feature_version").select(*KEYS)


_NEW = "SELECT lake_id + 30 AS lake_id, year, 'pending' AS status FROM v_images WHERE (lake_id + year) % 3 = 0"


def _new(images):
    some = images.where((F.col("lake_id") + F.col("year")) % 3 == 0)
    return some.select((F.col("lake_id") + 30).alias("lake_id"), "year", F.lit("pending").alias("status"))


@query(
    f"""SELECT count(*) FILTER (o.lake_id IS NULL) AS inserted, count(*) FILTER (o.lake_id IS NOT NULL) AS updated
        FROM ({_NEW}) n LEFT JOIN v_images o ON n.lake_id = o.lake_id AND n.year = o.year""",
    "v_images",
)
def merge_upsert_counts(spark, images):
    return merges.merge_counts(images, _new(images), KEYS)


@query(
    f"""SELECT lake_id, year, status, file_size_bytes FROM v_images o
               WHERE NOT EXISTS (SELECT 1 FROM ({_NEW}) n WHERE n.lake_id = o.lake_id AND n.year = o.year)
        UNION ALL SELECT n.lake_id, n.year, n.status, o.file_size_bytes FROM ({_NEW}) n LEFT JOIN v_images o ON n.lake_id = o.lake_id AND n.year = o.year""",
    "v_images",
)
def merged_table(spark, images):
    """An upsert sets the columns it has; the file size stays."""
    return merges.merged(images.select(*KEYS, "status", "file_size_bytes"), _new(images), KEYS)


@query(
    f"""SELECT lake_id, year, status FROM v_images UNION ALL
        SELECT lake_id, year, status FROM ({_NEW}) n WHERE NOT EXISTS (SELECT 1 FROM v_images o WHERE n.lake_id = o.lake_id AND n.year = o.year)""",
    "v_images",
)
def insert_if_absent(spark, images):
    return merges.inserted_if_absent(images.select(*KEYS, "status"), _new(images), KEYS)


@query(
    f"SELECT o.lake_id, o.year, coalesce(n.status, o.status) AS status FROM v_images o LEFT JOIN ({_NEW}) n ON n.lake_id = o.lake_id AND n.year = o.year",
    "v_images",
)
def update_from_join(spark, images):
    return merges.updated_from(images.select(*KEYS, "status"), _new(images), KEYS, ["status"])


@query(
    """SELECT lake_id, year, tile_index FROM v_tiles t WHERE NOT (year = 1996 AND lake_id < 20) OR tile_index IN ('0_0', '1_1')""",
    "v_tiles",
)
def prune_stale_tiles(spark, tiles):
    scope = tiles.where("year = 1996 AND lake_id < 20")
    current = scope.select(*KEYS).distinct().select(*KEYS, F.explode(F.array(F.lit("0_0"), F.lit("1_1"))).alias("tile_index"))
    return merges.pruned(tiles.select(*KEYS, "tile_index"), current, [*KEYS, "tile_index"], KEYS)


@query(
    """SELECT lake_id, year, tile_index, bbox, CASE WHEN same THEN status ELSE 'PENDING' END AS status,
              CASE WHEN same AND status = 'COMPLETED' THEN image_path ELSE concat('/new/', tile_index) END AS image_path
       FROM (SELECT *, CASE WHEN lake_id % 3 <> 0 THEN concat('box', lake_id % 3) END AS bbox, lake_id % 3 <> 1 AS same FROM v_tiles) t""",
    "v_tiles",
)
def tile_plan_merge(spark, tiles):
    """A changed box is downloaded again; null boxes count as equal."""
    third = F.col("lake_id") % 3
    box = F.when(third != 0, F.concat(F.lit("box"), third.cast("string")))
    had = tiles.withColumn("bbox", F.when(third == 1, "other").otherwise(box))
    plan = tiles.select(*KEYS, "tile_index", box.alias("bbox"), F.concat(F.lit("/new/"), "tile_index").alias("image_path"))
    return merges.tiles_after_plan(had, plan)


@query(
    """SELECT lake_id, year, tile_index FROM v_tiles WHERE status <> 'COMPLETED' OR lake_id % 5 < 2""",
    "v_tiles",
)
def pending_tiles(spark, tiles):
    fifth = F.col("lake_id") % 5
    path = F.when(fifth == 1, "").when(fifth != 0, F.col("image_path"))
    return merges.pending_tiles(tiles.withColumn("image_path", path)).select(*KEYS, "tile_index")


@query(
    """SELECT lake_id, year, CASE WHEN c = n THEN 'completed' WHEN f > 0 THEN 'failed' ELSE 'downloading' END AS status,
              CASE WHEN c = n THEN s END AS file_size_bytes, c AS tiles_completed, n AS tiles
       FROM (SELECT lake_id, year, count(*) AS n, count(*) FILTER (status = 'COMPLETED') AS c, count(*) FILTER (status = 'FAILED') AS f,
                    CAST(sum(file_size_bytes) AS bigint) AS s FROM v_tiles GROUP BY lake_id, year) t""",
    "v_tiles",
)
def status_rollup(spark, tiles):
    return merges.rolled_up(tiles)


@query(
    """SELECT lake_id, year, CASE WHEN bad THEN 'failed' ELSE status END AS status, NOT bad AS has_vector, CASE WHEN bad THEN 'no image' END AS error_message
       FROM (SELECT *, lake_id % 9 = 0 AS bad FROM v_regions) t""",
    "v_regions",
)
def mark_failed(spark, regions):
    out = merges.marked_failed(regions, regions.where("lake_id % 9 = 0"), "no image")
    return out.select(*KEYS, "status", F.col("embedding").isNotNull().alias("has_vector"), "error_message")


@query(
    """SELECT r.lake_id, year, CASE WHEN country ILIKE 'asia' THEN 'pending' ELSE status END AS status
       FROM v_regions r LEFT JOIN v_lakes l ON r.lake_id = l.lake_id""",
    "v_regions",
    "v_lakes",
)
def country_refresh(spark, regions, sites):
    return merges.refreshed(regions, sites, "Asia").select(*KEYS, "status")


@query("SELECT lake_id, country FROM v_lakes WHERE country IS NULL OR NOT country ILIKE 'asia'", "v_lakes")
def country_delete(spark, sites):
    return merges.without_country(sites, "Asia").select("lake_id", "country")


@query("SELECT lake_id, CAST(y AS int) AS year FROM v_lakes, (VALUES (2019), (2020), (2021)) g(y) WHERE is_active", "v_lakes")
def lake_year_jobs(spark, sites):
    return merges.jobs(sites, [2020, 2019, 2021, 2020])


@query(
    """SELECT k AS permission_key, coalesce((SELECT bool_or(is_active) FROM v_lakes WHERE state = 'BRAZIL'), false)
              AND coalesce((SELECT bool_or(is_active) FROM v_lakes WHERE state = k), false) AS allowed
       FROM (SELECT DISTINCT state AS k FROM v_lakes UNION ALL SELECT 'unknown') t""",
    "v_lakes",
)
def permission_gate(spark, sites):
    """Permissions by state, on where a site is active; one of them is the master switch."""
    table = sites.select(F.col("state").alias("permission_key"), F.col("is_active").alias("is_enabled"))
    keys = table.select("permission_key").distinct().unionByName(spark.createDataFrame([("unknown",)], "permission_key string"))
    return merges.permitted_keys(table, keys, master="BRAZIL")


@query(
    """SELECT count(*) FILTER (status IN ('completed', 'merged')) AS success, count(*) FILTER (status = 'failed') AS failed,
              count(*) FILTER (status = 'skipped') AS skipped, count(*) AS total, least(100, count(error_message)) AS errors FROM v_images""",
    "v_images",
)
def run_counters(spark, images):
    return merges.run_counters(images).withColumn("errors", F.size("errors").cast("long"))


_DONE = "embedding_version = 2 AND status = 'completed'"
_METRICS = {
    "lakes_active": "SELECT y AS year, count(*) AS n FROM v_lakes, ys WHERE is_active GROUP BY y",
    "lake_tiles_completed": "SELECT year, count(*) AS n FROM v_tiles WHERE status = 'COMPLETED' GROUP BY year",
    "lake_tiles_not_completed": "SELECT year, count(*) AS n FROM v_tiles WHERE status <> 'COMPLETED' GROUP BY year",
    "lake_images_downloaded_not_merged": "SELECT year, count(*) AS n FROM v_images WHERE status = 'completed' GROUP BY year",
    "lake_images_merged": "SELECT year, count(*) AS n FROM v_images WHERE status = 'merged' GROUP BY year",
    "lake_images_failed": "SELECT year, count(*) AS n FROM v_images WHERE status NOT IN ('completed', 'merged') GROUP BY year",
    "regions_v2_completed": f"SELECT year, count(*) AS n FROM v_regions WHERE {_DONE} AND embedding IS NOT NULL AND lake_embedding IS NOT NULL GROUP BY year",
    "regions_v2_with_shore": f"SELECT year, count(*) AS n FROM v_regions WHERE {_DONE} AND shore_embedding IS NOT NULL GROUP BY year",
    "regions_v2_lake_weights_distinct": f"SELECT year, count(DISTINCT lake_weight) AS n FROM v_regions WHERE {_DONE} AND shore_embedding IS NOT NULL GROUP BY year",
    "regions_failed": "SELECT year, count(*) AS n FROM v_regions WHERE status <> 'completed' OR embedding IS NULL GROUP BY year",
    "regions_legacy_v1": "SELECT year, count(*) AS n FROM v_regions WHERE coalesce(embedding_version, 1) < 2 GROUP BY year",
    "lake_features_v2_completed": "SELECT year, count(*) AS n FROM v_results WHERE status = 'completed' AND feature_version = 2 GROUP BY year",
    "lake_features_failed": "SELECT year, count(*) AS n FROM v_results WHERE status <> 'completed' GROUP BY year",
    "lake_features_legacy_v1": "SELECT year, count(*) AS n FROM v_results WHERE status = 'completed' AND feature_version < 2 GROUP BY year",
    "check_merged_without_embedding": f"""SELECT year, count(*) AS n FROM v_images i WHERE status = 'merged' AND NOT EXISTS (
        SELECT 1 FROM v_regions r WHERE r.lake_id = i.lake_id AND r.year = i.year AND {_DONE.replace("status", "r.status")}) GROUP BY year""",
    "check_merged_without_features": """SELECT year, count(*) AS n FROM v_images i WHERE status = 'merged' AND NOT EXISTS (
        SELECT 1 FROM v_results r WHERE r.lake_id = i.lake_id AND r.year = i.year AND r.status = 'completed' AND feature_version = 2) GROUP BY year""",
    "check_embedding_without_merged_image": f"""SELECT year, count(*) AS n FROM v_regions r WHERE {_DONE} AND NOT EXISTS (
        SELECT 1 FROM v_images i WHERE r.lake_id = i.lake_id AND r.year = i.year AND i.status = 'merged') GROUP BY year""",
    "check_features_without_merged_image": """SELECT year, count(*) AS n FROM v_results r WHERE status = 'completed' AND NOT EXISTS (
        SELECT 1 FROM v_images i WHERE r.lake_id = i.lake_id AND r.year = i.year AND i.status = 'merged') GROUP BY year""",
    "check_active_lakes_without_image": """SELECT y AS year, count(*) AS n FROM v_lakes l, ys WHERE is_active AND NOT EXISTS (
        SELECT 1 FROM v_images i WHERE i.lake_id = l.lake_id AND i.year = ys.y) GROUP BY y""",
}
_VERIFY = "SELECT * FROM (WITH ys AS (SELECT y FROM (VALUES (1996), (1997), (1998)) g(y)), m AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, t.* FROM ({sql}) t" for name, sql in _METRICS.items()
) + f"), names AS (SELECT unnest([{', '.join(map(repr, _METRICS))}]) AS table_name) SELECT table_name, " + ", ".join(
    f'CAST(coalesce(sum(n) FILTER (year = {y}), 0) AS bigint) AS "{y}"' for y in (1996, 1997, 1998)
) + " FROM names LEFT JOIN m USING (table_name) GROUP BY table_name) t"


@query(_VERIFY, "v_lakes", "v_tiles", "v_images", "v_regions", "v_results")
def verify_counts(spark, sites, tiles, images, regions, features):
    return audits.verify_counts(sites, tiles, images, regions, features, [1996, 1997, 1998])


@query("SELECT year, count(DISTINCT lake_id) AS lake_count FROM v_tiles WHERE status = 'COMPLETED' GROUP BY year ORDER BY year DESC", "v_tiles")
def mergeable_years(spark, tiles):
    return audits.mergeable_years(tiles)


@query(
    """SELECT year, root, count(*) AS lakes, max(updated_at) AS last_used FROM (
           SELECT year, regexp_extract(min(image_path), '^(.*)/[0-9]{4}/', 1) AS root, max(updated_at) AS updated_at
           FROM v_tiles WHERE status = 'COMPLETED' GROUP BY lake_id, year) t GROUP BY year, root""",
    "v_tiles",
)
def year_root_summary(spark, tiles):
    per_site = tiles.where("status = 'COMPLETED'").groupBy(*KEYS).agg(F.min("image_path").alias("p"), F.max("updated_at").alias("updated_at"))
    return audits.year_roots(per_site.withColumn("root", path_root(F.col("p"), F.col("year"))))


@query(
    """SELECT year, string_agg(concat(root, '/', year, '/lake_{lake_id:06d}.tif'), ' · ' ORDER BY last_used DESC, root) AS output_path_pattern FROM (
           SELECT year, regexp_extract(path, '^(.*)/[0-9]{4}/', 1) AS root, max(updated_at) AS last_used FROM (
               SELECT lake_id, year, min(image_path) AS path, max(updated_at) AS updated_at
               FROM v_tiles WHERE status = 'COMPLETED' GROUP BY lake_id, year) p GROUP BY year, root) t GROUP BY year""",
    "v_tiles",
)
def output_path_patterns(spark, tiles):
    return audits.output_patterns(tiles, "/data")


@query(
    "SELECT image_path AS root FROM (SELECT regexp_extract(image_path, '^(.*)/[0-9]{4}/', 1) AS image_path FROM v_tiles) t GROUP BY image_path ORDER BY count(*) DESC, image_path LIMIT 1",
    "v_tiles",
)
def common_root(spark, tiles):
    return audits.common_path(tiles.select(path_root(F.col("image_path"), F.col("year")).alias("root"), path_year(F.col("image_path")).alias("y")), "root")


@query(
    """SELECT country, state, count(*) AS images, count(DISTINCT lake_id) AS lakes, CAST(sum(file_size_bytes) AS bigint) AS bytes,
              round(sum(file_size_bytes) / count(*), 2) AS bytes_an_image
       FROM v_images JOIN v_lakes USING (lake_id) GROUP BY country, state""",
    "v_images",
    "v_lakes",
)
def image_totals(spark, images, sites):
    return catalog.image_totals(images.join(sites.select("lake_id", "country", "state"), "lake_id"))


@query("SELECT lake_id, year FROM v_images", "v_images")
def json_recordset(spark, images):
    """Rows sent as JSON text, some hundred sites to a text, and opened again."""
    sent = images.groupBy("year", F.floor(F.col("lake_id") / 500).alias("part")).agg(F.to_json(F.collect_list(F.struct("lake_id", "year"))).alias("rows"))
    return recordset(sent, "rows", "lake_id:bigint,year:int")


@query(
    """SELECT coalesce(n.lake_id, o.lake_id) AS lake_id, coalesce(n.year, o.year) AS year, CASE WHEN n.lake_id IS NOT NULL THEN n.status ELSE o.status END AS status,
              n.center_lat, n.center_lon
       FROM v_results o FULL JOIN (
           SELECT i.lake_id, i.year, i.status, coalesce(l.center_lat, l.pour_lat) AS center_lat, coalesce(l.center_lon, l.pour_lon) AS center_lon
           FROM v_images i JOIN v_lakes l ON l.lake_id = i.lake_id WHERE i.lake_id % 2 = 1) n ON n.lake_id = o.lake_id AND n.year = o.year""",
    "v_results",
    "v_images",
    "v_lakes",
)
def region_upsert(spark, results, images, lakes):
    """Rows that take their lake's centre; of two writes of a row the later one counts."""
    new = images.where("lake_id % 2 = 1").join(lakes.select("lake_id"), "lake_id", "left_semi").select("lake_id", "year", "status")
    twice = new.withColumns({"status": F.lit("first"), "written": F.lit(1)}).unionByName(new.withColumn("written", F.lit(2)))
    return merges.merged(results.select("lake_id", "year", "status"), merges.with_centres(twice, lakes), ["lake_id", "year"], "written")
