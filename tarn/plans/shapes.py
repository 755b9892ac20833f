"""Polygons: masks, buffers, tiles, states with holes, shapefiles and well-known text."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import geo
from tarn.operators import geometry, merges, spatial
from tarn.plans.base import query, rounded
from tarn.plans.places import _K, _Q, rings
from tarn.sources.shapefiles import record_count, shapefile_rows, write_shapefile


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))


def ring(x: Column, y: Column, reach: Column, corners) -> Column:
    return F.array(*(point(x + dx * reach, y + dy * reach) for dx, dy in [*corners, corners[0]]))


DIAMOND = [(1, 0), (0, 1), (-1, 0), (0, -1)]
BOX = [(-1, -1), (1, -1), (1, 1), (-1, 1)]

_REACH = "(1 + lake_id % 4)"


def diamonds(sites: DataFrame) -> DataFrame:
    """A diamond around each site, with a square hole."""
    known = sites.where("center_lon IS NOT NULL")
    x, y, reach = F.col("center_lon"), F.col("center_lat"), 1 + F.col("lake_id") % 4
    return known.withColumn("polygons", F.array(F.array(ring(x, y, reach, DIAMOND), ring(x, y, reach * 0.25, BOX))))


@query(
    """SELECT p.lake_id, p.year, p.r, p.c,
              abs(0.0625 * (p.c + 0.5) - 0.37) + abs(0.0625 * (p.r + 0.5) - 0.38) < 0.1 * (1 + p.lake_id % 4)
              AND NOT (abs(0.0625 * (p.c + 0.5) - 0.37) < 0.025 * (1 + p.lake_id % 4) AND abs(0.0625 * (p.r + 0.5) - 0.38) < 0.025 * (1 + p.lake_id % 4)) AS in_lake
       FROM v_pixels p""",
    "v_pixels",
)
def lake_mask(spark, pixels):
    """Pixels whose centre is in their site's polygon, a diamond with a square hole."""
    sites = pixels.select("lake_id").distinct()
    x, y, reach = F.lit(0.37), F.lit(1 - 0.38), 0.1 * (1 + F.col("lake_id") % 4)
    shapes = sites.withColumn("polygons", F.array(F.array(ring(x, y, reach, DIAMOND), ring(x, y, reach * 0.25, BOX))))
    grids = sites.select("lake_id", *(F.lit(v).alias(n) for n, v in (("west", 0.0), ("north", 1.0), ("pixel_w", 0.0625), ("pixel_h", 0.0625), ("n_rows", 12), ("n_cols", 12))))
    return geometry.masked(pixels, shapes, grids).select("lake_id", "year", "r", "c", "in_lake")


@query(
    """SELECT p.lake_id, p.year, p.r, p.c, min((p.r - q.r) * (p.r - q.r) + (p.c - q.c) * (p.c - q.c)) AS square
       FROM v_pixels p LEFT JOIN v_pixels q ON q.lake_id = p.lake_id AND q.year = p.year AND q.b8 < 200
            AND (p.r - q.r) * (p.r - q.r) + (p.c - q.c) * (p.c - q.c) <= 289
       GROUP BY p.lake_id, p.year, p.r, p.c""",
    "v_pixels",
)
def shore_distance(spark, pixels):
    """The square of the way to the lake, within the seventeen pixels of 500 m."""
    lake = pixels.withColumn("in_lake", F.col("b8") < 200)
    return spatial.lake_distances(lake, 17).select("lake_id", "year", "r", "c", "square")


@query(
    f"""SELECT lake_id, round(radians(center_lon - 0.2) * 6378137.0 * {_K} - 3500, 2) AS west, round(radians(center_lon + 0.2) * 6378137.0 * {_K} + 3500, 2) AS east,
               round({_Q("(center_lat - 0.2)")} * 6378137.0 / (2 * {_K}) - 3500, 2) AS south, round({_Q("(center_lat + 0.2)")} * 6378137.0 / (2 * {_K}) + 3500, 2) AS north,
               CAST(1 AS int) AS n_polygons, CAST(0 AS int) AS n_holes
        FROM v_lakes WHERE center_lat IS NOT NULL""",
    "v_lakes",
)
def buffered_lakes(spark, sites):
    """Boxes around sites with 3500 m around them, and a small hole that the buffer fills."""
    known = sites.where("center_lat IS NOT NULL")
    x, y = F.col("center_lon"), F.col("center_lat")
    shapes = known.select("lake_id", F.array(F.array(ring(x, y, F.lit(0.2), BOX), ring(x, y, F.lit(0.02), DIAMOND))).alias("polygons"))
    wide = geometry.buffered(geometry.in_metres(shapes), tolerance=0)
    holes = F.size(F.flatten("polygons")) - F.size("polygons")
    out = wide.select("lake_id", F.inline(F.array(geo.bounds(F.flatten(F.flatten("polygons"))))), F.size("polygons").alias("n_polygons"), holes.alias("n_holes"))
    return rounded(out, digits=2)


_TILE = f"""
    SELECT lake_id, concat(col, '_', row) AS tile_index, cx - wx AS a, cx + wx AS b, cy - wy AS c, cy + wy AS d, x0, y0, x1, y1, cx, cy, R
    FROM (SELECT *, R - abs(greatest(y0, least(y1, cy)) - cy) AS wx, R - abs(greatest(x0, least(x1, cx)) - cx) AS wy
          FROM (SELECT *, cx - R + col * 25000 AS x0, cx - R + (col + 1) * 25000 AS x1, cy - R + row * 25000 AS y0, cy - R + (row + 1) * 25000 AS y1
                FROM (SELECT *, unnest(range(CAST(ceil(2 * R / 25000) AS bigint))) AS row
                      FROM (SELECT *, unnest(range(CAST(ceil(2 * R / 25000) AS bigint))) AS col
                            FROM (SELECT lake_id, radians(center_lon) * 6378137.0 * {_K} AS cx, {_Q("center_lat")} * 6378137.0 / (2 * {_K}) AS cy,
                                         CAST(20011 + 7013 * (lake_id % 5) AS double) AS R FROM v_lakes WHERE center_lat IS NOT NULL) l) m) g) h) t
    WHERE greatest(x0, cx - wx) <= least(x1, cx + wx) AND greatest(y0, cy - wy) <= least(y1, cy + wy)"""


@query(
    f"""SELECT lake_id, tile_index, round(greatest(x0, a), 2) AS min_x, round(greatest(y0, c), 2) AS min_y, round(least(x1, b), 2) AS max_x, round(least(y1, d), 2) AS max_y,
               round(greatest(x0, a), 2) AS back_x, round(least(y1, d), 2) AS back_y FROM ({_TILE}) t""",
    "v_lakes",
)
def tile_plan(spark, sites):
    """Tiles of a diamond around each site, cut to what it covers; their boxes in degrees lead back to them."""
    tiles = geometry.tiles_of(plan_shapes(sites))
    back = {"back_x": geo.mercator_6933(F.col("south"), F.col("west"))["x"], "back_y": geo.mercator_6933(F.col("north"), F.col("east"))["y"]}
    return rounded(tiles.withColumns(back).select("lake_id", "tile_index", "min_x", "min_y", "max_x", "max_y", *back), digits=2)


def plan_shapes(sites: DataFrame) -> DataFrame:
    """Diamonds in metres around the sites."""
    middle = geo.mercator_6933(F.col("center_lat"), F.col("center_lon"))
    known = sites.where("center_lat IS NOT NULL").select("lake_id", middle.alias("m"), (20011 + 7013 * (F.col("lake_id") % 5)).cast("double").alias("reach"))
    return known.select("lake_id", F.array(F.array(ring(F.col("m.x"), F.col("m.y"), F.col("reach"), DIAMOND))).alias("polygons"))


@query(
    "SELECT lake_id, round(2 * R * R / 1e6, 3) AS km2, round(2 * R * R / 1e6, 3) AS plan_km2 FROM (SELECT DISTINCT lake_id, R FROM (" + _TILE + ") u) t",
    "v_lakes",
)
def tile_plan_areas(spark, sites):
    """The area of a shape, and the sum of its parts in the tiles."""
    shapes = plan_shapes(sites)
    parts = geometry.tiles_of(shapes).groupBy("lake_id").agg(F.sum("area_m2").alias("whole"))
    out = shapes.select("lake_id", geo.area(F.col("polygons")).alias("area")).join(parts, "lake_id")
    return rounded(out.select("lake_id", (F.col("area") / 1e6).alias("km2"), (F.col("whole") / 1e6).alias("plan_km2")), digits=3)


@query(
    f"""SELECT p.lake_id, 2020 AS year, p.tile_index FROM ({_TILE}) p WHERE NOT (p.lake_id % 3 = 0 AND p.tile_index LIKE '0%') """,
    "v_lakes",
)
def tile_plan_pending(spark, sites):
    """From polygons to the tiles that are still to be loaded, some of them being there."""
    on_globe = lambda c: F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.col(c)))
    box = geo.bbox_wkt(F.struct(on_globe("south").alias("min_lat"), F.col("west").alias("min_lon"), on_globe("north").alias("max_lat"), F.col("east").alias("max_lon")))
    plan = geometry.tiles_of(plan_shapes(sites)).select("lake_id", F.lit(2020).alias("year"), "tile_index", box.alias("bbox"))
    done = plan.where("lake_id % 3 = 0 AND tile_index LIKE '0%'").withColumns({"status": F.lit("COMPLETED"), "image_path": F.lit("/data/tile.tif")})
    return merges.pending_tiles(merges.tiles_after_plan(done, plan)).select("lake_id", "year", "tile_index")


_HOLED = """
    SELECT area_name, west, east, south, north, false AS enclave FROM v_states
    UNION ALL SELECT concat('Enclave of ', area_name), west + 20, west + 50, south + 10, south + 24, true FROM v_states"""


@query(
    f"""SELECT lake_id, min(area_name) AS area_name FROM (
            SELECT l.lake_id, s.area_name FROM v_lakes l LEFT JOIN ({_HOLED}) s ON center_lon BETWEEN west AND east AND center_lat BETWEEN south AND north
                AND NOT (NOT enclave AND center_lon > west + 20 AND center_lon < west + 50 AND center_lat > south + 10 AND center_lat < south + 24)) t
        GROUP BY lake_id""",
    "v_lakes",
    "v_states",
)
def state_attribution_with_holes(spark, sites, states):
    """States with an enclave each, which is a state of its own and a hole in the other."""
    inner = states.select(F.concat(F.lit("Enclave of "), "area_name").alias("area_name"), *((F.col(c) + d).alias(n) for n, c, d in (("west", "west", 20), ("east", "west", 50), ("south", "south", 10), ("north", "south", 24))))
    hole = rings(inner).select(F.regexp_replace("area_name", "Enclave of ", "").alias("area_name"), F.col("ring").alias("hole"))
    outer = rings(states).join(hole, "area_name").select("area_name", F.array(F.array("ring", "hole")).alias("polygons"))
    areas = outer.unionByName(rings(inner).select("area_name", F.array(F.array("ring")).alias("polygons")))
    return spatial.attributed(sites, areas).select("lake_id", "area_name")


@query(
    f"SELECT lake_id, round(2 * {_REACH} * {_REACH} - 0.25 * {_REACH} * {_REACH}, 6) AS area, CAST(2 AS int) AS n_rings, true AS same FROM v_lakes WHERE center_lon IS NOT NULL",
    "v_lakes",
)
def wkt_round_trip(spark, sites):
    """Shapes as text and back, with their area in square degrees."""
    shapes = diamonds(sites)
    back = shapes.withColumn("back", geo.polygons_of_wkt(geo.wkt_of_polygons(F.col("polygons"))))
    same = F.col("back") == F.col("polygons")
    return rounded(back.select("lake_id", geo.area(F.col("back")).alias("area"), F.size(F.flatten("back")).alias("n_rings"), same.alias("same")))


def shared_folder(spark) -> str:
    """A new folder that all executors see: beside the checkpoints, or a temporary one of a local session."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or (tempfile.gettempdir() if context.master.startswith("local[") or context.master == "local" else None)
    if root is None:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{root.removeprefix('file://')}/shapes-{uuid.uuid4().hex}"


def written(spark, sites: DataFrame) -> str:
    """The sites' diamonds as shapefiles."""
    folder = shared_folder(spark)
    attributes = [F.col("lake_id").alias("Hylak_id"), F.col("lake_name").alias("Lake_name"), F.col("country").alias("Country"), F.col("area_sqkm").alias("Lake_area"), F.col("pour_lat").alias("Pour_lat"), F.col("pour_lon").alias("Pour_long")]
    write_shapefile(diamonds(sites).select(*attributes, "polygons"), folder)
    return folder


@query(
    f"""SELECT lake_id, lake_name, country, area_sqkm, round(center_lon, 6) AS center_lon, round(center_lat, 6) AS center_lat,
               round(1.75 * {_REACH} * {_REACH}, 6) AS shape_area
        FROM v_lakes WHERE center_lon IS NOT NULL AND lower(country) = 'asia'""",
    "v_lakes",
)
def shapefile_lakes(spark, sites):
    """Sites written as shapefiles and one country's read back, geometry only where asked for."""
    lakes = spatial.lakes_of(shapefile_rows(spark, written(spark, sites), country="asia"))
    out = lakes.select("lake_id", "lake_name", "country", "area_sqkm", "center_lon", "center_lat", geo.area(F.col("polygons")).alias("shape_area"))
    return rounded(out, "center_lon", "center_lat", "shape_area")


@query(
    """SELECT count(*) FILTER (country = 'ASIA' AND lake_id % 2 = 0) AS updated_records, count(*) FILTER (country = 'ASIA' AND lake_id % 2 = 1) AS inserted_records,
              count(*) AS total_records, CAST(0 AS bigint) AS skipped_records FROM v_lakes WHERE center_lon IS NOT NULL""",
    "v_lakes",
    "v_states",
)
def lake_import_counts(spark, sites, states):
    """Counts of an import into a table that knows every second lake."""
    folder = written(spark, sites)
    old = sites.where("lake_id % 2 = 0").select("lake_id", "lake_name", "country")
    areas = rings(states).select("area_name", F.array(F.array("ring")).alias("polygons"))
    return spatial.imported_lakes(shapefile_rows(spark, folder, country="Asia"), areas, old, record_count(folder))[1]
