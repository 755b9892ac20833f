"""Spatial attribution, tile grids, sizes and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import geo
from tarn.operators import spatial
from tarn.plans.base import query, rounded

_INSIDE = "center_lon BETWEEN west AND east AND center_lat BETWEEN south AND north"


def rings(boxes):
    corner = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    around = [("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south")]
    return boxes.withColumn("ring", F.array(*(corner(x, y) for x, y in around)))


def boxed(sites, half: float = 0.2):
    return sites.where("center_lat IS NOT NULL").select(
        "lake_id",
        *((F.col(c) + d).alias(n) for n, c, d in (("west", "center_lon", -half), ("east", "center_lon", half), ("south", "center_lat", -half), ("north", "center_lat", half))),
    )


@query(
    f"SELECT lake_id, min(area_name) AS area_name FROM v_lakes LEFT JOIN v_states ON {_INSIDE} GROUP BY lake_id",
    "v_lakes",
    "v_states",
)
def spatial_state_attribution(spark, sites, states):
    return spatial.attributed(sites, rings(states).select("area_name", "ring")).select("lake_id", "area_name")


@query(
    f"""SELECT lake_id, area AS new_state, CASE WHEN lake_name IS NOT NULL AND trim(lake_name) <> '' AND trim(lake_name) <> CAST(lake_id AS varchar) THEN lake_name
               WHEN area IS NOT NULL THEN concat('Unnamed Lake #', lake_id, ' (', area, ')') ELSE concat('Unnamed Lake #', lake_id) END AS display_name
        FROM (SELECT lake_id, lake_name, min(area_name) AS area FROM v_lakes LEFT JOIN v_states ON {_INSIDE} GROUP BY lake_id, lake_name) t""",
    "v_lakes",
    "v_states",
)
def lake_import(spark, sites, states):
    return spatial.imported(sites, rings(states).select("area_name", "ring")).select("lake_id", "new_state", "display_name")


_E2 = 0.0066943799901413165
_E = _E2**0.5
_Q = lambda lat: f"((1 - {_E2}) * (sin(radians({lat})) / (1 - {_E2} * sin(radians({lat})) * sin(radians({lat}))) + ln((1 + {_E} * sin(radians({lat}))) / (1 - {_E} * sin(radians({lat})))) / (2 * {_E})))"
_K = f"(cos(radians(30)) / sqrt(1 - {_E2} * 0.25))"


@query(
    f"""SELECT lake_id, concat(col, '_', row) AS tile_index, round(x0 + col * 25000, 3) AS min_x, round(y0 + row * 25000, 3) AS min_y,
               round(least(x1, x0 + (col + 1) * 25000), 3) AS max_x, round(least(y1, y0 + (row + 1) * 25000), 3) AS max_y
        FROM (SELECT lake_id, x0, y0, x1, y1, col, unnest(range(CAST(ceil((y1 - y0) / 25000) AS bigint))) AS row
              FROM (SELECT *, unnest(range(CAST(ceil((x1 - x0) / 25000) AS bigint))) AS col FROM (
                    SELECT lake_id, radians(center_lon - 0.2) * 6378137.0 * {_K} - 3500 AS x0, radians(center_lon + 0.2) * 6378137.0 * {_K} + 3500 AS x1,
                           {_Q("(center_lat - 0.2)")} * 6378137.0 / (2 * {_K}) - 3500 AS y0, {_Q("(center_lat + 0.2)")} * 6378137.0 / (2 * {_K}) + 3500 AS y1
                    FROM v_lakes WHERE center_lat IS NOT NULL) a) b) t""",
    "v_lakes",
)
def tile_grid(spark, sites):
    return rounded(spatial.tile_grid(boxed(sites)), digits=3)


@query(
    """SELECT round(sum(a), 0) AS area_m2, round(sum(a / 900 * 24), 0) AS bytes, count(*) AS lakes FROM (
           SELECT (0.4 * 111320.0 * cos(radians(center_lat)) + 7000) * (0.4 * 110574.0 + 7000) AS a FROM v_lakes WHERE center_lat IS NOT NULL) t""",
    "v_lakes",
)
def size_estimate(spark, sites):
    return rounded(spatial.storage_estimate(boxed(sites)), digits=0)


@query(
    f"""SELECT lake_id, round(radians(0.00027) * 6378137.0 * 6378137.0 / 2 * abs({_Q("center_lat")} - {_Q("(center_lat - 0.00027)")}), 2) AS m2
        FROM v_lakes WHERE center_lat IS NOT NULL""",
    "v_lakes",
)
def pixel_areas(spark, sites):
    side = F.lit(0.00027)
    return sites.where("center_lat IS NOT NULL").select(
        "lake_id", F.round(geo.pixel_area_m2(F.col("center_lat"), side, side), 2).alias("m2")
    )


@query(
    """SELECT lake_id, round(center_lat - u, 6) AS min_lat, round(center_lon - u / cos(radians(center_lat)), 6) AS min_lon,
              round(center_lat + u, 6) AS max_lat, round(center_lon + u / cos(radians(center_lat)), 6) AS max_lon, true AS is_polygon
       FROM (SELECT *, 2.5 / 6371.0 * 180 / pi() AS u FROM v_lakes WHERE center_lat IS NOT NULL) t""",
    "v_lakes",
)
def grid_cells(spark, sites):
    box = geo.bbox_around(F.col("center_lat"), F.col("center_lon"))
    polygon = geo.bbox_wkt(box).rlike(r"^POLYGON\(\(([-\d.E]+ [-\d.E]+, ){4}[-\d.E]+ [-\d.E]+\)\)$")
    return rounded(
        sites.where("center_lat IS NOT NULL").select("lake_id", F.inline(F.array(box)), polygon.alias("is_polygon"))
    )


@query("SELECT area_name, west, south, east, north FROM v_states", "v_states")
def geometry_bounds(spark, states):
    return rings(states).select("area_name", F.inline(F.array(geo.bounds(F.col("ring")))))


@query(
    """SELECT lake_id, country, place, round(6371.0 * 2 * atan2(sqrt(h), sqrt(1 - h)), 6) AS distance_km FROM (
           SELECT *, CAST(row_number() OVER (PARTITION BY country ORDER BY h, lake_id) AS int) AS place FROM (
               SELECT lake_id, country, pow(sin(radians(center_lat - 10) / 2), 2)
                      + cos(radians(10)) * cos(radians(center_lat)) * pow(sin(radians(center_lon + 30) / 2), 2) AS h
               FROM v_lakes WHERE center_lat IS NOT NULL) a) t""",
    "v_lakes",
)
def distance_ranks(spark, sites):
    ranked = spatial.ranked_by_distance(sites.where("center_lat IS NOT NULL"), 10.0, -30.0)
    return rounded(ranked.select("lake_id", "country", "place", "distance_km"))


@query(
    """SELECT p.lake_id, p.year, p.r, p.c, q.lake_id IS NOT NULL AND NOT p.b8 < 300 AS in_shore
       FROM v_pixels p LEFT JOIN (
           SELECT DISTINCT lake_id, year, r + dy AS r, c + dx AS c
           FROM v_pixels, (VALUES (-2, 0), (-1, -1), (-1, 0), (-1, 1), (0, -2), (0, -1), (0, 0), (0, 1), (0, 2), (1, -1), (1, 0), (1, 1), (2, 0)) d(dy, dx)
           WHERE b8 < 300) q
       ON q.lake_id = p.lake_id AND q.year = p.year AND q.r = p.r AND q.c = p.c""",
    "v_pixels",
)
def shore_ring(spark, pixels):
    """Pixels of every site within two of its lake's, here those of a dark band."""
    lake = pixels.withColumn("in_lake", F.col("b8") < 300)
    return spatial.shore_pixels(lake, 2).select("lake_id", "year", "r", "c", "in_shore")


@query(
    """SELECT lake_id, concat(i, '_', j) AS tile_index
       FROM (SELECT lake_id, center_lon AS x, center_lat AS y, 1 + lake_id % 4 AS reach, i, j, floor(center_lon) - 6 + i * 3 AS w, floor(center_lat) - 6 + j * 3 AS s
             FROM v_lakes, (VALUES (0), (1), (2), (3)) a(i), (VALUES (0), (1), (2), (3)) b(j) WHERE center_lon IS NOT NULL) t
       WHERE greatest(w - x, 0, x - w - 3) + greatest(s - y, 0, y - s - 3) <= reach""",
    "v_lakes",
)
def polygon_tiles(spark, sites):
    """Tiles of a grid that a diamond around each site reaches; its SQL measures the way to the tile.

    Places count from the site, so that the diamond's corners are exact and a tile that just touches it is told.
    """
    known = sites.where("center_lon IS NOT NULL").withColumn("reach", (1 + F.col("lake_id") % 4).cast("double"))
    corner = lambda dx, dy: F.struct((dx * F.col("reach")).alias("lon"), (dy * F.col("reach")).alias("lat"))
    rings = known.select("lake_id", F.array(corner(1, 0), corner(0, 1), corner(-1, 0), corner(0, -1), corner(1, 0)).alias("ring"))
    four = F.sequence(F.lit(0), F.lit(3))
    low = {"min_x": F.floor("center_lon") - 6 + F.col("i") * 3 - F.col("center_lon"), "min_y": F.floor("center_lat") - 6 + F.col("j") * 3 - F.col("center_lat")}
    tiles = (
        known.withColumn("i", F.explode(four)).withColumn("j", F.explode(four)).withColumns(low)
        .select("lake_id", F.concat_ws("_", "i", "j").alias("tile_index"), "min_x", "min_y",
                (F.col("min_x") + 3).alias("max_x"), (F.col("min_y") + 3).alias("max_y"))
    )
    return spatial.covered_tiles(tiles, rings).select("lake_id", "tile_index")
