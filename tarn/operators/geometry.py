"""Polygons as sets of pixels, buffers, tiles, and an index of areas by cells.

A shape has ``polygons``: an array of polygons, each an array of rings, of which the
first is the border and the others are holes; rings are closed arrays of points with
lon and lat, in degrees unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.constants import BUFFER_M, SCALE_M, TILE_M
from tarn.functions import geo
from tarn.functions.offsets import buffer, simplified

POLYGONS = "array<array<array<struct<lon:double,lat:double>>>>"
#: Sides of an area that a cell of the index holds on average, and at most before it is parted.
SIDES, MOST_SIDES = 8, 32
#: Finest level of cells; a cell's part is finer by some levels.
FINEST, FINER = 20, 5


#: Parts for each core into which shapes are dealt for work on one at a time.
PARTS = 4


def rows_spanned(side: Column, top: Column, step: Column, most: Column) -> Column:
    """Numbers of the lines that a side may cross; line i is at top - (i + 1/2) step."""
    low, high = F.least(side["a"]["lat"], side["b"]["lat"]), F.greatest(side["a"]["lat"], side["b"]["lat"])
    first = F.greatest(F.ceil((top - high) / step - 0.5), F.lit(0).cast("long"))
    last = F.least(F.floor((top - low) / step - 0.5), most - 1)
    return F.when(first <= last, F.sequence(first, last))


def rasterised(shapes: DataFrame, grids: DataFrame) -> DataFrame:
    """(lake_id, r, c): pixels whose centre is inside the shape, on the shape's own grid.

    ``grids`` has lake_id, west, north, pixel_w, pixel_h, n_rows and n_cols, a row a
    site.  Each side meets the rows of centres that it spans; a row's crossings in
    order, taken by twos, bound runs of pixels.  Centres on a left border are inside,
    on a right one outside, as for any even-odd fill; holes are no part of it.
    """
    line = F.col("north") - (F.col("r") + 0.5) * F.col("pixel_h")
    place = lambda x: F.ceil((x - F.col("west")) / F.col("pixel_w") - 0.5)
    runs = F.transform(
        F.sequence(F.lit(1), F.floor(F.size("xs") / 2).cast("int")),
        lambda i: F.struct(
            F.greatest(place(F.element_at("xs", 2 * i - 1)), F.lit(0).cast("long")).alias("first"),
            F.least(place(F.element_at("xs", 2 * i)), F.col("n_cols")).alias("end"),
        ),
    )
    grid = ["west", "north", "pixel_w", "pixel_h", "n_rows", "n_cols"]
    placed = grids.select("lake_id", *(F.col(g).cast("long" if g.startswith("n_") else "double").alias(g) for g in grid))
    return (
        shapes.select("lake_id", F.explode(geo.sides(F.col("polygons"))).alias("side"))
        .join(placed, "lake_id")
        .withColumn("r", F.explode(rows_spanned(F.col("side"), F.col("north"), F.col("pixel_h"), F.col("n_rows"))))
        .withColumn("x", geo.crossing_lon(F.col("side"), line))
        .where("x IS NOT NULL")
        .groupBy("lake_id", "r", "west", "pixel_w", "n_cols")
        .agg(F.sort_array(F.collect_list("x")).alias("xs"))
        .withColumn("run", F.explode(runs))
        .where("run.first < run.end")
        .select("lake_id", F.col("r").cast("int").alias("r"), F.explode(F.sequence(F.col("run.first").cast("int"), F.col("run.end").cast("int") - 1)).alias("c"))
    )


def masked(pixels: DataFrame, shapes: DataFrame, grids: DataFrame) -> DataFrame:
    """``pixels`` with in_lake: whether the pixel's centre is inside its site's shape."""
    inside = rasterised(shapes, grids).withColumn("_in", F.lit(True))
    return (
        pixels.join(inside, ["lake_id", "r", "c"], "left")
        .withColumn("in_lake", F.coalesce("_in", F.lit(False)))
        .select(*pixels.columns, "in_lake")
    )


def in_metres(shapes: DataFrame) -> DataFrame:
    return shapes.withColumn("polygons", geo.mapped_points(F.col("polygons"), geo.to_metres))


def in_degrees(shapes: DataFrame) -> DataFrame:
    return shapes.withColumn("polygons", geo.mapped_points(F.col("polygons"), geo.to_degrees))


def dealt(shapes: DataFrame) -> DataFrame:
    """``shapes`` over all cores, some parts each: their bytes say little of the work that they make.

    A table of few bytes is one partition, and so would be one task.
    """
    return shapes.repartition(PARTS * shapes.sparkSession.sparkContext.defaultParallelism)


def buffered(shapes: DataFrame, distance: float = BUFFER_M, tolerance: float = SCALE_M) -> DataFrame:
    """``shapes``, in metres, with all that is within ``distance`` of them.

    Points are left out then where the border moves by ``tolerance`` at most; 0 leaves
    all.  One shape at a time is compared with itself, so a task holds one.
    """
    place = shapes.columns.index("polygons")

    def widen(rings: list) -> list:
        points = [[np.array([[q["lon"], q["lat"]] for q in ring[:-1]]).reshape(-1, 2) for ring in own] for own in rings]
        found = buffer(points, distance)
        found = [simplified(own, tolerance) for own in found] if tolerance else found
        return [[[{"lon": x, "lat": y} for x, y in (*ring.tolist(), ring[0].tolist())] for ring in own] for own in found]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                rings = row.column(place)[0].as_py()
                made = pa.array([None if rings is None else widen(rings)], batch.schema.field(place).type)
                yield row.set_column(place, batch.schema.field(place), made)

    typed = dealt(shapes.withColumn("polygons", F.col("polygons").cast(POLYGONS)))
    return typed.mapInArrow(read, typed.schema)


def covered_box(polygons: Column, low_x: Column, low_y: Column, high_x: Column, high_y: Column) -> Column:
    """Box of the part of polygons inside a tile; null if they do not reach it.

    Its extremes are ends of sides cut at the tile's edges, and corners of the tile
    that are covered.
    """
    tile = {"lon": (low_x, high_x), "lat": (low_y, high_y)}

    def cut(s: Column) -> Column:
        a, b = s["a"], s["b"]
        enters, leaves, level = [F.lit(0.0)], [F.lit(1.0)], F.lit(True)
        for axis, (low, high) in tile.items():
            step = b[axis] - a[axis]
            moves = F.when(step != 0, step)
            one, two = (low - a[axis]) / moves, (high - a[axis]) / moves
            enters.append(F.coalesce(F.least(one, two), F.lit(0.0)))
            leaves.append(F.coalesce(F.greatest(one, two), F.lit(1.0)))
            level = level & ((step != 0) | a[axis].between(low, high))
        first, last = F.greatest(*enters), F.least(*leaves)
        at = lambda t, axis: F.least(F.greatest(a[axis] + t * (b[axis] - a[axis]), tile[axis][0]), tile[axis][1])
        end = lambda t: F.struct(at(t, "lon").alias("lon"), at(t, "lat").alias("lat"))
        shares = F.struct(first.alias("first"), last.alias("last"))
        return geo.once(shares, lambda t: F.when(level & (t["first"] <= t["last"]), F.array(end(t["first"]), end(t["last"]))))

    corners = F.array(*(F.struct(x.alias("lon"), y.alias("lat")) for x in (low_x, high_x) for y in (low_y, high_y)))
    kept = F.filter(corners, lambda q: geo.covered_by(polygons, q["lon"], q["lat"]))
    cuts = F.filter(F.transform(geo.sides(polygons), cut), lambda x: x.isNotNull())
    return geo.once(F.concat(F.flatten(cuts), kept), lambda points: F.when(F.size(points) > 0, geo.bounds(points)))


def tiles_of(shapes: DataFrame, tile_m: float = TILE_M) -> DataFrame:
    """Tiles of each site's grid that its shape, in metres, reaches, cut to what it covers.

    The grid starts at the shape's south-western corner.  Columns: lake_id, tile_index,
    min_x, min_y, max_x, max_y in metres, west, south, east, north in degrees, and
    area_m2, the area of the shape inside the tile.
    """
    box = geo.bounds(F.flatten(F.flatten("polygons")))
    steps = lambda low, high: F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil((F.col(high) - F.col(low)) / tile_m) - 1, F.lit(0).cast("long")))
    strip = geo.clipped_polygons(F.col("polygons"), "lon", F.col("x0"), F.col("x1"))
    piece = geo.clipped_polygons(F.col("strip"), "lat", F.col("y0"), F.col("y1"))
    corner = lambda x, y: geo.from_mercator_6933(F.col(f"cover.{x}"), F.col(f"cover.{y}"))
    return (
        dealt(shapes.where(F.size(F.flatten(F.flatten("polygons"))) > 0))
        .select("lake_id", "polygons", F.inline(F.array(box)))
        .withColumn("col", F.explode(steps("west", "east")))
        .withColumns({"x0": F.col("west") + F.col("col") * tile_m, "x1": F.col("west") + (F.col("col") + 1) * tile_m})
        .withColumn("strip", strip)
        .withColumn("row", F.explode(steps("south", "north")))
        .withColumns({"y0": F.col("south") + F.col("row") * tile_m, "y1": F.col("south") + (F.col("row") + 1) * tile_m})
        .withColumn("cover", covered_box(F.col("polygons"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
        .where("cover IS NOT NULL")
        .select(
            "lake_id",
            F.concat_ws("_", "col", "row").alias("tile_index"),
            *(F.col(f"cover.{side}").alias(name) for name, side in (("min_x", "west"), ("min_y", "south"), ("max_x", "east"), ("max_y", "north"))),
            corner("west", "south")["lon"].alias("west"),
            corner("west", "south")["lat"].alias("south"),
            corner("east", "north")["lon"].alias("east"),
            corner("east", "north")["lat"].alias("north"),
            geo.area(piece).alias("area_m2"),
        )
    )


#: SQL of the index.  Where a side meets the parallel of a latitude, and likewise the
#: meridian of a longitude; null if it does not.
MEETS_LAT = """CASE WHEN (s.a.lat > {lat}) <> (s.b.lat > {lat})
    THEN (s.b.lon - s.a.lon) * ({lat} - s.a.lat) / (s.b.lat - s.a.lat) + s.a.lon END"""
MEETS_LON = """CASE WHEN (s.a.lon > {lon}) <> (s.b.lon > {lon})
    THEN (s.b.lat - s.a.lat) * ({lon} - s.a.lon) / (s.b.lon - s.a.lon) + s.a.lat END"""
#: Whether a point of a cell is inside: its corner's answer, turned by each side between.
#: The way goes up the cell's western edge to the point's parallel, then east.
ODD = f"""(size(filter(sides, s -> {MEETS_LON.format(lon="west")} > south AND {MEETS_LON.format(lon="west")} <= {{lat}}))
    + size(filter(sides, s -> {MEETS_LAT.format(lat="{lat}")} > west AND {MEETS_LAT.format(lat="{lat}")} <= {{lon}})) + corner) % 2 = 1"""
ON_SIDE = """exists(sides, s -> (s.b.lon - s.a.lon) * (center_lat - s.a.lat) = (s.b.lat - s.a.lat) * (center_lon - s.a.lon)
    AND center_lon BETWEEN least(s.a.lon, s.b.lon) AND greatest(s.a.lon, s.b.lon)
    AND center_lat BETWEEN least(s.a.lat, s.b.lat) AND greatest(s.a.lat, s.b.lat))"""
SIDES_OF = """flatten(transform(flatten(polygons), ring -> transform(
    slice(ring, 2, size(ring)), (q, i) -> struct(element_at(ring, i + 1) AS a, q AS b))))"""
POINTS_OF = "flatten(flatten(polygons))"
EXTENT = "array_max(transform(points, q -> q.{axis})) - array_min(transform(points, q -> q.{axis}))"
LEVEL = f"""CAST(greatest(0, least({FINEST}, floor(log2(360 * sqrt(greatest(size(points), 1) / {SIDES})
    / greatest({EXTENT.format(axis="lon")}, {EXTENT.format(axis="lat")}, 1e-6))))) AS int)"""
#: Numbers of the cells that a side's box reaches; runs of cells whose corner is inside.
ACROSS = "sequence(CAST(floor((least(s.a.{axis}, s.b.{axis}) + {origin}) / size) AS bigint), CAST(floor((greatest(s.a.{axis}, s.b.{axis}) + {origin}) / size) AS bigint))"
RUNS = """filter(transform(sequence(1, greatest(1, CAST(size(xs) / 2 AS int))), i -> struct(
    CAST(ceil((element_at(xs, 2 * i - 1) + 180) / size) AS bigint) AS first, CAST(ceil((element_at(xs, 2 * i) + 180) / size) AS bigint) - 1 AS last)),
    r -> r.first <= r.last)"""
TOUCHES = """filter(sides, s -> least(s.a.lon, s.b.lon) < p_west + p_size AND greatest(s.a.lon, s.b.lon) >= p_west
    AND least(s.a.lat, s.b.lat) < p_south + p_size AND greatest(s.a.lat, s.b.lat) >= p_south)"""


def levelled(areas: DataFrame) -> DataFrame:
    """``areas`` that have points, with the level at which a cell holds ``SIDES`` of an area's sides on average."""
    pointed = areas.withColumn("points", F.expr(POINTS_OF)).where("size(points) > 0")
    return pointed.withColumn("level", F.expr(LEVEL)).withColumn("size", F.expr("360 / pow(2, level)")).drop("points")


def indexed(areas: DataFrame) -> DataFrame:
    """(area_name, level, x, y, sides, corner): cells that areas touch or cover.

    ``areas`` has area_name and polygons.  An area has cells of the level at which one
    holds ``SIDES`` of its sides on average; cells with more than ``MOST_SIDES`` are
    parted into cells finer by ``FINER`` levels.  ``corner`` is 1 where a cell's south-western corner is
    inside; cells that an area has no part in are left out.
    """
    sided = levelled(areas).selectExpr("area_name", "level", "size", f"explode({SIDES_OF}) AS s")
    up = sided.withColumn("y", F.expr(f"explode({ACROSS.format(axis='lat', origin=90)})"))
    touched = up.withColumn("x", F.expr(f"explode({ACROSS.format(axis='lon', origin=180)})"))
    inside = (
        up.selectExpr("area_name", "level", "size", "y", f"{MEETS_LAT.format(lat='(y * size - 90)')} AS met")
        .where("met IS NOT NULL")
        .groupBy("area_name", "level", "size", "y")
        .agg(F.sort_array(F.collect_list("met")).alias("xs"))
        .selectExpr("area_name", "level", "y", f"inline({RUNS})")
        .selectExpr("area_name", "level", "explode(sequence(first, last)) AS x", "y", "1 AS corner")
    )
    cells = (
        touched.selectExpr("area_name", "level", "x", "y", "s", "0 AS corner")
        .unionByName(inside, allowMissingColumns=True)
        .groupBy("area_name", "level", "x", "y")
        .agg(F.collect_list("s").alias("sides"), F.max("corner").alias("corner"))
    )
    return parted(cells)


def parted(cells: DataFrame) -> DataFrame:
    """Cells of the index, those with many sides as cells that are finer."""
    n = 1 << FINER
    crowded = f"size(sides) > {MOST_SIDES} AND level <= {FINEST - FINER}"
    return (
        cells.withColumn("part", F.expr(f"explode(CASE WHEN {crowded} THEN sequence(0, {n * n - 1}) ELSE array(-1) END)"))
        .selectExpr("*", "360 / pow(2, level) AS size", f"x * {n} + part % {n} AS px", f"y * {n} + CAST(floor(part / {n}) AS bigint) AS py")
        .selectExpr("*", "x * size - 180 AS west", "y * size - 90 AS south", f"size / {n} AS p_size", f"px * size / {n} - 180 AS p_west", f"py * size / {n} - 90 AS p_south")
        .selectExpr(
            "*",
            f"CASE WHEN part < 0 THEN sides ELSE {TOUCHES} END AS held",
            f"CASE WHEN part < 0 THEN corner ELSE CAST({ODD.format(lon='p_west', lat='p_south')} AS int) END AS inner",
        )
        .where("size(held) > 0 OR inner = 1")
        .selectExpr("area_name", f"IF(part < 0, level, level + {FINER}) AS level", "IF(part < 0, x, px) AS x", "IF(part < 0, y, py) AS y", "held AS sides", "inner AS corner")
    )


def located(points: DataFrame, areas: DataFrame, id_col: str = "lake_id") -> DataFrame:
    """(id, area_name): areas that cover points (id, center_lon, center_lat); borders count.

    A point asks one cell of each level in use, and meets the few sides of that cell,
    whatever the area's number of sides.  There are ``FINEST`` + 1 levels at most.
    """
    used = levelled(areas).selectExpr(f"explode(array(level, level + {FINER})) AS level").where(f"level <= {FINEST}").distinct()
    asked = (
        points.where("center_lon IS NOT NULL AND center_lat IS NOT NULL")
        .select(id_col, "center_lon", "center_lat")
        .join(F.broadcast(used))
        .selectExpr("*", "360 / pow(2, level) AS size")
        .selectExpr("*", "CAST(floor((center_lon + 180) / size) AS bigint) AS x", "CAST(floor((center_lat + 90) / size) AS bigint) AS y")
        .selectExpr("*", "x * size - 180 AS west", "y * size - 90 AS south")
    )
    covers = f"{ON_SIDE} OR {ODD.format(lon='center_lon', lat='center_lat')}"
    return asked.join(indexed(areas), ["level", "x", "y"]).where(covers).select(id_col, "area_name")
