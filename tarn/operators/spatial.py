"""Sites in areas, tile grids and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.constants import BUFFER_M, LATITUDES, LONGITUDES, TILE_M
from tarn.functions.checks import within
from tarn.functions.geo import bounds, centroid, covers, haversine, haversine_km, mercator_6933
from tarn.functions.text import display_name, without_accents
from tarn.operators.geometry import located
from tarn.operators.merges import merged

#: Degrees of the cells by which sites and areas that are single rings first meet.
CELL = 10.0


def cell(value, size: float = CELL):
    return F.floor(value / size).cast("int")


def attributed(sites: DataFrame, areas: DataFrame, id_col: str = "lake_id") -> DataFrame:
    """``sites`` with ``area_name``, the least name of the areas that cover them.

    Sites have center_lon and center_lat; areas have area_name and either polygons,
    with any number of sides and holes that they do not cover, or a short ring.  Sites
    in no area stay, with null.
    """
    hits = located(sites, areas, id_col) if "polygons" in areas.columns else in_rings(sites, areas, id_col)
    return sites.join(hits.groupBy(id_col).agg(F.min("area_name").alias("area_name")), id_col, "left")


def in_rings(sites: DataFrame, areas: DataFrame, id_col: str) -> DataFrame:
    """(id, area_name): sites and rings meet by the cells that the rings' boxes touch.

    Then the box and the exact test, of each side of the ring, decide.
    """
    boxed = areas.withColumn("box", bounds(F.col("ring")))
    across = F.explode(F.sequence(cell(F.col("box.west")), cell(F.col("box.east"))))
    along = F.explode(F.sequence(cell(F.col("box.south")), cell(F.col("box.north"))))
    placed = boxed.withColumn("cell_x", across).withColumn("cell_y", along)
    lon, lat = F.col("center_lon"), F.col("center_lat")
    inside = lon.between(F.col("box.west"), F.col("box.east")) & lat.between(F.col("box.south"), F.col("box.north"))
    return (
        sites.select(id_col, "center_lon", "center_lat", cell(lon).alias("cell_x"), cell(lat).alias("cell_y"))
        .join(placed, ["cell_x", "cell_y"])
        .where(inside)
        .where(covers(F.col("ring"), lon, lat))
        .select(id_col, "area_name")
    )


def imported(new: DataFrame, areas: DataFrame) -> DataFrame:
    """Sites to import, with state and name as shown."""
    placed = attributed(new, areas).withColumnRenamed("area_name", "new_state")
    return placed.withColumn("display_name", display_name(F.col("lake_name"), F.col("lake_id"), F.col("new_state")))


def nearest(sites: DataFrame, lat: float, lon: float) -> DataFrame:
    """The site nearest in degrees, with its distance in kilometres."""
    within("lat", lat, LATITUDES)
    within("lon", lon, LONGITUDES)
    y, x = F.col("center_lat") - lat, F.col("center_lon") - lon
    km = haversine_km(F.lit(lat), F.lit(lon), F.col("center_lat"), F.col("center_lon"))
    return (
        sites.withColumn("far", x * x + y * y)
        .orderBy("far", "lake_id")
        .limit(1)
        .withColumn("distance_km", F.round(km, 3))
        .drop("far")
    )


def tile_grid(sites: DataFrame, tile_m: float = TILE_M, buffer_m: float = BUFFER_M) -> DataFrame:
    """Tiles over each site's buffered box on the equal-area grid.

    ``sites`` has lake_id and a box west, south, east, north.  Tiles are trimmed
    to the box, so they cover it and no more.
    """
    low = mercator_6933(F.col("south"), F.col("west"))
    high = mercator_6933(F.col("north"), F.col("east"))
    steps = lambda a, b: F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil((b - a) / tile_m) - 1, F.lit(0).cast("long")))
    edges = {
        "x0": low["x"] - buffer_m,
        "y0": low["y"] - buffer_m,
        "x1": high["x"] + buffer_m,
        "y1": high["y"] + buffer_m,
    }
    return (
        sites.select("lake_id", *(e.alias(n) for n, e in edges.items()))
        .withColumn("col", F.explode(steps(F.col("x0"), F.col("x1"))))
        .withColumn("row", F.explode(steps(F.col("y0"), F.col("y1"))))
        .select(
            "lake_id",
            F.concat_ws("_", "col", "row").alias("tile_index"),
            (F.col("x0") + F.col("col") * tile_m).alias("min_x"),
            (F.col("y0") + F.col("row") * tile_m).alias("min_y"),
            F.least(F.col("x1"), F.col("x0") + (F.col("col") + 1) * tile_m).alias("max_x"),
            F.least(F.col("y1"), F.col("y0") + (F.col("row") + 1) * tile_m).alias("max_y"),
        )
    )


def covered_tiles(tiles: DataFrame, rings: DataFrame) -> DataFrame:
    """Tiles that a site's polygon, in the same metres, reaches into or touches.

    Either a side of the polygon runs through the tile, which clipping the side at
    the tile's edges tells, or the tile lies inside the polygon as a whole.
    """
    ring, low, high = F.col("ring"), {"lon": "min_x", "lat": "min_y"}, {"lon": "max_x", "lat": "max_y"}

    def through(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i + 1)
        enters, leaves, level = [F.lit(0.0)], [F.lit(1.0)], F.lit(True)
        for axis in ("lon", "lat"):
            step = b[axis] - a[axis]
            moves = F.when(step != 0, step)
            one, two = (F.col(low[axis]) - a[axis]) / moves, (F.col(high[axis]) - a[axis]) / moves
            enters.append(F.coalesce(F.least(one, two), F.lit(0.0)))
            leaves.append(F.coalesce(F.greatest(one, two), F.lit(1.0)))
            level = level & ((step != 0) | a[axis].between(F.col(low[axis]), F.col(high[axis])))
        return level & (F.greatest(*enters) <= F.least(*leaves))

    sides = F.sequence(F.lit(1), F.size(ring) - 1)
    reached = F.exists(sides, through) | covers(ring, F.col("min_x"), F.col("min_y"))
    return tiles.join(rings, "lake_id").where(reached).drop("ring")


def shore_pixels(pixels: DataFrame, ring_px: int) -> DataFrame:
    """``pixels`` with in_shore: outside the lake, but within ``ring_px`` of it."""
    near = F.col("_square").isNotNull() & ~F.coalesce("in_lake", F.lit(False))
    return lake_distances(pixels, ring_px, "_square").withColumn("in_shore", near).drop("_square")


def lake_distances(pixels: DataFrame, most: int, name: str = "square") -> DataFrame:
    """``pixels`` with the square of the exact distance to the lake; null beyond ``most``.

    Rows first: a lake pixel gives its distance to the places of its row that are
    nearer to it than to the next lake pixel, so each place gets one.  Then columns: a
    pixel sums the squares of its way up or down and of what the places there were
    given.  The work of a pixel grows with ``most``, not with its square, and places
    need no pixel of their own.
    """
    row = Window.partitionBy("lake_id", "year", "r").orderBy("c")
    before, after = F.col("c") - F.lag("c").over(row), F.lead("c").over(row) - F.col("c")
    left = F.least(F.lit(most), F.coalesce(F.floor(before / 2), F.lit(most)))
    right = F.least(F.lit(most), F.coalesce(F.ceil(after / 2) - 1, F.lit(most)))
    given = (
        pixels.where("in_lake")
        .select("lake_id", "year", "r", "c")
        .distinct()
        .withColumns({"_left": left, "_right": right})
        .select("lake_id", "year", "r", "c", F.explode(F.sequence(-F.col("_left"), F.col("_right"))).alias("_way"))
        .select("lake_id", "year", "r", (F.col("c") + F.col("_way")).cast(pixels.schema["c"].dataType).alias("c"), F.struct("r", "_way").alias("_given"))
    )
    column = Window.partitionBy("lake_id", "year", "c").orderBy("r").rangeBetween(-most, most)
    squares = F.transform("_near", lambda g: F.pow(g["r"] - F.col("r"), F.lit(2)) + F.pow(g["_way"], F.lit(2)))
    least = F.array_min(squares).cast("long")
    return (
        pixels.withColumn("_pixel", F.lit(True))
        .unionByName(given, allowMissingColumns=True)
        .withColumn("_near", F.collect_list("_given").over(column))
        .where("_pixel")
        .withColumn("_least", least)
        .withColumn(name, F.when(F.col("_least") <= most * most, F.col("_least")))
        .select(*pixels.columns, name)
    )


def storage_estimate(sites: DataFrame, buffer_m: float = BUFFER_M) -> DataFrame:
    """One row: bytes that images of the sites' buffered boxes take."""
    middle = F.cos(F.radians((F.col("south") + F.col("north")) / 2))
    wide = (F.col("east") - F.col("west")) * 111320.0 * middle + 2 * buffer_m
    high = (F.col("north") - F.col("south")) * 110574.0 + 2 * buffer_m
    return sites.agg(
        F.coalesce(F.sum(wide * high), F.lit(0.0)).alias("area_m2"),
        F.coalesce(F.sum(wide * high / 900 * 24), F.lit(0.0)).alias("bytes"),
        F.count(F.lit(1)).alias("lakes"),
    )


def ranked_by_distance(sites: DataFrame, lat: float, lon: float) -> DataFrame:
    """``sites`` with distance_km and their place in their country.

    Places go by the haversine, as kilometres of different ones may be one double.
    """
    way = (F.lit(lat), F.lit(lon), F.col("center_lat"), F.col("center_lon"))
    place = F.row_number().over(Window.partitionBy("country").orderBy("_h", "lake_id"))
    return sites.withColumns({"distance_km": haversine_km(*way), "_h": haversine(*way)}).withColumn("place", place).drop("_h")


#: Attributes of a lake in a shapefile, in lower case; the first that has a value counts.
LAKE_FIELDS = {
    "lake_id": ("hylak_id", "lake_id", "id"),
    "lake_name": ("lake_name", "name"),
    "country": ("country",),
    "area_sqkm": ("lake_area", "area_sqkm", "area"),
    "elevation": ("elevation",),
    "pour_lat": ("pour_lat", "lat"),
    "pour_lon": ("pour_long", "lon"),
    "lake_type": ("lake_type", "type"),
    "depth_avg": ("depth_avg",),
    "vol_total": ("vol_total",),
    "wshd_area": ("wshd_area",),
}


def lakes_of(records: DataFrame) -> DataFrame:
    """Lakes of a shapefile's records, with ``skipped`` for rows that give none.

    Skipped are rows that could not be read, and those whose id is missing or no
    number; zeros and blanks let the next attribute speak.  Areas default to 0.  The
    centre is the centroid by area, null without a shape.
    """
    held = {c.lower(): c for c in reversed(records.columns)}

    def text(name: str) -> Column:
        values = [F.trim(F.col(held[f]).cast("string")) for f in LAKE_FIELDS[name] if f in held]
        spoken = [F.when((v != "") & ~v.rlike(r"^[-+]?0*\.?0*$"), v) for v in values]
        return F.coalesce(*spoken) if spoken else F.lit(None).cast("string")

    number = lambda name: text(name).try_cast("double")
    given = lambda name: F.when(
        F.coalesce(*(F.when(F.trim(F.col(held[f]).cast("string")) != "", True) for f in LAKE_FIELDS[name] if f in held), F.lit(False)),
        F.coalesce(number(name), F.lit(0.0)),
    )
    middle = centroid(F.col("polygons"))
    bad = (F.col("error").isNotNull() | number("lake_id").isNull()) if "error" in records.columns else number("lake_id").isNull()
    return records.select(
        number("lake_id").cast("long").alias("lake_id"),
        without_accents(text("lake_name")).alias("lake_name"),
        text("country").alias("country"),
        F.coalesce(number("area_sqkm"), F.lit(0.0)).alias("area_sqkm"),
        *(given(name).alias(name) for name in ("elevation", "pour_lat", "pour_lon", "depth_avg", "vol_total", "wshd_area")),
        text("lake_type").alias("lake_type"),
        "polygons",
        F.when(F.size("polygons") > 0, middle["lon"]).alias("center_lon"),
        F.when(F.size("polygons") > 0, middle["lat"]).alias("center_lat"),
        bad.alias("skipped"),
    )


def imported_lakes(records: DataFrame, states: DataFrame, old: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """(lakes after an import, one row of its counts).

    ``records`` are those of the country asked for, ``total`` counts all.  New lakes get
    a state and a shown name; lakes known before are updated, others are inserted.  Of
    records that repeat an id the last counts, and each counts as a record stored.
    """
    numbered = lakes_of(records).withColumn("record", F.monotonically_increasing_id())
    lakes = numbered.where("NOT skipped").drop("skipped")
    last = lakes.groupBy("lake_id").agg(F.max_by(F.struct(*[c for c in lakes.columns if c not in ("lake_id", "record")]), "record").alias("row"))
    placed = attributed(last.select("lake_id", "row.*"), states).withColumnRenamed("area_name", "state")
    shown = placed.withColumn("display_name", display_name(F.col("lake_name"), F.col("lake_id"), F.col("state")))
    known = old.select("lake_id", F.lit(True).alias("known")).distinct()
    counts = numbered.join(known, "lake_id", "left").agg(
        F.lit(total).cast("long").alias("total_records"),
        F.count_if(~F.col("skipped") & F.col("known").isNull()).alias("inserted_records"),
        F.count_if(~F.col("skipped") & F.col("known")).alias("updated_records"),
        F.count_if("skipped").alias("skipped_records"),
    )
    return merged(old, shown, ["lake_id"]), counts
