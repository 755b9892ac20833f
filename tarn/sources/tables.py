"""Readers and versioned writers of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.constants import STATE_NAMES
from tarn.functions.geo import bounds, centroid, mapped_points
from tarn.functions.text import first_number, without_accents
from tarn.sources.shapefiles import shapefile_rows


def geojson_features(spark: SparkSession, path: str, country: str | None = None) -> DataFrame:
    """Sites of a GeoJSON collection: id, name, country, area, pour point, centre, box, polygons.

    Attributes go by the names that such files use; the first one present wins, and
    a site without a name goes by its id.  Names lose their accents.  The centre is
    the centroid by area of all polygons, holes taken off, or ``lat`` and ``lon``
    where a site has no geometry.  ``ring`` is the outer ring of the first polygon.
    """
    shape_type = "struct<type:string,coordinates:string>"
    schema = f"type string, features array<struct<type:string,properties:string,geometry:{shape_type}>>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f"))
    field = lambda name: F.get_json_object("f.properties", f"$.{name}")
    p = lambda *names: F.coalesce(*(F.nullif(F.trim(field(n)), F.lit("")) for n in names))
    kind, shape = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    rings = "array<array<array<double>>>"
    polygons = F.when(kind == "Polygon", F.array(F.from_json(shape, rings))).when(
        kind == "MultiPolygon", F.from_json(shape, f"array<{rings}>")
    )
    as_points = lambda ring: F.transform(ring, lambda x: F.struct(x[0].alias("lon"), x[1].alias("lat")))
    site = p("Hylak_id", "HYLAK_ID", "hydrolake_id", "lake_id", "id")
    out = rows.select(
        site.cast("long").alias("lake_id"),
        without_accents(F.coalesce(p("Lake_name", "name"), site)).alias("lake_name"),
        p("country", "COUNTRY", "Country").alias("country"),
        first_number(field("Lake_area"), field("area_sqkm"), field("area")).alias("area_sqkm"),
        first_number(field("Pour_lat")).alias("pour_lat"),
        first_number(field("Pour_long")).alias("pour_lon"),
        field("lat").try_cast("double").alias("_lat"),
        field("lon").try_cast("double").alias("_lon"),
        F.transform(polygons, lambda rings: F.transform(rings, as_points)).alias("polygons"),
    )
    every = F.flatten(F.flatten("polygons"))
    box = bounds(every)
    middle = centroid(F.col("polygons"))
    out = out.withColumns(
        {
            "ring": F.get(F.get("polygons", F.lit(0)), F.lit(0)),
            "center_lon": F.coalesce(middle["lon"], "_lon", F.lit(0.0)),
            "center_lat": F.coalesce(middle["lat"], "_lat", F.lit(0.0)),
            **{side: box[side] for side in ("west", "south", "east", "north")},
        }
    ).drop("_lat", "_lon")
    return out if country is None else out.where(F.lower("country") == country.lower())


def state_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """(area_name, polygons) of a GeoJSON file or a shapefile of states, with all rings.

    The name is the first of ``STATE_NAMES`` that is not blank, whatever its case,
    without accents; features without a name or a shape are left out.  An error
    for other kinds of files and for files without any state.
    """
    if path.lower().endswith(".shp"):
        rows = shapefile_rows(spark, path)
        entry = lambda c: F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"))
        names = [c for c in rows.columns if c not in ("record", "polygons", "error")]
        return _named_states(rows.select(F.array(*map(entry, names)).alias("entries"), "polygons"), path)
    if not path.lower().endswith((".json", ".geojson")):
        raise ValueError("boundaries of states come as .shp, .json or .geojson")
    schema = "type string, features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f"))
    shape, rings = F.col("f.geometry.coordinates"), "array<array<array<double>>>"
    polygons = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json(shape, rings))).when(
        F.col("f.geometry.type") == "MultiPolygon", F.from_json(shape, f"array<{rings}>")
    )
    point = lambda q: F.struct(q[0].alias("lon"), q[1].alias("lat"))
    return _named_states(rows.select(F.map_entries("f.properties").alias("entries"), mapped_points(polygons, point).alias("polygons")), path)


def _named_states(rows: DataFrame, path: str) -> DataFrame:
    """Shapes with the name that their attributes, as entries of a map, give."""

    def attribute(name: str) -> Column:
        named = F.filter("entries", lambda e: F.lower(e["key"]) == name)
        return F.nullif(F.trim(F.try_element_at(named, F.lit(-1))["value"]), F.lit(""))

    named = rows.select(without_accents(F.coalesce(*map(attribute, STATE_NAMES))).alias("area_name"), "polygons")
    states = named.where("area_name IS NOT NULL AND size(flatten(polygons)) > 0")
    if states.isEmpty():
        raise ValueError(f"{path} holds no boundary of a state")
    return states


def as_geojson(sites: DataFrame) -> DataFrame:
    """One feature of GeoJSON text per site."""
    ring = F.transform("ring", lambda q: F.array(q["lon"], q["lat"]))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct("lake_id", "lake_name").alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )
    return sites.select("lake_id", F.to_json(feature).alias("feature"))


def recordset(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows of a JSON list in a text column; text that is no list gives none."""
    return rows.select(F.inline(F.from_json(F.col(column), f"array<struct<{schema}>>")))


def band_stack_checked(pixels: DataFrame, bands: tuple[str, ...]) -> DataFrame:
    """``pixels``, or an error if a band is missing or no number."""
    types = dict(pixels.dtypes)
    bad = [b for b in bands if types.get(b) not in ("double", "float", "int", "bigint", "smallint")]
    if bad:
        raise ValueError(f"the pixel table lacks numeric bands: {', '.join(bad)}")
    return pixels


def write_version(df: DataFrame, root: str, version: int, partition_by: str | None = "year") -> str:
    """Write ``df`` beside earlier versions and return the new path.

    A version is never written over; readers move to the new path once it is whole.
    """
    path = f"{root}/v={version:06d}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return path
