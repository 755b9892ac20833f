"""Shapes against brute force: masks, buffers, tiles, the index, distances and shapefiles."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.functions import geo, offsets
from tarn.operators import geometry, spatial
from tarn.operators.texture import block_counts
from tarn.sources.shapefiles import record_count, shapefile_rows, write_shapefile
from tarn.sources.tables import state_boundaries

SCHEMA = "area_name string, polygons array<array<array<struct<lon:double,lat:double>>>>"


def star(x, y, reach, n, left=True):
    turns = [2 * math.pi * i / n for i in range(n)]
    points = [(x + reach * (1 + 0.3 * math.sin(5 * t)) * math.cos(t), y + reach * (1 + 0.3 * math.sin(5 * t)) * math.sin(t)) for t in turns]
    points = points if left else points[::-1]
    return [*points, points[0]]


def inside(point, polygons):
    x, y = point
    sides = [s for own in polygons for ring in own for s in zip(ring, ring[1:])]
    return sum((c - a) * (y - b) / (d - b) + a > x for (a, b), (c, d) in sides if (b > y) != (d > y)) % 2 == 1


SHAPES = {
    "A": [[star(10, 10, 20, 300), star(10, 10, 5, 40, False)]],
    "B": [[star(10, 10, 4, 9)]],
    "C": [[[(-180.0, -90.0), (180.0, -90.0), (180.0, -60.0), (-180.0, -60.0), (-180.0, -90.0)]], [star(100, 20, 0.01, 700)]],
}


@pytest.fixture(scope="module")
def areas(spark):
    return spark.createDataFrame(list(SHAPES.items()), SCHEMA)


def test_points_in_areas_with_holes_and_crowded_cells(spark, areas):
    rng = random.Random(1)
    points = [(i, rng.uniform(-20, 40), rng.uniform(-30, 40)) for i in range(800)]
    points += [(1000 + i, 100 + rng.uniform(-0.02, 0.02), 20 + rng.uniform(-0.02, 0.02)) for i in range(200)]
    df = spark.createDataFrame(points + [(2000, None, 1.0)], "lake_id long, center_lon double, center_lat double")
    got = set(map(tuple, geometry.located(df, areas).collect()))
    assert got == {(i, name) for i, x, y in points for name, own in SHAPES.items() if inside((x, y), own)}
    sizes = geometry.indexed(areas).where("level > 3").agg(F.count("*").alias("n")).first()
    assert sizes.n > 0


def test_borders_count_and_enclaves_are_states_of_their_own(spark):
    box = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    rows = [("Outer", [[box(0.0, 10.0), box(4.0, 6.0)]]), ("Zenclave", [[box(4.0, 6.0)]])]
    sites = spark.createDataFrame([(1, 5.0, 5.0), (2, 2.0, 2.0), (3, 0.0, 3.0), (4, 4.0, 5.0), (5, 11.0, 1.0)], "lake_id long, center_lon double, center_lat double")
    got = {r.lake_id: r.area_name for r in spatial.attributed(sites, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "Zenclave", 2: "Outer", 3: "Outer", 4: "Outer", 5: None}


def test_mask_equals_the_test_of_each_centre(spark, areas):
    grid = (-15.0, 40.0, 1.7, 1.3, 40, 35)
    ids = areas.withColumn("lake_id", F.ascii("area_name").cast("long"))
    grids = ids.select("lake_id", *(F.lit(v).alias(n) for n, v in zip(("west", "north", "pixel_w", "pixel_h", "n_rows", "n_cols"), grid)))
    got = [tuple(r) for r in geometry.rasterised(ids, grids).collect()]
    centre = lambda r, c: (grid[0] + (c + 0.5) * grid[2], grid[1] - (r + 0.5) * grid[3])
    want = {(ord(n), r, c) for n, own in SHAPES.items() for r in range(40) for c in range(35) if inside(centre(r, c), own)}
    assert len(got) == len(set(got)) and set(got) == want


def near(points, polygons, distance):
    a = np.concatenate([np.array(r[:-1]) for own in polygons for r in own])
    b = np.concatenate([np.roll(np.array(r[:-1]), -1, axis=0) for own in polygons for r in own])
    far = offsets.distances(points, a, b)
    return far, np.array([inside(p, polygons) for p in points]) | (far <= distance)


@pytest.mark.parametrize("seed, distance", [(0, 1.0), (1, 2.9), (2, 3.1), (3, 6.0), (4, 0.3)])
def test_buffers_hold_what_is_near(seed, distance):
    rng = np.random.default_rng(seed)
    square = lambda x, y, r: [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r), (x - r, y - r)]
    u = [(0, 0), (10, 0), (10, 10), (7, 10), (7, 3), (3, 3), (3, 10), (0, 10), (0, 0)]
    for polygons in ([[square(5, 5, 5), square(5, 5, 3)[::-1]]], [[u]], [[square(0, 0, 2)], [square(6, 1, 2)]], [[star(3, 3, 4, 120)]]):
        found = offsets.buffer([[np.array(r[:-1], float) for r in own] for own in polygons], distance)
        closed = [[[*map(tuple, r), tuple(r[0])] for r in own] for own in found]
        fewer = [[[*map(tuple, r), tuple(r[0])] for r in offsets.simplified(own, distance * 0.02)] for own in found]
        points = rng.uniform(-distance - 3, 13 + distance, (400, 2))
        far, want = near(points, polygons, distance)
        for shape, slack in ((closed, 0.015), (fewer, 0.04)):
            wrong = np.array([inside(p, shape) for p in points]) != want
            assert not (wrong & (np.abs(far - distance) > slack * distance)).any()


def test_buffer_of_shapes_in_metres(spark, areas):
    shapes = geometry.in_metres(areas.where("area_name = 'B'").unionByName(spark.createDataFrame([("none", None)], SCHEMA)))
    got = {r.area_name: r for r in geometry.buffered(shapes).select("area_name", geo.area(F.col("polygons")).alias("m2")).collect()}
    before = shapes.where("area_name = 'B'").select(geo.area(F.col("polygons"))).first()[0]
    assert got["none"].m2 is None and got["B"].m2 > before + 3500 * 2e6


def test_simplified_rings_stay_valid_and_near():
    ring = np.array(star(0, 0, 100, 2000)[:-1]) + np.random.default_rng(1).normal(0, 0.01, (2000, 2))
    (fewer,) = offsets.simplified([ring], 0.5)
    assert len(fewer) < 200 and offsets.simple([fewer])
    assert offsets.distances(ring, fewer, np.roll(fewer, -1, axis=0)).max() <= 0.5 + 1e-9


def test_pieces_of_tiles_sum_to_the_shape(spark, areas):
    shapes = geometry.in_metres(areas.where("area_name <> 'C'").withColumn("lake_id", F.ascii("area_name").cast("long")))
    tiles = geometry.tiles_of(shapes, 600_000.0)
    whole = {r[0]: r[1] for r in shapes.select("lake_id", geo.area(F.col("polygons"))).collect()}
    parts = {r[0]: r[1] for r in tiles.groupBy("lake_id").agg(F.sum("area_m2")).collect()}
    assert parts.keys() == whole.keys() and all(parts[k] == pytest.approx(whole[k], rel=1e-9) for k in whole)
    back = tiles.select("min_x", "min_y", geo.mercator_6933(F.col("south"), F.col("west")).alias("m")).collect()
    assert all(abs(r.m.x - r.min_x) < 1e-5 and abs(r.m.y - r.min_y) < 1e-5 for r in back)


@pytest.mark.parametrize("reach", [1, 2, 17])
def test_distances_to_the_lake(spark, reach):
    rng = random.Random(reach)
    rows = [(k, 2020, r, c, rng.random() < 0.05 if k < 3 else False) for k in (1, 2, 3) for r in range(30) for c in range(25) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "lake_id long, year int, r int, c int, in_lake boolean").repartition(3)
    got = {tuple(r)[:4]: r.square for r in spatial.lake_distances(df, reach).collect()}
    for k, year, r, c, _ in rows:
        least = min(((r - a) ** 2 + (c - b) ** 2 for j, _, a, b, lake in rows if lake and j == k), default=None)
        assert got[k, year, r, c] == (least if least is not None and least <= reach**2 else None)


def test_wkt(spark):
    texts = [
        ("POLYGON ((30 10, 40 40, 20 40, 30 10), (31 12, 32 14, 30 14, 31 12))", [2]),
        ("srid=4326; multipolygon z (((1 2 3, 4.5e1 -5 6, 7 8 9, 1 2 3)), ((0 0 0, 1 0 0, 0 1 0, 0 0 0)))", [1, 1]),
        ("POLYGON EMPTY", []), ("MULTIPOLYGON EMPTY", []), ("POINT (1 2)", None), ("x", None), ("", None), (None, None),
    ]
    df = spark.createDataFrame([(t,) for t, _ in texts], "w string")
    got = df.select("w", geo.polygons_of_wkt(F.col("w")).alias("p")).collect()
    assert [None if r.p is None else [len(own) for own in r.p] for r in got] == [want for _, want in texts]
    assert got[1].p[0][0][1] == (45.0, -5.0)


def test_shapefiles_read_back_what_was_written(spark, areas, tmp_path):
    more = spark.createDataFrame([("D", None)], SCHEMA)
    rows = areas.unionByName(more).select(
        F.col("area_name").alias("name"), F.ascii("area_name").cast("long").alias("n"), (F.ascii("area_name") / 7).alias("x"),
        F.when(F.col("area_name") != "D", "Île d’or").otherwise("INDIA").alias("country"), F.col("area_name").isin("A", "B").alias("big"), "polygons",
    )
    path = str(tmp_path / "lakes")
    write_shapefile(rows.repartition(3), path)
    back = shapefile_rows(spark, path, records=1)
    assert record_count(path) == 4 and back.rdd.getNumPartitions() == 4
    key = ["name", "n", "x", "country", "big"]
    assert sorted(map(tuple, back.select(*key).collect())) == sorted(map(tuple, rows.select(*key).collect()))
    measured = lambda df: {r[0]: (r[1], r[2]) for r in df.select("name", F.round(geo.area(F.col("polygons")), 9), F.size(F.flatten("polygons"))).collect()}
    assert measured(back) == measured(rows)
    assert shapefile_rows(spark, path, country="india").select("name").collect() == [("D",)]
    assert shapefile_rows(spark, path).where("name = 'A'").count() == 1
    with pytest.raises(FileNotFoundError):
        shapefile_rows(spark, str(tmp_path / "nothing.shp"))


def test_damaged_records_are_rows_with_an_error(spark, areas, tmp_path):
    path = tmp_path / "lakes"
    write_shapefile(areas.select(F.col("area_name").alias("name"), F.lit(5).cast("long").alias("Hylak_id"), "polygons").coalesce(1).orderBy("name"), str(path))
    (shp,) = path.glob("*.shp")
    data = bytearray(shp.read_bytes())
    data[108:112] = struct.pack("<i", 3)
    shp.write_bytes(data)
    rows = shapefile_rows(spark, str(shp))
    assert [r.name for r in rows.where("error IS NOT NULL").collect()] == ["A"]
    assert spatial.lakes_of(rows).where("skipped").count() == 1
    old = spark.createDataFrame([(5, "known")], "lake_id long, lake_name string")
    lakes, counts = spatial.imported_lakes(rows, areas, old, 3)
    assert tuple(counts.first()) == (3, 0, 2, 1) and lakes.count() == 1
    states = state_boundaries(spark, str(shp)).select("area_name").collect()
    assert sorted(r.area_name for r in states) == ["B", "C"]


def test_pairs_of_levels_across_blocks(monkeypatch):
    from tarn.operators import texture

    monkeypatch.setattr(texture, "BLOCK", 4)
    rng = np.random.default_rng(2)
    level = {(r, c): int(rng.integers(0, 5)) for r in range(-3, 11) for c in range(9) if rng.random() < 0.8}
    rows = []
    for (r, c), v in level.items():
        for br in {(r + d) // 4 for d in (-1, 0, 1)}:
            rows += [(1, 2, br, bc, r, c, v) for bc in {(c + d) // 4 for d in (-1, 0, 1)}]
    found = {}
    for part in block_counts(np.array(sorted(rows)), texture.TEXTURE_OFFSETS):
        for _, _, k, i, j, n in part.tolist():
            found[k, i, j] = found.get((k, i, j), 0) + n
    want = {}
    for (r, c), v in level.items():
        for k, (dy, dx) in enumerate(texture.TEXTURE_OFFSETS):
            if (r + dy, c + dx) in level:
                key = (k, v, level[r + dy, c + dx])
                want[key] = want.get(key, 0) + 1
    assert found == want


def test_rows_of_unknown_lakes_are_an_error(spark):
    from tarn.operators.merges import with_centres

    lakes = spark.createDataFrame([(1, 2.0, None, 3.0, 4.0)], "lake_id long, center_lat double, center_lon double, pour_lat double, pour_lon double")
    rows = spark.createDataFrame([(1,), (9,)], "lake_id long")
    assert tuple(with_centres(rows.where("lake_id = 1"), lakes).first()) == (1, 2.0, 4.0)
    with pytest.raises(Exception, match="lake 9 is not known"):
        with_centres(rows, lakes).collect()


def test_shapes_of_one_file_are_dealt_to_many_tasks(spark, areas):
    shapes = geometry.in_metres(areas.where("area_name = 'B'").withColumn("lake_id", F.lit(1))).crossJoin(spark.range(64)).coalesce(1)
    for found in (geometry.buffered(shapes), geometry.tiles_of(shapes)):
        used = found.select(F.spark_partition_id().alias("p")).distinct().count()
        assert used >= spark.sparkContext.defaultParallelism
