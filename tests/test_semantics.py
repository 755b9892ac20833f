"""Rules of the domain on small inputs, most of them odd ones."""

import json
import math
import sys
from pathlib import Path

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.constants import BANDS
from tarn.functions import checks, geo, text
from tarn.functions.spectral import INDICES
from tarn.functions.vectors import PAIR, blend, checked, parsed, unit
from tarn.operators import forecasts as fc
from tarn.operators import pixels as px
from tarn.operators.audits import output_patterns
from tarn.operators.medians import exact_median
from tarn.operators.merges import merged
from tarn.operators.pooling import encoded, pooled
from tarn.operators.spatial import attributed, nearest
from tarn.operators.texture import texture
from tarn.operators.trajectories import all_analogs, analogs, nearest_to_each, nearest_vectors, query_trajectory
from tarn.sources.tables import as_geojson, band_stack_checked, geojson_features, state_boundaries, write_version
from tarn.streaming.ingest import merge_stream, windowed_counts

RECORDS = "lake_id long, year int, embedding array<float>"


def one(df):
    return df.first()[0]


def history(site, years, vector):
    return [(site, y, vector(y)) for y in years]


def test_trajectory_ends_at_its_anchor(spark):
    df = spark.createDataFrame(history(1, range(2016, 2026), lambda y: [float(y)]), RECORDS)
    row = query_trajectory(df, 1, 2023).first()
    assert [v[0] for v in row.trajectory] == [2019.0, 2020.0, 2021.0, 2022.0, 2023.0] and row.n == 5
    assert query_trajectory(df, 1, 2018).first().n == 3
    assert query_trajectory(df, 1, 2030).count() == 0


def test_windows_are_over_records_not_years(spark):
    rows = history(1, range(2016, 2021), lambda y: [1.0, 0.0]) + history(2, (1990, 1995, 2000, 2001, 2020), lambda y: [1.0, 0.0])
    rows += history(3, range(2016, 2020), lambda y: [1.0, 0.0])
    found = analogs(spark.createDataFrame(rows, RECORDS), 1, 2020).collect()
    assert [(r.lake_id, r.start_year, r.end_year, r.raw_score) for r in found] == [(2, 1990, 2020, 1.0)]


def test_ties_go_to_the_first_window_and_the_first_site(spark):
    rows = [r for site in (1, 4, 2) for r in history(site, range(2010, 2020), lambda y: [1.0, 0.0])]
    found = analogs(spark.createDataFrame(rows, RECORDS), 1, 2019).collect()
    assert [(r.lake_id, r.start_year) for r in found] == [(2, 2010), (4, 2010)]


def test_a_zero_vector_is_like_any(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert one(df.select(PAIR["cosine"](F.col("a"), F.col("b")))) == 1.0


def test_short_query_scores_nothing(spark):
    rows = history(1, range(2016, 2019), lambda y: [1.0]) + history(2, range(2010, 2020), lambda y: [1.0])
    found = analogs(spark.createDataFrame(rows, RECORDS), 1, 2018).first()
    assert (found.start_year, found.end_year, found.raw_score, found.similarity_score) == (2010, 2014, 0.0, 0.0)


@pytest.mark.parametrize("method", list(PAIR))
def test_search_of_all_is_each_search(spark, method):
    r = np.random.default_rng(1)
    rows = [(s, 2010 + y, r.normal(size=4).tolist()) for s in range(6) for y in range(8)]
    df = spark.createDataFrame(rows, RECORDS)
    every = {(x.query_id, x.lake_id): (x.start_year, round(x.raw_score, 9)) for x in all_analogs(df, 2017, method, 50).collect()}
    for site in (0, 3):
        for x in analogs(df, site, 2017, method, 50).collect():
            assert every[site, x.lake_id] == (x.start_year, round(x.raw_score, 9))
    again = analogs(df.repartition(7), 2, 2017, method).collect()
    assert again == analogs(df.coalesce(1), 2, 2017, method).collect()


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-5, 5, width=32), min_size=3, max_size=3), st.lists(st.floats(-5, 5, width=32), min_size=3, max_size=3))
def test_pair_scores(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    row = df.select(*(f(F.col("a"), F.col("b")).alias(n) for n, f in PAIR.items()), PAIR["cosine"](F.col("a"), F.col("a")).alias("own")).first()
    x, y = np.array(a, "f4").astype(float), np.array(b, "f4").astype(float)
    size = np.linalg.norm(x) * np.linalg.norm(y)
    assert math.isclose(row.cosine, x @ y / size if size else 1.0, abs_tol=1e-9)
    assert math.isclose(row.euclidean, 1 / (1 + np.linalg.norm(x - y)), abs_tol=1e-9)
    assert math.isclose(row.knn, (x @ y + 1) / 2, abs_tol=1e-9) and math.isclose(row.own, 1.0, abs_tol=1e-9)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], "[1, 2.5]", "no list")], "a array<float>, z array<float>, t string, u string")
    row = df.select(
        unit(F.col("a")), unit(F.col("z")), blend(F.col("a"), F.lit(None).cast("array<float>"), F.lit(0.7)), parsed(F.col("t")), parsed(F.col("u"))
    ).first()
    assert row[0] == row[2] == pytest.approx([0.6, 0.8]) and row[1] is None and row[3] == [1.0, 2.5] and row[4] is None
    with pytest.raises(Exception, match="finite numbers"):
        df.select(checked(F.col("a"), 3)).collect()


# forecasts


def features(rows):
    keys = ["lake_id", "year", "b2_mean", "b3_mean", "b4_mean", "b5_mean", "b6_mean", "b7_mean", "b8_mean"]
    schema = "lake_id long, year int, " + ", ".join(f"{k} double" for k in keys[2:]) + ", status string, feature_version int"
    return [(s, y, 600.0, 700.0, 500.0, b5, 350.0, b7, 250.0, "completed", 2) for s, y, b5, b7 in rows], schema


def test_ecological_indices(spark):
    rows, schema = features([(1, 2020, 500.0, 300.0)])
    row = fc.ecological_indices(spark.createDataFrame(rows, schema)).first()
    assert row.red_edge_slope == pytest.approx(-0.02 / 78 * 100) and row.ndci == 0.0
    assert row.turbidity == pytest.approx(-200 / 1200)
    none = fc.ecological_indices(spark.createDataFrame(rows, schema).withColumn("b8_mean", F.lit(None).cast("double"))).first()
    assert none.ndvi is None and none.ndwi is None and none.ndci == 0.0
    zero = fc.ecological_indices(spark.createDataFrame(rows, schema).withColumns({"b4_mean": F.lit(0.0), "b5_mean": F.lit(0.0)})).first()
    assert zero.ndci == 0.0
    nan = fc.ecological_indices(spark.createDataFrame(rows, schema).withColumn("b5_mean", F.lit(float("nan")))).first()
    assert nan.ndci is None and nan.turbidity is not None


def test_noise_thresholds(spark):
    rows, schema = features([(s, 2015 + y, 500.0, 300.0 + 15.6 * y) for s in range(40) for y in range(6)])
    found = {(r.index_name, r.h): r.threshold for r in fc.noise_thresholds(spark.createDataFrame(rows, schema)).collect()}
    for h in (1, 2, 3):
        assert found["red_edge_slope", h] == pytest.approx(0.5 * 0.002 * h)
        assert found["ndci", h] == 0.005  # no change at all
    few, schema = features([(1, 2015, 500.0, 300.0), (1, 2016, 510.0, 310.0)])
    found = {(r.index_name, r.h): r.threshold for r in fc.noise_thresholds(spark.createDataFrame(few, schema)).collect()}
    assert found["ndvi", 1] == 0.005 and found["red_edge_slope", 2] == 0.001


def test_directions(spark):
    rows = [(0.02, 2, "up"), (-0.02, 2, "down"), (0.005, 5, "stable"), (0.9, 1, "uncertain")]
    df = spark.createDataFrame(rows, "score double, twins int, want string")
    assert df.where(fc.direction(F.col("score"), F.col("twins"), F.lit(0.01)) != F.col("want")).count() == 0


ANALOGS = "lake_id long, start_year int, end_year int, raw_score double, similarity_score double"


def test_forecast_from_an_earlier_anchor(spark):
    rows, schema = features([(1, 2022, 500.0, 300.0)] + [(s, 2019 + y, 500.0 + 50 * y, 300.0) for s in (2, 3) for y in range(4)])
    found = spark.createDataFrame([(2, 2015, 2019, 0.9, 0.8), (3, 2015, 2019, 0.9, 0.7), (9, 2015, 2019, 0.9, 0.6)], ANALOGS)
    out = fc.ecological_forecast(found, spark.createDataFrame(rows, schema), 1, 2023).where("index_name = 'ndci'").orderBy("h").collect()
    assert [r.forecast_year for r in out] == [2023, 2024, 2025]
    assert [r.direction for r in out] == ["up"] * 3 and [r.twins_contributing for r in out] == [2] * 3


def test_twins_past_the_fifth_count_but_weigh_nothing(spark):
    rows, schema = features([(s, 2019 + y, 500.0 + 10 * s * y, 300.0) for s in range(1, 9) for y in range(3)])
    found = spark.createDataFrame([(s, 2015, 2019, 0.9, 1 - s / 100) for s in range(2, 9)], ANALOGS)
    deltas = fc.twin_deltas(found, spark.createDataFrame(rows, schema), 1, num_analogs=7)
    weights = {r["rank"]: r.fixed_weight for r in deltas.collect()}
    assert weights[6] == weights[7] == 0.0 and weights[1] == 0.28
    sums = fc.contributions(deltas).groupBy("index_name", "h").agg(F.sum("normalized_weight").alias("w"))
    assert all(r.w == pytest.approx(1.0) for r in sums.collect())
    assert fc.twin_deltas(found.limit(0), spark.createDataFrame(rows, schema), 1).count() == 0


def test_analog_weights_fall_back_to_equal_ones(spark):
    found = spark.createDataFrame([(2, 1, 5, 0.4, 0.0), (3, 1, 5, 0.4, 0.0)], ANALOGS)
    assert [r.weight for r in fc.analog_weights(found, "cosine").collect()] == [0.5, 0.5]
    scored = spark.createDataFrame([(2, 1, 5, 0.4, 0.6), (3, 1, 5, 0.4, 0.2)], ANALOGS)
    for method in ("cosine", "euclidean"):
        assert [round(r.weight, 9) for r in fc.analog_weights(scored, method).orderBy("lake_id").collect()] == [0.75, 0.25]


def test_forecast_takes_following_records(spark):
    rows = history(1, range(2000, 2005), lambda y: [0.0]) + history(2, (2001, 2004, 2009, 2010), lambda y: [float(y)])
    found = spark.createDataFrame([(2, 1999, 2001, 0.9, 0.9)], ANALOGS)
    out = fc.embedding_forecast(found, spark.createDataFrame(rows, RECORDS), 1, 2004).orderBy("forecast_year").collect()
    assert [(r.forecast_year, r.value) for r in out] == [(2005, 2004.0), (2006, 2009.0), (2007, 2010.0)]
    assert fc.embedding_forecast(found, spark.createDataFrame(rows[:-1], RECORDS), 1, 2004).count() == 0


# pixels


def grid(spark, cells, valid=True):
    schema = "lake_id long, year int, r int, c int, " + ", ".join(f"{b} double" for b in BANDS) + ", clear_count double"
    return spark.createDataFrame([(1, 2020, r, c, *([float(v)] * len(BANDS) if v is not None else [None] * len(BANDS)), 3.0) for r, c, v in cells], schema)


def glcm_brute(image, levels=64):
    """Properties of an image (nan: missing), by loops."""
    known = image[~np.isnan(image)]
    lo, hi = known.min(), known.max()
    q = np.full(image.shape, -1)
    q[~np.isnan(image)] = ((known - lo) / (hi - lo) * (levels - 1)).astype(int) if hi > lo else 0
    out = []
    for dy, dx in ((0, 1), (-1, 1), (-1, 0), (-1, -1)):
        m = np.zeros((levels, levels))
        for y in range(q.shape[0]):
            for x in range(q.shape[1]):
                if 0 <= y + dy < q.shape[0] and 0 <= x + dx < q.shape[1] and q[y, x] >= 0 and q[y + dy, x + dx] >= 0:
                    m[q[y, x], q[y + dy, x + dx]] += 1
        if not m.sum():
            continue
        p = (m + m.T) / (m + m.T).sum()
        i, j = np.indices(p.shape)
        mu = (i * p).sum()
        var = ((i - mu) ** 2 * p).sum()
        nz = p[p > 0]
        out.append([
            ((i - j) ** 2 * p).sum(), (abs(i - j) * p).sum(), (p / (1 + (i - j) ** 2)).sum(), (p**2).sum(), -(nz * np.log2(nz)).sum(),
            ((i - mu) * (j - mu) * p).sum() / var if var > 1e-12 else 0.0,
        ])
    return np.mean(out, axis=0)


@pytest.mark.parametrize("seed", [0, 1])
def test_texture(spark, seed):
    r = np.random.default_rng(seed)
    image = r.integers(0, 900, (7, 6)).astype(float)
    image[r.random(image.shape) < 0.2] = np.nan
    cells = [(y, x, None if np.isnan(v) else v) for (y, x), v in np.ndenumerate(image)]
    row = texture(grid(spark, cells)).first()
    assert list(row)[2:] == pytest.approx(glcm_brute(image), abs=2e-6)


def test_texture_of_little(spark):
    flat = texture(grid(spark, [(y, x, 5.0) for y in range(3) for x in range(3)])).first()
    assert flat.glcm_contrast == 0.0 and flat.glcm_energy == 1.0 and flat.glcm_correlation == 0.0
    assert texture(grid(spark, [(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0)])).count() == 0
    assert texture(grid(spark, [(0, 0, 1.0), (0, 5, 2.0), (5, 2, 3.0), (9, 9, 1.0)])).count() == 0


def test_pixels_without_a_value(spark):
    none = grid(spark, [(0, 0, None), (0, 1, None)])
    row = px.pixel_statistics(none).first()
    assert (row.pixel_count, row.valid_count, row.coverage_pct, row.cloud_pct) == (2, 0, 0.0, 100.0)
    assert px.band_statistics(none).first().b1_mean is None
    assert px.index_statistics(none).count() == px.spectral_summary(none).count() == 0
    assert px.water_statistics(none).select("water_count", "land_km2").collect() == [(0, 0.0)]


def test_the_wide_row_holds_what_its_parts_do(spark):
    r = np.random.default_rng(4)
    values = lambda: [float(v) if v > 150 else None for v in r.integers(0, 4000, len(BANDS))]
    schema = grid(spark, [(0, 0, 1.0)]).schema
    rows = [(site, 2020, 0, i, *values(), float(i % 5)) for site in (1, 2) for i in range(80)]
    rows += [(3, 2020, 0, i, *[None] * len(BANDS), 1.0) for i in range(3)]
    pixels = spark.createDataFrame(rows, schema)
    wide = {row.lake_id: row.asDict() for row in px.site_year_features(pixels).collect()}
    assert len(wide) == 3 and 0 < wide[1]["valid_count"] < 80 and wide[3]["valid_count"] == 0
    near = lambda a, b: a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)
    for part in (px.pixel_statistics, px.band_statistics, px.clear_statistics, px.water_statistics, px.spectral_summary):
        for row in part(pixels).collect():
            assert all(near(v, wide[row.lake_id][c]) for c, v in row.asDict().items()), part
    for row in px.index_statistics(pixels).collect():
        for s in ("mean", "std", "min", "max") + (("median", "p25", "p75") if row.index_name in px.QUARTILED else ()):
            assert near(row[s], wide[row.lake_id][f"{row.index_name}_{s}"])
    assert wide[3]["ndvi_mean"] is wide[3]["clear_mean"] is wide[3]["spectral_entropy"] is None and wide[3]["water_pct"] == 0.0


def test_classes_part_the_valid_pixels(spark):
    r = np.random.default_rng(3)
    rows = [(1, 2020, 0, i, *map(float, r.integers(0, 4000, len(BANDS))), 1.0) for i in range(300)]
    schema = grid(spark, [(0, 0, 1.0)]).schema
    w = px.water_statistics(spark.createDataFrame(rows, schema)).first()
    assert w.water_count + w.vegetation_count + w.soil_count == 300 and min(w.water_count, w.vegetation_count, w.soil_count) > 0


def test_indices_of_zero_divisors(spark):
    df = grid(spark, [(0, 0, 0.0)])
    row = df.select(*(f({b: F.col(b) for b in BANDS}).alias(n) for n, f in INDICES.items())).first()
    assert row.ndvi == row.ndwi == row.bsi == 0.0 and row.gci == -1.0
    with pytest.raises(ValueError, match="b12"):
        band_stack_checked(df.drop("b12"), BANDS)


def test_mosaics_of_scenes(spark):
    scenes = spark.createDataFrame(
        [(1, "a", "2020-01-01", 5.0, 0, 0, 10), (1, "b", "2020-02-01", 5.0, 0, 0, 30), (1, "c", "2020-03-01", 50.0, 0, 0, 90)],
        "lake_id long, scene_id string, taken_on string, cloud_pct double, r int, c int, b8 int",
    ).withColumn("taken_on", F.to_timestamp("taken_on"))
    clear = spark.createDataFrame([("a", 0, 0, 0.9), ("b", 0, 0, 0.9), ("c", 0, 0, 0.9)], "scene_id string, r int, c int, clear double")
    for method, want in (("median", 20), ("mean", 20), ("mosaic", 30)):
        row = px.composite(scenes, clear, ("b8",), method).first()
        assert (row.b8, row.clear_count) == (want, 2)


# pooling, geography, text, merges, streams


def test_encoder_and_pooling(spark):
    windows = spark.createDataFrame(
        [(1, 2020, w, [float(w)] * 4, [0, 1]) for w in range(3)], "lake_id long, year int, window_id long, pixels array<float>, token_ids array<int>"
    )

    def encode():
        return lambda pixels, tokens: [[[p[0] + 1.0, float(t)] for t in own] for p, own in zip(pixels, tokens)]

    out = encoded(windows, encode, batch=2)
    assert out.count() == 6
    tokens = out.withColumns({"lake_frac": F.col("token_id").cast("double"), "shore_frac": F.lit(0.0), "valid_frac": F.lit(1.0)})
    row = pooled(tokens).first()
    assert row.lake_embedding == pytest.approx([2 / 5**0.5, 1 / 5**0.5]) and row.shore_embedding is None and row.tokens_encoded == 6


def test_polygons(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0), (0.0, 0.0)]
    points = [((1.0, 1.0), True), ((2.0, 2.0), False), ((4.0, 2.0), True), ((5.0, 1.0), False), ((2.0, 1.0), True), ((0.0, 0.0), True)]
    df = spark.createDataFrame([(x, y, want) for (x, y), want in points], "x double, y double, want boolean")
    poly = F.array(*(F.struct(F.lit(a).alias("lon"), F.lit(b).alias("lat")) for a, b in ring))
    assert df.where(geo.covers(poly, F.col("x"), F.col("y")) != F.col("want")).count() == 0


def test_haversine_and_names(spark):
    df = spark.range(1).select(
        geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("quarter"),
        text.without_accents(F.lit("Bihār")).alias("plain"),
        text.trend(F.lit(1.0), F.lit(2.0)).alias("trend"),
        text.percent(F.lit(0.123)).alias("pct"),
        text.first_number(F.lit("x"), F.lit("0"), F.lit("2.5")).alias("n"),
        text.path_year(F.lit("/a/b/2021/lake_000001.tif")).alias("y"),
    )
    row = df.first()
    assert row.quarter == pytest.approx(math.pi / 2 * 6371.0) and row.plain == "Bihar" and row.trend == "increasing"
    assert row.pct == "12.3%" and row.n == 2.5 and row.y == 2021
    assert text.like_escaped("50%_\\") == "50\\%\\_\\\\"


def test_geojson(spark, tmp_path):
    (tmp_path / "x.json").write_text(
        '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"Hylak_id":7,"Lake_name":" Abc ","Country":"INDIA","Lake_area":"0","area":"3.5"},'
        '"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,2],[0,0]]]}},'
        '{"type":"Feature","properties":{"id":8,"country":"Chad"},"geometry":{"type":"MultiPolygon","coordinates":[[[[1,1],[2,1],[2,2],[1,1]]]]}}]}'
    )
    rows = geojson_features(spark, str(tmp_path / "x.json"))
    found = {r.lake_id: r for r in rows.collect()}
    assert found[7].lake_name == "Abc" and found[7].area_sqkm == 3.5 and (found[7].center_lon, found[7].center_lat) == (1.0, 1.0)
    assert len(found[8].ring) == 4
    assert geojson_features(spark, str(tmp_path / "x.json"), "india").count() == 1
    assert '"coordinates":[[[0.0,0.0]' in as_geojson(rows).where("lake_id = 7").first().feature


def test_versions_are_never_overwritten(spark, tmp_path):
    df = spark.createDataFrame([(1, 2020)], "lake_id long, year int")
    path = write_version(df, str(tmp_path / "t"), 1)
    assert spark.read.parquet(path).count() == 1
    with pytest.raises(Exception, match="(?i)exist"):
        write_version(df, str(tmp_path / "t"), 1)
    assert merged(df, df.limit(0), ["lake_id"]).count() == 1


def test_merge_stream(spark, tmp_path):
    source, table = tmp_path / "in", {}
    rows = [(1, 2020, 1, "a"), (1, 2020, 2, "b"), (2, 2020, 1, "c")]
    schema = "lake_id long, year int, at int, value string"
    spark.createDataFrame(rows, schema).write.parquet(str(source))

    def store(df, number):
        table["rows"] = spark.createDataFrame(df.collect(), df.schema)

    def run():
        stream = spark.readStream.schema(schema).parquet(str(source))
        merge_stream(stream, ["lake_id", "year"], "at", lambda: table.get("rows"), store, str(tmp_path / "ck")).awaitTermination()
        return {(r.lake_id, r.value) for r in table["rows"].collect()}

    assert run() == {(1, "b"), (2, "c")}
    spark.createDataFrame([(2, 2020, 5, "d"), (3, 2020, 1, "e")], schema).write.mode("append").parquet(str(source))
    assert run() == {(1, "b"), (2, "d"), (3, "e")}


def test_streamed_windows_are_the_tables(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    run = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {(r.start, r.event_type, r.n) for r in spark.table("w").collect()}
    assert got == {(r.start, r.event_type, r.n) for r in windowed_counts(events).withColumn("start", F.col("start").cast("timestamp")).collect()}


# entry point


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_operators(monkeypatch):
    import importlib

    monkeypatch.setitem(sys.modules, "tarn.llm", None)
    for name in [m for m in sys.modules if m.startswith("tarn.llm.") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    entry = importlib.import_module("__spark_entry__")
    assert "analog_search_cosine" in entry.queries() and "pipeline" not in entry.queries()


def test_nothing_else_imports_the_corpus_operators():
    root = Path(__file__).resolve().parents[1] / "tarn"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "tarn.llm" not in path.read_text(), path


def test_upsert_keeps_what_the_new_rows_lack(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, status string, size int")
    new = spark.createDataFrame([(2, "c", True), (3, "d", None), (2, "b", True)], "k int, status string, extra boolean")
    rows = {r.k: tuple(r) for r in merged(old, new, ["k"]).collect()}
    assert rows == {1: (1, "a", 5, None), 2: (2, "c", 6, True), 3: (3, "d", None, None)}


def test_roots_of_stored_paths(spark):
    paths = ["/d/2020/lake_000001.tif", "/d/2020/lake_000001/tile_0_0.tif", "/d/2021/lake_000001/tile_0_0.tif", "/2020/x.tif", "x.tif", "/d/2020/2020/x.tif", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string")
    rows = df.select("i", text.path_root(F.col("p"), F.lit(2020)).alias("r"), text.path_year(F.col("p")).alias("y")).orderBy("i").collect()
    assert [r.r for r in rows] == ["/d", "/d", None, "/", None, "/d/2020", None]
    assert [r.y for r in rows] == [2020, 2020, 2021, 2020, None, 2020, None]
    assert spark.range(1).select(text.slug(F.lit(" Wular Lake! ")), text.slug(F.lit("--"))).first()[:] == ("Wular_Lake", "lake")


def test_centroid_by_area(spark, tmp_path):
    hole = "[[0,0],[6,0],[6,6],[0,6],[0,0]],[[4,4],[6,4],[6,6],[4,6],[4,4]]"
    (tmp_path / "y.json").write_text(
        '{"type":"FeatureCollection","features":[{"properties":{"HYLAK_ID":1,"COUNTRY":"X","area_sqkm":2},'
        '"geometry":{"type":"MultiPolygon","coordinates":[[%s],[[[10,0],[12,0],[12,2],[10,2],[10,0]]]]}},'
        '{"properties":{"hydrolake_id":"2","Lake_name":"Bih\u0101r","lat":5.5,"lon":6.5},"geometry":null},'
        '{"properties":{"id":3},"geometry":{"type":"Polygon","coordinates":[[[1,1],[3,3],[1,1]]]}}]}' % hole
    )
    rows = {r.lake_id: r for r in geojson_features(spark, str(tmp_path / "y.json")).collect()}
    area = 36 - 4 + 4
    assert rows[1].center_lon == pytest.approx((36 * 3 - 4 * 5 + 4 * 11) / area)
    assert rows[1].center_lat == pytest.approx((36 * 3 - 4 * 5 + 4 * 1) / area)
    assert (rows[1].west, rows[1].east, rows[1].north, rows[1].area_sqkm, rows[1].lake_name) == (0, 12, 6, 2.0, "1")
    assert (rows[2].center_lat, rows[2].center_lon, rows[2].lake_name, rows[2].polygons) == (5.5, 6.5, "Bihar", None)
    assert rows[3].center_lon == pytest.approx(5 / 3)


def test_water_without_valid_pixels_is_zero(spark):
    from tarn.constants import BANDS
    from tarn.operators import pixels as px

    schema = "lake_id int, year int, " + ", ".join(f"{b} double" for b in BANDS) + ", area double"
    rows = [(1, 2020, *[None] * len(BANDS), 10.0), (2, 2020, *[500.0 + 10 * i for i in range(len(BANDS))], 1e6)]
    found = {r.lake_id: r for r in px.water_statistics(spark.createDataFrame(rows, schema), F.col("area")).collect()}
    assert found[1].water_count == found[1].water_pct == found[1].land_km2 == 0
    assert found[2].water_km2 + found[2].land_km2 == 1.0


def test_a_side_that_crosses_a_tile_reaches_it(spark):
    from tarn.operators.spatial import covered_tiles

    tile = lambda x, y: (1, f"{x}_{y}", float(x), float(y), x + 1.0, y + 1.0)
    tiles = spark.createDataFrame([tile(x, y) for x in range(6) for y in range(6)], "lake_id int, tile_index string, min_x double, min_y double, max_x double, max_y double")
    ring = [(0.1, 0.5), (5.9, 3.3), (5.8, 3.4), (0.1, 0.5)]
    rings = spark.createDataFrame([(1, ring)], "lake_id int, ring array<struct<lon:double,lat:double>>")
    found = {r.tile_index for r in covered_tiles(tiles, rings).collect()}
    want = set()
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        for k in range(20001):
            want.add(f"{int(ax + (bx - ax) * k / 20000)}_{int(ay + (by - ay) * k / 20000)}")
    assert found == want


def test_audit_names_what_each_twin_adds(spark):
    from tarn.operators.forecasts import forecast_audit

    forecast = spark.createDataFrame([("ndvi", 1, 2021, "up", 0.25, 0.1, 2), ("ndwi", 1, 2021, "stable", -0.0125, 0.1, 0)],
        "index_name string, h int, forecast_year int, direction string, weighted_score double, threshold double, twins_contributing int")
    twins = spark.createDataFrame([("ndvi", 1, 2, 0.1, 0.25, 0.2), ("ndvi", 1, 1, 0.3, 0.75, 0.6)], "index_name string, h int, rank int, delta double, normalized_weight double, fixed_weight double")
    said = {r.index_name: r.audit for r in forecast_audit(forecast, twins).collect()}
    assert said["ndvi"] == (
        "NDVI (Vegetation Vigor) @ 2021: ↑ (up) — weighted score = +0.250000 (threshold ±0.100000), 2 twin(s) contributing"
        " [Twin#1(Δ=+0.3000, w=0.75 [fixed 0.60]), Twin#2(Δ=+0.1000, w=0.25 [fixed 0.20])]."
    )
    assert said["ndwi"].endswith("weighted score = -0.012500 (threshold ±0.100000), 0 twin(s) contributing.")


def test_exact_medians_of_ties_zeros_and_odd_sizes(spark):
    rng = np.random.default_rng(5)
    groups = {
        "one": [3.5], "two": [0.0, 1e-9], "tied": [0.25] * 700 + list(rng.random(500)), "zeros": [0.0] * 9 + [5.0],
        "wide": list(10.0 ** rng.uniform(-12, 6, 1001)), "even": list(rng.lognormal(size=1000)),
    }
    rows = [(name, float(v)) for name, values in groups.items() for v in values]
    found = exact_median(spark.createDataFrame(rows, "g string, v double").repartition(7), ["g"], "v").collect()
    assert {r.g: r.n for r in found} == {name: len(values) for name, values in groups.items()}
    assert all(math.isclose(r.median, float(np.median(groups[r.g])), rel_tol=1e-15) for r in found)
    assert exact_median(spark.createDataFrame([], "g string, v double"), ["g"], "v").count() == 0


def test_parameters_stay_in_their_domains(spark):
    assert checks.years_checked([2020, 2019, 2020]) == [2019, 2020] and checks.years_of(2021) == [2021]
    assert checks.years_of(first=2024) == [2024, 2025] and checks.years_of()[0] == 2015
    assert [str(d) for d in checks.year_bounds(2020)] == ["2020-01-01", "2021-01-01"]
    records, sites = spark.createDataFrame([], RECORDS), spark.createDataFrame([], "lake_id long, center_lat double, center_lon double")
    wrong = [
        lambda: checks.years_checked([2014]), lambda: checks.years_of(first=2015, last=2026), lambda: checks.confirmed(False),
        lambda: analogs(records, 1, 2020, top_k=0), lambda: nearest(sites, 91.0, 0.0), lambda: nearest(sites, 0.0, -181.0),
        lambda: fc.embedding_forecast(records, records, 1, 2020, horizon=11), lambda: fc.embedding_forecast(records, records, 1, 2020, num_analogs=0),
        lambda: fc.ecological_forecast(records, records, 1, 2020, num_analogs=21), lambda: fc.ecological_forecast(records, records, 1, 2020, horizon=0),
    ]
    for call in wrong:
        with pytest.raises(ValueError):
            call()


def test_state_boundaries(spark, tmp_path):
    square = lambda x: [[[x, 0], [x + 1, 0], [x + 1, 1], [x, 1], [x, 0]]]
    feature = lambda props, kind, at: {"type": "Feature", "properties": props, "geometry": {"type": kind, "coordinates": at}}
    features = [
        feature({"ST_NM": " Bihār ", "name": "other"}, "Polygon", square(0)),
        feature({"state": " ", "shapeName": "Goa", "id": 7}, "MultiPolygon", [square(2), square(4)]),
        feature({"id": 3}, "Polygon", square(6)),
        {"type": "Feature", "properties": {"name": "Shapeless"}, "geometry": None},
    ]
    (tmp_path / "states.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    states = state_boundaries(spark, str(tmp_path / "states.geojson"))
    assert sorted((r.area_name, p[0][0].lon) for r in states.collect() for p in r.polygons) == [("Bihar", 0.0), ("Goa", 2.0), ("Goa", 4.0)]
    sites = spark.createDataFrame([(1, 0.5, 0.5), (2, 4.5, 0.5), (3, 6.5, 0.5)], "lake_id long, center_lon double, center_lat double")
    assert {r.lake_id: r.area_name for r in attributed(sites, states).collect()} == {1: "Bihar", 2: "Goa", 3: None}
    (tmp_path / "none.json").write_text('{"features": []}')
    for name, error in (("none.json", ValueError), ("states.kml", ValueError), ("states.shp", FileNotFoundError)):
        with pytest.raises(error):
            state_boundaries(spark, str(tmp_path / name))


def test_output_patterns_without_a_root(spark):
    rows = [(1, 2020, "COMPLETED", "gs/export.tif", None), (2, 2021, "FAILED", "/a/2021/x.tif", None), (3, 2022, "COMPLETED", "/a/2022/x.tif", None)]
    found = output_patterns(spark.createDataFrame(rows, "lake_id long, year int, status string, image_path string, updated_at timestamp"), "/d")
    assert {r.year: r.output_path_pattern for r in found.collect()} == {2020: "/d/2020/lake_{lake_id:06d}.tif", 2022: "/a/2022/lake_{lake_id:06d}.tif"}


@pytest.mark.parametrize("method", ["cosine", "l2", "ip"])
def test_nearest_to_each_agrees_with_one_by_one(spark, monkeypatch, method):
    for name, size in (("VECTORS", 40), ("QUERIES", 3)):
        monkeypatch.setattr(f"tarn.operators.trajectories.{name}", size)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(150)]
    odd = [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0]), (203, [1.0, 2.0]), (204, [float("nan")] * 4), (None, [1.0] * 4)]
    schema = "vec_id long, embedding array<double>"
    vectors = spark.createDataFrame(rows + odd, schema)
    found = nearest_to_each(vectors, vectors.where("vec_id % 25 = 0 AND vec_id <= 200"), method, 7).collect()
    assert {r.query_id for r in found} == {0, 25, 50, 75, 100, 125}
    plain_rows = spark.createDataFrame(rows, schema)
    for q in (0, 75):
        want = nearest_vectors(plain_rows, rows[q][1], method, 150, exclude=q).collect()
        got = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        order = sorted(((-round(w.score, 9), w.vec_id) for w in want))[:7]
        assert [(-round(s, 9), i) for _, i, s in got] == order
    assert nearest_to_each(vectors.limit(0), vectors, method).count() == 0


def test_search_of_all_scores_few_pairs_one_by_one(spark, monkeypatch):
    """Equal and nearly equal sites, in blocks; no query vector meets all records by differences."""
    import pyarrow as pa
    from tarn.operators import trajectories as tr

    rng = np.random.default_rng(3)
    shapes = rng.normal(size=(12, 7, 16)).astype(np.float32)
    site = np.repeat(np.arange(60), 7)
    vectors = np.concatenate([shapes[s % 12] + (1e-4 if s % 5 == 0 else 0) for s in range(60)]).astype(np.float32)
    year = np.tile(np.arange(2010, 2017, dtype=np.int32), 60)
    sites = pa.table({"lake_id": site, "year": year, "embedding": pa.array(list(vectors), pa.list_(pa.float32()))})
    recent = year >= 2012
    queries = pa.table({"query_id": site[recent], "asked_year": year[recent], "vector": pa.array(list(vectors[recent]), pa.list_(pa.float32()))})
    rows = vectors.astype(float).reshape(60, 7, 16)
    each = np.round(1 / (1 + np.sqrt(((rows[None, :, :, None] - rows[:, None, None, 2:]) ** 2).sum(axis=4))), tr.DIGITS)
    raw = np.stack([sum(each[:, :, w + k, k] for k in range(5)) / 5 for w in range(3)], axis=2)
    monkeypatch.setattr(tr, "pair_scores", lambda *_: pytest.fail("all records met a query vector"))
    monkeypatch.setattr(tr, "PAIRS", 50)
    found = tr.best_of_block("euclidean", 5)(sites, queries).to_pylist()
    for q in range(60):
        order = sorted((-raw[q, s].max(), s) for s in range(60) if s != q)[:5]
        got = [(r["lake_id"], r["start_year"], r["raw_score"]) for r in found if r["query_id"] == q]
        assert got == [(s, 2010 + int(raw[q, s].argmax()), -score) for score, s in order]
