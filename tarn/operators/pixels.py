"""Statistics of pixel tables, one row per pixel, grouped by site and year.

A pixel table has lake_id, year, r, c, the bands, clear_count and ``valid``.
Every statistic is one aggregation with partial sums before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.constants import BANDS, CLEAR, EPSILON, INPUT_BANDS, INPUT_MEAN, INPUT_STD, NODATA, REFLECTANCE_SCALE, TOKEN_PX, WINDOW_PX
from tarn.functions.checks import year_bounds
from tarn.functions.spectral import INDICES, finite, pixel_class

KEYS = ["lake_id", "year"]


def without_nodata(pixels: DataFrame) -> DataFrame:
    """Bands with the nodata mark as null."""
    return pixels.withColumns({b: F.nullif(F.col(b), F.lit(NODATA).cast(pixels.schema[b].dataType)) for b in BANDS})


def all_bands() -> Column:
    """Whether every band of a pixel has a value."""
    return F.forall(F.array(*BANDS), lambda b: b.isNotNull())


def band_statistics(pixels: DataFrame, bands: tuple[str, ...] = BANDS) -> DataFrame:
    """Mean, population deviation, least, most and median of each band by itself."""
    stats = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max, "median": F.median}
    return pixels.groupBy(KEYS).agg(*(f(b).alias(f"{b}_{s}") for b in bands for s, f in stats.items()))


def clear_statistics(pixels: DataFrame) -> DataFrame:
    """Clear observations of pixels that have all bands."""
    return (
        pixels.where(all_bands())
        .groupBy(KEYS)
        .agg(
            F.round(F.avg(CLEAR), 4).alias("clear_mean"),
            F.min(CLEAR).alias("clear_min"),
            F.median(CLEAR).alias("clear_median"),
        )
    )


def share(part: Column, whole: Column, digits: int, scale: float = 1.0) -> Column:
    return F.when(whole > 0, F.round(part / F.when(whole > 0, whole) * scale, digits)).otherwise(0.0)


def _pixel_parts() -> list[Column]:
    return [F.count(F.lit(1)).alias("pixel_count"), F.count_if(all_bands()).alias("valid_count")]


def _pixel_shares() -> dict[str, Column]:
    whole, valid = F.col("pixel_count"), F.col("valid_count")
    return {
        "nodata_count": whole - valid,
        "coverage_pct": share(valid, whole, 4, 100.0),
        "cloud_pct": share(whole - valid, whole, 4, 100.0),
        "valid_ratio": share(valid, whole, 6),
    }


def pixel_statistics(pixels: DataFrame) -> DataFrame:
    """Counts of all, valid and missing pixels, and their shares."""
    return pixels.groupBy(KEYS).agg(*_pixel_parts()).withColumns(_pixel_shares())


def reflectances() -> dict[str, Column]:
    return {b: F.col(b) / REFLECTANCE_SCALE for b in BANDS}


def index_pixels(pixels: DataFrame, names: tuple[str, ...] = tuple(INDICES)) -> DataFrame:
    """Pixels that have all bands, with the indices asked for."""
    x = reflectances()
    return pixels.where(all_bands()).select(*KEYS, "r", "c", *(INDICES[n](x).alias(n) for n in names))


def index_statistics(pixels: DataFrame, names: tuple[str, ...] = tuple(INDICES)) -> DataFrame:
    """One row per site, year and index, over its finite pixels."""
    pairs = F.array(*(F.struct(F.lit(n).alias("index_name"), finite(F.col(n)).alias("value")) for n in names))
    quarters = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    return (
        index_pixels(pixels, names)
        .select(*KEYS, F.inline(pairs))
        .where("value IS NOT NULL")
        .groupBy(*KEYS, "index_name")
        .agg(
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.percentile("value", F.array(*map(F.lit, quarters.values()))).alias("_quarters"),
        )
        .withColumns({q: F.get("_quarters", F.lit(i)) for i, q in enumerate(quarters)})
        .drop("_quarters")
    )


def _water_parts(pixel_area_m2: float | Column) -> list[Column]:
    kind = F.when(all_bands(), pixel_class(reflectances()))
    area = pixel_area_m2 if isinstance(pixel_area_m2, Column) else F.lit(float(pixel_area_m2))
    over = lambda *kinds: F.coalesce(F.sum(F.when(kind.isin(*kinds), area)), F.lit(0.0))
    return [
        *(F.count_if(kind == k).alias(f"{k}_count") for k in ("water", "vegetation", "soil")),
        over("water").alias("_water"),
        over("vegetation", "soil").alias("_land"),
    ]


def _water_shares() -> dict[str, Column]:
    land = F.col("vegetation_count") + F.col("soil_count")
    whole = F.col("water_count") + land
    return {
        **{f"{k}_pct": share(F.col(f"{k}_count"), whole, 4, 100.0) for k in ("water", "vegetation", "soil")},
        "water_km2": F.round(F.col("_water") / 1e6, 6),
        "land_km2": F.round(F.col("_land") / 1e6, 6),
        "water_land_ratio": share(F.col("water_count"), land, 6),
    }


def water_statistics(pixels: DataFrame, pixel_area_m2: float | Column = 900.0) -> DataFrame:
    """Pixels, shares and areas of water, vegetation and soil; zeros without valid pixels.

    ``pixel_area_m2`` may be a column, as ``geo.pixel_area_m2`` gives for degrees.
    """
    counted = pixels.groupBy(KEYS).agg(*_water_parts(pixel_area_m2))
    return counted.withColumns(_water_shares()).drop("_water", "_land")


def _summary_parts(x: dict[str, Column]) -> list[Column]:
    """What ``_summarised`` reads, added up over pixels with the bands ``x``."""
    mean = sum(x.values(), F.lit(0.0)) / len(x)
    spread = sum(((v - mean) * (v - mean) for v in x.values()), F.lit(0.0))
    return [
        F.avg((x["b2"] + x["b3"] + x["b4"]) / 3).alias("_bright"),
        F.avg(x["b8"] - x["b4"]).alias("_nir_red"),
        F.avg(x["b3"] - x["b11"]).alias("_green_swir"),
        F.avg(spread / len(x)).alias("_variance"),
        *(F.avg(v).alias(f"_{b}") for b, v in x.items()),
    ]


def _summarised() -> list[Column]:
    means = [F.col(f"_{b}") for b in BANDS]
    whole = sum(means, F.lit(0.0))
    parts = [m / F.when(whole > EPSILON, whole) for m in means]
    entropy = -sum((F.when(p > 0, p * F.log2(p)).otherwise(0.0) for p in parts), F.lit(0.0)) / math.log2(len(BANDS))
    seen = F.col("_bright").isNotNull()
    return [
        F.round("_bright", 6).alias("visible_brightness"),
        F.round("_nir_red", 6).alias("nir_red_difference"),
        F.round("_green_swir", 6).alias("green_swir_difference"),
        F.round("_variance", 6).alias("spectral_variance"),
        F.when(seen, F.round(F.when(whole > EPSILON, entropy).otherwise(0.0), 6)).alias("spectral_entropy"),
    ]


def spectral_summary(pixels: DataFrame) -> DataFrame:
    """Brightness, contrasts, mean variance over the bands and their entropy."""
    x = {b: F.col(b).cast("double") for b in BANDS}
    return pixels.where(all_bands()).groupBy(KEYS).agg(*_summary_parts(x)).select(*KEYS, *_summarised())


#: Indices whose quartiles the wide row holds beside mean, deviation and range.
QUARTILED = ("ndvi", "ndwi")


def site_year_features(pixels: DataFrame, pixel_area_m2: float | Column = 900.0) -> DataFrame:
    """The wide row of a site and year: the statistics above side by side.

    Two aggregations by the same key, joined where they lie: one of sums, whose
    partial results are small, and one of medians and quartiles, whose are not.
    Without valid pixels the statistics are null, counts and shares 0.
    """
    ok = all_bands()
    seen = pixels.withColumns({f"_ok_{b}": F.when(ok, F.col(b).cast("double")) for b in BANDS})
    x = {b: F.col(f"_ok_{b}") for b in BANDS}
    scaled = {b: v / REFLECTANCE_SCALE for b, v in x.items()}
    ready = seen.withColumns({f"_i_{n}": finite(index(scaled)) for n, index in INDICES.items()} | {"_clear": F.when(ok, F.col(CLEAR))})
    stats = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    sums = ready.groupBy(KEYS).agg(
        *_pixel_parts(),
        *_water_parts(pixel_area_m2),
        *_summary_parts(x),
        F.round(F.avg("_clear"), 4).alias("clear_mean"),
        F.min("_clear").alias("clear_min"),
        *(f(b).alias(f"{b}_{s}") for b in BANDS for s, f in stats.items()),
        *(f(f"_i_{n}").alias(f"{n}_{s}") for n in INDICES for s, f in stats.items()),
    )
    quarters = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    of_index = [F.percentile(f"_i_{n}", F.array(*map(F.lit, quarters.values()))).alias(f"_q_{n}") for n in QUARTILED]
    middle = ready.groupBy(KEYS).agg(*(F.median(b).alias(f"{b}_median") for b in BANDS), F.median("_clear").alias("clear_median"), *of_index)
    wide = sums.join(middle, KEYS).withColumns(
        {f"{n}_{q}": F.get(f"_q_{n}", F.lit(i)) for n in QUARTILED for i, q in enumerate(quarters)}
    )
    out = wide.select("*", *_summarised()).withColumns(_pixel_shares())
    out = out.withColumns(_water_shares())
    return out.drop(*(c for c in out.columns if c.startswith("_")))


def mosaic(tiles: DataFrame, bands: tuple[str, ...] = BANDS) -> DataFrame:
    """Overlapping tiles as one grid: of each pixel and band the first valid value.

    ``tiles`` has lake_id, year, r, c, tile_order and bands with nodata as null.
    """
    first = lambda b: F.min_by(b, F.when(F.col(b).isNotNull(), F.col("tile_order")))
    return tiles.groupBy(*KEYS, "r", "c").agg(*(first(b).alias(b) for b in bands))


def overview(pixels: DataFrame, factor: int, bands: tuple[str, ...] = BANDS) -> DataFrame:
    """Means of blocks of ``factor`` by ``factor`` pixels."""
    return pixels.groupBy(
        *KEYS, F.floor(F.col("r") / factor).alias("r"), F.floor(F.col("c") / factor).alias("c")
    ).agg(*(F.avg(b).alias(b) for b in bands))


def composite(
    scenes: DataFrame,
    quality: DataFrame,
    bands: tuple[str, ...],
    method: str = "median",
    max_cloud: float = 20.0,
    clear_from: float = 0.6,
    year: int | None = None,
) -> DataFrame:
    """Pixels of a year's scenes put together, and how many were clear.

    ``scenes`` has scene_id, taken_on, cloud_pct and pixels; ``quality`` has
    scene_id, r, c and clear, the probability that the pixel is clear.  A mosaic
    takes the latest clear value, of one day that of the largest scene_id; a pixel
    without any is null.  ``year`` takes the scenes of that year alone.
    """
    if year is not None:
        first, next_ = year_bounds(year)
        scenes = scenes.where((F.col("taken_on") >= F.lit(first)) & (F.col("taken_on") < F.lit(next_)))
    seen = scenes.where(F.col("cloud_pct") < max_cloud).join(quality, ["scene_id", "r", "c"], "left")
    masked = {b: F.when(F.col("clear") >= clear_from, F.col(b)) for b in bands}
    how = {
        "median": F.median,
        "mean": F.avg,
        "mosaic": lambda v: F.max_by(v, F.when(v.isNotNull(), F.struct("taken_on", "scene_id"))),
    }[method]
    return seen.groupBy("lake_id", F.year("taken_on").alias("year"), "r", "c").agg(
        *(F.round(how(v)).cast("int").alias(b) for b, v in masked.items()),
        F.count(masked[bands[0]]).alias(CLEAR),
    )


def standardised(pixels: DataFrame, *besides: Column) -> DataFrame:
    """The encoder's input bands, centred and scaled; a missing value becomes the mean.  ``besides`` go along."""
    value = lambda b, m, s: F.coalesce((F.col(b) - m) / s, F.lit(0.0)).alias(b)
    return pixels.select(*KEYS, "r", "c", *map(value, INPUT_BANDS, INPUT_MEAN, INPUT_STD), *besides)


def token_windows(pixels: DataFrame) -> DataFrame:
    """Each pixel's window of 224 and token of 16 pixels, by integer arithmetic."""
    r, c = F.col("r"), F.col("c")
    side = WINDOW_PX // TOKEN_PX
    in_window = lambda v: F.floor(F.pmod(v, F.lit(WINDOW_PX)) / TOKEN_PX)
    return pixels.withColumns(
        {
            "window_r": F.floor(r / WINDOW_PX),
            "window_c": F.floor(c / WINDOW_PX),
            "token_id": in_window(r) * side + in_window(c),
        }
    )
