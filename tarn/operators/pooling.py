"""Embeddings of a site and year from token vectors, blended and re-blended."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.constants import EMBEDDING_VERSION, LAKE_WEIGHT
from tarn.functions.vectors import blend, unit
from tarn.operators.pixels import token_windows

KEYS = ["lake_id", "year"]


def token_fractions(pixels: DataFrame) -> DataFrame:
    """Shares of lake, shore and valid pixels in each token that touches either.

    ``pixels`` has the masks in_lake, in_shore and valid.
    """
    part = lambda mask: F.avg(F.col(mask).cast("double"))
    return (
        token_windows(pixels)
        .groupBy(*KEYS, "window_r", "window_c", "token_id")
        .agg(part("in_lake").alias("lake_frac"), part("in_shore").alias("shore_frac"), part("valid").alias("valid_frac"))
        .where(F.col("lake_frac") + F.col("shore_frac") > 0)
    )


def encoded(windows: DataFrame, encode: Callable, batch: int = 64) -> DataFrame:
    """Token vectors of windows by any encoder.

    ``windows`` has lake_id, year, window_id, pixels (a flat array) and token_ids;
    ``encode`` makes the encoder once a worker, which then maps a list of arrays of
    pixels and one of lists of token ids to a list of vectors for each window.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encode()
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                some = whole.slice(at, batch)
                rows = some.drop_columns(["pixels"]).to_pylist()
                vectors = model([p.values.to_numpy() for p in some.column("pixels")], [r["token_ids"] for r in rows])
                yield pa.RecordBatch.from_pylist(
                    [
                        {k: r[k] for k in ("lake_id", "year", "window_id")} | {"token_id": t, "vec": list(map(float, v))}
                        for r, own in zip(rows, vectors)
                        for t, v in zip(r["token_ids"], own)
                    ],
                    pa.schema(
                        [("lake_id", pa.int64()), ("year", pa.int32()), ("window_id", pa.int64()), ("token_id", pa.int32()), ("vec", pa.list_(pa.float32()))]
                    ),
                )

    wanted = windows.select("lake_id", F.col("year").cast("int").alias("year"), "window_id", "pixels", "token_ids")
    return wanted.mapInArrow(read, "lake_id long, year int, window_id long, token_id int, vec array<float>")


def _weighted(weight: str) -> Column:
    return F.sum(F.col(weight) * F.col("valid_frac") * F.col("x").cast("double"))


def pooled(tokens: DataFrame) -> DataFrame:
    """Unit lake and shore vectors, and the weights behind them.

    Sums go by position, so a site with very many tokens is summed before the
    shuffle and no task holds its vectors.
    """
    by_place = (
        tokens.select(*KEYS, "lake_frac", "shore_frac", "valid_frac", F.posexplode("vec").alias("at", "x"))
        .groupBy(*KEYS, "at")
        .agg(
            _weighted("lake_frac").alias("lake"),
            _weighted("shore_frac").alias("shore"),
            F.sum(F.col("lake_frac") * F.col("valid_frac")).alias("lake_token_weight"),
            F.sum(F.col("shore_frac") * F.col("valid_frac")).alias("shore_token_weight"),
            F.count(F.lit(1)).alias("tokens_encoded"),
        )
    )
    vectors = by_place.groupBy(KEYS).agg(
        F.array_sort(F.collect_list(F.struct("at", "lake", "shore"))).alias("places"),
        F.max("lake_token_weight").alias("lake_token_weight"),
        F.max("shore_token_weight").alias("shore_token_weight"),
        F.max("tokens_encoded").alias("tokens_encoded"),
    )
    mean = lambda part: unit(
        F.when(F.col(f"{part}_token_weight") > 0, F.transform("places", lambda r: r[part] / F.col(f"{part}_token_weight")))
    )
    return vectors.select(
        *KEYS,
        mean("lake").alias("lake_embedding"),
        mean("shore").alias("shore_embedding"),
        "lake_token_weight",
        "shore_token_weight",
        "tokens_encoded",
    )


def blended(regions: DataFrame, lake_weight: float = LAKE_WEIGHT) -> DataFrame:
    """``regions`` with embedding and lake_weight; without a shore the weight is 1."""
    return regions.withColumn("embedding", blend(F.col("lake_embedding"), F.col("shore_embedding"), F.lit(lake_weight))).withColumn(
        "lake_weight", F.when(F.col("shore_embedding").isNull(), 1.0).otherwise(lake_weight)
    )


def reblended(regions: DataFrame, lake_weight: float, years: list[int] | None = None) -> DataFrame:
    """Current, completed rows blended anew; the others as they are, marked skipped."""
    if not 0 <= lake_weight <= 1:
        raise ValueError("lake_weight goes from 0 to 1")
    usable = (
        (F.col("status") == "completed")
        & (F.col("embedding_version") == EMBEDDING_VERSION)
        & F.col("lake_embedding").isNotNull()
    )
    wanted = usable if years is None else usable & F.col("year").isin(years)
    old = {f"old_{c}": F.col(c) for c in ("embedding", "lake_weight")}
    new = blended(regions.withColumns(old), lake_weight)
    pick = lambda c: F.when(wanted, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) if f"old_{c}" in old else F.col(c)
    return new.select(*map(pick, regions.columns), F.when(wanted, "updated").otherwise("skipped").alias("outcome"))


def weight_summary(regions: DataFrame) -> DataFrame:
    """Rows by kind and rounded weight."""
    kind = F.when(F.col("shore_embedding").isNull(), "lake_only").otherwise("blended").alias("kind")
    return regions.groupBy(kind, F.round("lake_weight", 3).alias("weight")).agg(F.count(F.lit(1)).alias("n"))


def current_weight(regions: DataFrame) -> DataFrame:
    """The most frequent weight of blended rows; the one seen first on ties."""
    return (
        regions.where(F.col("shore_embedding").isNotNull())
        .groupBy("lake_weight")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("year", "lake_id")).alias("seen"))
        .agg(F.max_by("lake_weight", F.struct("n", -F.col("seen.year"), -F.col("seen.lake_id"))).alias("lake_weight"))
    )


def mixed_after(regions: DataFrame, years: list[int], lake_weight: float, tolerance: float = 1e-6) -> DataFrame:
    """One row: whether blending ``years`` anew leaves other years with other weights."""
    done = (F.col("status") == "completed") & F.col("shore_embedding").isNotNull() & ~F.col("year").isin(years)
    other = F.bool_or(done & (F.abs(F.col("lake_weight") - lake_weight) > tolerance))
    return regions.agg(F.coalesce(other, F.lit(False)).alias("mixed"))


def available_years(regions: DataFrame) -> DataFrame:
    done = regions.where((F.col("status") == "completed") & F.col("embedding").isNotNull())
    return done.select("year").distinct().orderBy("year")


def share_of_group(column: str, *keys: str) -> Column:
    """A value over the sum of its group; equal shares where that is not positive."""
    group = Window.partitionBy(*keys)
    whole = F.sum(column).over(group)
    return F.coalesce(F.when(whole > 0, F.col(column) / F.when(whole > 0, whole)), 1 / F.count(F.lit(1)).over(group))
