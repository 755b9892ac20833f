"""Grey-level co-occurrence of neighbouring pixels, in square blocks with a border."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.constants import TEXTURE_BAND, TEXTURE_LEVELS, TEXTURE_OFFSETS

KEYS = ["lake_id", "year"]
#: Pixels of a block's side; what parts numbers of levels; the order of a block's rows.
BLOCK, RADIX = 256, 1 << 12
ORDER = ["lake_id", "year", "block_r", "block_c", "r", "c", "level"]
PROPERTIES = ("contrast", "dissimilarity", "homogeneity", "energy", "entropy", "correlation")


def quantised(pixels: DataFrame, band: str = TEXTURE_BAND, levels: int = TEXTURE_LEVELS) -> DataFrame:
    """(lake_id, year, r, c, level) of valid pixels; a constant band is level 0."""
    valid = pixels.where(F.col(band).isNotNull())
    ends = valid.groupBy(KEYS).agg(F.min(band).alias("low"), F.max(band).alias("high"), F.count(F.lit(1)).alias("n"))
    width = F.col("high") - F.col("low")
    level = F.when(width > 0, (F.col(band) - F.col("low")) / F.when(width > 0, width) * (levels - 1)).otherwise(0.0)
    return (
        valid.join(ends, KEYS)
        .where(F.col("n") >= 4)
        .select(*KEYS, "r", "c", F.least(F.lit(levels - 1), level.cast("int")).alias("level"))
    )


def in_blocks(levels: DataFrame) -> DataFrame:
    """Pixels dealt to the block that holds them, and to those whose border they are."""
    reached = lambda v: F.array_distinct(F.array(*(F.floor((F.col(v) + d) / BLOCK) for d in (-1, 0, 1))))
    edged = levels.select(*KEYS, "r", "c", "level", F.explode(reached("r")).alias("block_r"))
    dealt = edged.select("*", F.explode(reached("c")).alias("block_c"))
    return dealt.select(*(F.col(c).cast("long").alias(c) for c in ORDER))


def block_counts(rows: np.ndarray, offsets) -> Iterator[np.ndarray]:
    """Rows (lake_id, year, offset, i, j, n) of whole blocks, given as rows of ``ORDER``.

    Places of all blocks are numbers in order, in which a neighbour is sought; a pair
    counts in the block that holds its first pixel.
    """
    block, site = (np.cumsum(np.concatenate(([0], (rows[1:, :n] != rows[:-1, :n]).any(axis=1)))) for n in (4, 2))
    r, c = rows[:, 4] - rows[:, 2] * BLOCK + 1, rows[:, 5] - rows[:, 3] * BLOCK + 1
    stride = BLOCK + 3
    place = (block * stride + r) * stride + c
    order = np.argsort(place, kind="stable")
    place, level, site, names = place[order], rows[order, 6], site[order], rows[order, :2]
    own = ((r >= 1) & (r <= BLOCK) & (c >= 1) & (c <= BLOCK))[order]
    for k, (dy, dx) in enumerate(offsets):
        wanted = place[own] + dy * stride + dx
        at = np.minimum(np.searchsorted(place, wanted), len(place) - 1)
        hit = place[at] == wanted
        codes, first, n = np.unique((site[own][hit] * RADIX + level[own][hit]) * RADIX + level[at[hit]], return_index=True, return_counts=True)
        if len(codes):
            yield np.column_stack((names[own][hit][first], np.full(len(n), k), codes // RADIX % RADIX, codes % RADIX, n))


def dealt(rows: DataFrame, tasks: int | None, *columns: str) -> DataFrame:
    return rows.repartition(tasks, *columns) if tasks else rows.repartition(*columns)


def pair_counts(levels: DataFrame, offsets=TEXTURE_OFFSETS, tasks: int | None = None) -> DataFrame:
    """(lake_id, year, offset, i, j, n): how many pairs at an offset have levels i <= j, in either order.

    Pixels go to square blocks of ``BLOCK`` a side, with a border of one pixel, and are
    counted there, so only counts of pairs of levels go on.  A task holds the blocks
    that end in an Arrow batch, and one that does not.  Counts are shuffled once, by
    site and year; what follows by site and year adds no shuffle, sort or window.
    ``tasks`` is the number of tasks that share the pixels, by default the session's.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, len(ORDER)), np.int64)

        def counted(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for found in block_counts(rows, offsets):
                yield pa.RecordBatch.from_arrays(list(map(pa.array, found.T)), [*KEYS, "offset", "i", "j", "n"])

        for batch in batches:
            held = np.concatenate((held, np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ORDER])))
            whole = np.flatnonzero((held[:, :4] != held[-1:, :4]).any(axis=1))
            if len(whole):
                yield from counted(held[: whole[-1] + 1])
                held = held[whole[-1] + 1 :]
        if len(held):
            yield from counted(held)

    i, j = F.least("i", "j").cast("int"), F.greatest("i", "j").cast("int")
    counted = (
        dealt(in_blocks(levels), tasks, *ORDER[:4])
        .sortWithinPartitions(*ORDER[:4])
        .mapInArrow(read, "lake_id long, year long, offset long, i long, j long, n long")
        .select("lake_id", *(F.col(x).cast("int").alias(x) for x in ("year", "offset")), i.alias("i"), j.alias("j"), "n")
    )
    return dealt(counted, tasks, *KEYS).groupBy(*KEYS, "offset", "i", "j").agg(F.sum("n").alias("n"))


def texture(
    pixels: DataFrame, band: str = TEXTURE_BAND, levels: int = TEXTURE_LEVELS, tasks: int | None = None
) -> DataFrame:
    """Six texture properties, averaged over the orientations that have pairs.

    Sites without four valid pixels, or without a pair, have no row.  The share of a
    pair of levels, both ways round, is its count in the whole; a pair of equal levels
    is its own other way round, so it counts double there.
    """
    i, j, gap = F.col("i"), F.col("j"), F.col("j") - F.col("i")
    same = i == j
    cell, cells = F.when(same, 2 * F.col("n")).otherwise(F.col("n")), F.when(same, 1).otherwise(2)
    over = lambda value: F.sum(cells * cell * value)
    whole = F.col("whole")
    sums = {
        "contrast": over(gap * gap),
        "dissimilarity": over(gap),
        "homogeneity": over(1 / (1 + gap * gap)),
        "energy": over(cell.cast("double")),
        "entropy": over(F.log2(cell)),
        "mean": over((i + j) / 2),
        "square": over((i * i + j * j) / 2),
        "product": over(i * j),
    }
    shares = {name: F.col(name) / whole for name in sums}
    shares |= {"energy": F.col("energy") / whole / whole, "entropy": F.log2(whole) - F.col("entropy") / whole}
    of_offset = (
        pair_counts(quantised(pixels, band, levels), tasks=tasks)
        .groupBy(*KEYS, "offset")
        .agg(F.sum(cells * cell).alias("whole"), *(s.alias(name) for name, s in sums.items()))
        .withColumns(shares)
        .withColumn("variance", F.col("square") - F.col("mean") * F.col("mean"))
    )
    wide = F.col("variance") > 1e-12
    correlation = F.when(
        wide, (F.col("product") - F.col("mean") * F.col("mean")) / F.when(wide, F.col("variance"))
    ).otherwise(0.0)
    return (
        of_offset.withColumn("correlation", correlation)
        .groupBy(KEYS)
        .agg(*(F.round(F.avg(name), 6).alias(f"glcm_{name}") for name in PROPERTIES))
    )
