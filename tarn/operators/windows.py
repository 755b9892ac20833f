"""Dense windows of pixels for an encoder, from sparse pixel tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.constants import INPUT_BANDS, LAKE_WEIGHT, MIN_LAKE_PIXELS, TOKEN_PX, WINDOW_PX
from tarn.operators import runs
from tarn.operators.pixels import standardised

KEYS = ["lake_id", "year"]
SHARES = ("lake_frac", "shore_frac", "valid_frac")
PLACE = [*KEYS, "window_r", "window_c"]


def centred(low: Column, high: Column) -> tuple[Column, Column]:
    """(first pixel, windows) of a block of whole windows around places low to high.

    The places' extent goes out to whole tokens; what the windows have besides is dealt
    to both sides, in whole tokens.
    """
    first, end = F.floor(low / TOKEN_PX) * TOKEN_PX, F.ceil((high + 1) / TOKEN_PX) * TOKEN_PX
    n = F.greatest(F.ceil((end - first) / WINDOW_PX), F.lit(1))
    return first - F.floor((n * WINDOW_PX - (end - first)) / (2 * TOKEN_PX)) * TOKEN_PX, n


def placed(pixels: DataFrame) -> DataFrame:
    """Pixels of ``dense_windows`` with their window and place in it, side by side by window."""
    near = pixels.where("in_lake OR in_shore").groupBy(KEYS).agg(*(f(x).alias(f"{n}_{x}") for x in "rc" for n, f in (("low", F.min), ("high", F.max))))
    blocks = {x: centred(F.col(f"low_{x}"), F.col(f"high_{x}")) for x in "rc"}
    blocks = near.select(*KEYS, *(v.alias(f"{n}_{x}") for x, pair in blocks.items() for n, v in zip(("first", "n"), pair)))
    masks = [F.coalesce(F.col(m), F.lit(False)).alias(m) for m in ("in_lake", "in_shore", "valid")]
    within = lambda x: (F.col(x) >= F.col(f"first_{x}")) & (F.col(x) < F.col(f"first_{x}") + F.col(f"n_{x}") * WINDOW_PX)
    value = lambda b: F.when(F.col("valid"), F.col(b)).otherwise(0.0).alias(b)
    dealt = (
        standardised(pixels, *masks)
        .join(blocks, KEYS)
        .where(within("r") & within("c"))
        .withColumns({x: F.col(x) - F.col(f"first_{x}") for x in "rc"})
        .select(
            *KEYS,
            *(F.floor(F.col(x) / WINDOW_PX).alias(f"window_{x}") for x in "rc"),
            (F.col("r") % WINDOW_PX * WINDOW_PX + F.col("c") % WINDOW_PX).cast("int").alias("place"),
            *(F.col(m) & F.col("valid") if m != "valid" else F.col(m) for m in ("in_lake", "in_shore", "valid")),
            *map(value, INPUT_BANDS),
            F.col("n_c"),
        )
        .toDF(*PLACE, "place", *SHARES, *INPUT_BANDS, "n_c")
    )
    return dealt.repartition(*PLACE).sortWithinPartitions(*PLACE)


def dense_windows(pixels: DataFrame) -> DataFrame:
    """Windows of a site and year that hold valid pixels of its lake or shore.

    ``pixels`` has lake_id, year, r, c, the input bands, in_lake, in_shore and valid.
    The block of windows is centred on lake and shore.  A window has ``pixels``, a flat
    array by band, row and column, standardised, 0 where a pixel is invalid or missing;
    ``token_ids`` of the tokens that hold valid pixels of lake or shore; and for each of
    those the shares of its pixels that are valid lake, valid shore and valid.  Pixels
    outside the block are left out.  A task holds one window at a time.
    """
    columns = "lake_id long, year int, window_id long, pixels array<float>, token_ids array<int>, lake_frac array<double>, shore_frac array<double>, valid_frac array<double>"
    return placed(pixels).mapInArrow(assembled, columns)


def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows from their pixels, which come side by side."""
    side = WINDOW_PX // TOKEN_PX
    token_of = np.arange(WINDOW_PX**2) // WINDOW_PX // TOKEN_PX * side + np.arange(WINDOW_PX**2) % WINDOW_PX // TOKEN_PX

    def runs_of() -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for batch in batches:
            places = np.column_stack([batch.column(c).to_numpy() for c in [*PLACE, "n_c"]])
            cuts = [0, *(np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    yield tuple(places[a].tolist()), batch.slice(a, b - a)

    for (lake_id, year, row, column, n_columns), own in groupby(runs_of(), lambda x: x[0]):
        data = np.zeros((len(INPUT_BANDS), WINDOW_PX**2), np.float32)
        shares = np.zeros((len(SHARES), WINDOW_PX**2), bool)
        for _, part in own:
            place = part.column("place").to_numpy()
            for into, names in ((data, INPUT_BANDS), (shares, SHARES)):
                for at, name in enumerate(names):
                    into[at, place] = part.column(name).to_numpy(zero_copy_only=False)
        tokens = np.stack([np.bincount(token_of[np.flatnonzero(s)], minlength=side**2) for s in shares]) / TOKEN_PX**2
        kept = np.flatnonzero(tokens[0] + tokens[1] > 0)
        if len(kept):
            values = {"lake_id": lake_id, "year": year, "window_id": row * n_columns + column}
            arrays = {k: pa.array([v], pa.int32() if k == "year" else pa.int64()) for k, v in values.items()}
            arrays["pixels"] = pa.array([data.ravel()], pa.list_(pa.float32()))
            arrays["token_ids"] = pa.array([kept], pa.list_(pa.int32()))
            arrays |= {name: pa.array([tokens[at, kept]], pa.list_(pa.float64())) for at, name in enumerate(SHARES)}
            yield pa.RecordBatch.from_pydict(arrays)


def dense_tokens(pixels: DataFrame, encode: Callable, batch: int = 64) -> DataFrame:
    """Tokens of the windows of ``dense_windows`` with their shares and vectors.

    Windows are encoded where they are put together, ``batch`` at a time, so that no
    array of a window's pixels leaves its task.  ``encode`` is as for ``pooling.encoded``.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, windows = encode(), assembled(batches)
        while held := list(islice(windows, batch)):
            some = pa.Table.from_batches(held).combine_chunks()
            ids = some.column("token_ids").to_pylist()
            vectors = model([p.values.to_numpy() for p in some.column("pixels")], ids)
            which = np.repeat(np.arange(len(ids)), list(map(len, ids)))
            flat = lambda c: some.column(c).combine_chunks().flatten()
            columns = {c: some.column(c).combine_chunks().take(pa.array(which)) for c in (*KEYS, "window_id")}
            columns |= {"token_id": flat("token_ids")} | {c: flat(c) for c in SHARES}
            columns["vec"] = pa.array([np.asarray(v, np.float32) for own in vectors for v in own], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_pydict(columns)

    shares = ", ".join(f"{c} double" for c in SHARES)
    return placed(pixels).mapInArrow(read, f"lake_id long, year int, window_id long, token_id int, {shares}, vec array<float>")


def embedding_run_from_pixels(
    images: DataFrame,
    regions: DataFrame,
    pixels: DataFrame,
    encode: Callable,
    lake_weight: float = LAKE_WEIGHT,
    least: int = MIN_LAKE_PIXELS,
) -> DataFrame:
    """``runs.embedding_run`` from pixels on: windows, encoder, pooling, blend and merge.

    A site and year with fewer than ``least`` valid pixels of its lake gets no vectors
    and so is failed.
    """
    todo = runs.todo(images, regions).select(*KEYS)
    enough = pixels.groupBy(KEYS).agg(F.count_if(F.col("in_lake") & F.col("valid")).alias("n")).where(F.col("n") >= least)
    # shares of lake and shore count valid pixels only, so a token's valid share does not weigh in once more
    wanted = pixels.join(todo, KEYS, "left_semi").join(enough.select(*KEYS), KEYS, "left_semi")
    return runs.embedding_run(images, regions, dense_tokens(wanted, encode).withColumn("valid_frac", F.lit(1.0)), lake_weight)


def band_means() -> Callable:
    """A simple encoder: the means of a token's bands."""
    side = WINDOW_PX // TOKEN_PX

    def model(pixels: list, token_ids: list) -> list:
        out = []
        for flat, wanted in zip(pixels, token_ids):
            blocks = np.asarray(flat, np.float64).reshape(len(INPUT_BANDS), side, TOKEN_PX, side, TOKEN_PX)
            means = blocks.sum(axis=4).sum(axis=2) / TOKEN_PX**2
            out.append(means.reshape(len(INPUT_BANDS), -1).T[wanted])
        return out

    return model
