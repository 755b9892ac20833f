"""Vector math on array columns, in double precision."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda held, x: held + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, not at each mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    gap = lambda x, y: x.cast("double") - y.cast("double")
    return F.sqrt(total(F.transform(F.zip_with(a, b, gap), lambda d: d * d)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 1 where a vector is zero."""
    return let(norm(a) * norm(b), lambda size: F.when(size == 0, 1.0).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0))))


#: Similarity of a pair of vectors, by method.
PAIR = {
    "cosine": cosine,
    "euclidean": lambda a, b: 1 / (1 + distance(a, b)),
    "knn": lambda a, b: (dot(a, b) + 1) / 2,
}


def clipped(score: Column) -> Column:
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def rescaled(score: Column, method: str, floor: float) -> Column:
    """The score as shown: from the floor up for cosine and knn, clipped."""
    return clipped(score) if method == "euclidean" else clipped((score - floor) / (1 - floor))


def unit(a: Column) -> Column:
    """``a`` at length 1 in single precision; null if it has no usable length."""

    def scaled(v: Column, length: Column) -> Column:
        usable = (length > 1e-12) & ~F.isnan(length) & (length != float("inf"))
        return F.when(usable, F.transform(v, lambda x: (x.cast("double") / length).cast("float")))

    return let(a, lambda v: let(norm(v), lambda length: scaled(v, length)))


def blend(lake: Column, shore: Column, weight: Column) -> Column:
    """Unit vector between lake and shore; the lake's own where there is no shore."""
    mixed = F.zip_with(lake, shore, lambda x, y: weight * x.cast("double") + (1 - weight) * y.cast("double"))
    return F.when(shore.isNull(), unit(lake)).otherwise(unit(mixed))


def parsed(text: Column) -> Column:
    """A vector from text like ``[0.1,2]``; null if it is none."""
    return F.from_json(F.when(text.rlike(r"^\s*\[.*\]\s*$"), text), "array<double>")


def rendered(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))


def checked(a: Column, width: int) -> Column:
    """``a``, or an error where its width is another or a value is not finite."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    fits = a.isNull() | ((F.size(a) == width) & finite)
    return F.when(F.assert_true(fits, f"a vector of {width} finite numbers is expected").isNull(), a)


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(usable, vectors): which rows of a list column hold ``width`` numbers, and those as doubles."""
    usable = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    values = column.filter(usable).flatten()
    rows = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    mask = usable.to_numpy(zero_copy_only=False).astype(bool)
    if values.null_count:
        whole = ~values.is_null().to_numpy(zero_copy_only=False).reshape(-1, width).any(axis=1)
        mask[mask] = whole
        rows = rows[whole]
    return mask, rows


def pair_scores(rows: np.ndarray, query: np.ndarray, method: str) -> np.ndarray:
    """Similarity of each row with one vector; equal rows have equal scores to the last bit."""
    if method == "euclidean":
        return 1 / (1 + np.sqrt(((rows - query) ** 2).sum(axis=1)))
    dots = (rows * query).sum(axis=1)
    if method == "knn":
        return (dots + 1) / 2
    size = np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum())
    return np.where(size == 0, 1.0, dots / np.where(size == 0, 1.0, size))
