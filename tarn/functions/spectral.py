"""Spectral and ecological indices as column expressions.

``INDICES`` takes reflectances by band name; a new index is one more entry.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.constants import EPSILON, MNDWI_WATER, NDVI_VEGETATION, NDVI_WATER, NDWI_WATER

Bands = Mapping[str, Column]


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom; 0 where the divisor is next to nothing, null with null."""
    return F.when(F.abs(bottom) > EPSILON, top / F.when(F.abs(bottom) > EPSILON, bottom)).when(
        bottom.isNotNull() & top.isNotNull(), 0.0
    )


def contrast(a: str, b: str) -> Callable[[Bands], Column]:
    return lambda x: ratio(x[a] - x[b], x[a] + x[b])


def _evi(x: Bands) -> Column:
    return 2.5 * ratio(x["b8"] - x["b4"], x["b8"] + 6.0 * x["b4"] - 7.5 * x["b2"] + 1.0)


def _savi(x: Bands) -> Column:
    return ratio((x["b8"] - x["b4"]) * 1.5, x["b8"] + x["b4"] + 0.5)


def _msavi(x: Bands) -> Column:
    lead = 2.0 * x["b8"] + 1.0
    root = lead * lead - 8.0 * (x["b8"] - x["b4"])
    return (lead - F.sqrt(F.when(root > 0, root).when(root.isNotNull(), 0.0))) / 2.0


def _awei(x: Bands) -> Column:
    return 4.0 * (x["b3"] - x["b11"]) - (0.25 * x["b8"] + 2.75 * x["b12"])


def _bsi(x: Bands) -> Column:
    bare, green = x["b11"] + x["b4"], x["b8"] + x["b2"]
    return ratio(bare - green, bare + green)


INDICES: dict[str, Callable[[Bands], Column]] = {
    "ndvi": contrast("b8", "b4"),
    "evi": _evi,
    "savi": _savi,
    "msavi": _msavi,
    "gci": lambda x: ratio(x["b8"], x["b3"]) - 1.0,
    "ndre": contrast("b8a", "b5"),
    "ndwi": contrast("b3", "b8"),
    "mndwi": contrast("b3", "b11"),
    "ndmi": contrast("b8", "b11"),
    "awei": _awei,
    "nbr": contrast("b8", "b12"),
    "nbr2": contrast("b11", "b12"),
    "bsi": _bsi,
    "ndbi": contrast("b11", "b8"),
}

#: Indices of a site and year, from its mean band values.
ECOLOGICAL: dict[str, Callable[[Bands], Column]] = {
    "ndci": contrast("b5", "b4"),
    "ndvi": contrast("b8", "b4"),
    "ndwi": contrast("b3", "b8"),
    "turbidity": contrast("b4", "b3"),
    "red_edge_slope": lambda x: (x["b7"] - x["b5"]) / 10000.0 / 78.0 * 100.0,
}


def finite(value: Column) -> Column:
    """``value``, null where it is no finite number."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def pixel_class(x: Bands) -> Column:
    """water, vegetation or soil, in this order of precedence."""
    ndvi, ndwi, mndwi = (INDICES[i](x) for i in ("ndvi", "ndwi", "mndwi"))
    water = (mndwi > MNDWI_WATER) | ((ndwi > NDWI_WATER) & (ndvi < NDVI_WATER))
    return F.when(water, "water").when(ndvi > NDVI_VEGETATION, "vegetation").otherwise("soil")
