"""Exact medians of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Steps by which values are counted, to a factor of e; the step of 0.
STEPS, ZERO = 1000, -(2**31)


def exact_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median, n) of a column of numbers from 0 up, without nulls.

    The first pass counts values by steps of about a thousandth of their size,
    with partial sums; the second counts the values of the one or two steps of a
    group that hold its middle.  A double has at most 1.5 million
    steps, so no task holds all of a group's values, and ``keys``
    may have few groups.  ``rows`` is read twice.
    """
    v = F.col(value).cast("double")
    stepped = rows.select(*keys, v.alias("v"), F.when(v > 0, F.floor(F.log(v) * STEPS)).otherwise(F.lit(ZERO)).alias("step"))
    whole, ordered = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("step")
    reached = F.col("below") + F.col("held")
    middle = (
        stepped.groupBy(*keys, "step")
        .agg(F.count(F.lit(1)).alias("held"))
        .withColumns({"n": F.sum("held").over(whole), "below": F.sum("held").over(ordered) - F.col("held")})
        .withColumns({"lower": F.floor((F.col("n") + 1) / 2), "upper": F.floor(F.col("n") / 2) + 1})
        .where((F.col("lower").between(F.col("below") + 1, reached)) | (F.col("upper").between(F.col("below") + 1, reached)))
        .drop("held")
    )
    in_step = Window.partitionBy(*keys, "step").orderBy("v")
    counted = stepped.join(middle, [*keys, "step"]).groupBy(*keys, "step", "n", "below", "lower", "upper", "v").agg(F.count(F.lit(1)).alias("same"))
    upto = F.col("below") + F.col("passed")
    holds = lambda place: F.max(F.when((F.col(place) > upto - F.col("same")) & (F.col(place) <= upto), F.col("v")))
    return (
        counted.withColumn("passed", F.sum("same").over(in_step))
        .groupBy(*keys)
        .agg(((holds("lower") + holds("upper")) / 2).alias("median"), F.first("n").alias("n"))
    )
