"""Registration of queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.plans.views import load, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, *inputs: str):
    """Register a function of (spark, inputs...) under its name.

    ``inputs`` name the tables and views it gets; ``sql`` has the same rows.
    """

    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(spark, *(load(spark, sf_dir, name) for name in inputs))

        run.__doc__ = function.__doc__
        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLES[function.__name__] = oracle(sql)
        return function

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Double columns rounded, all of them unless some are named."""
    wanted = columns or tuple(c for c, kind in df.dtypes if kind == "double")
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in wanted})


def long(column: str) -> Column:
    return F.col(column).cast("long").alias(column)
