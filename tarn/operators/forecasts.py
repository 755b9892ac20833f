"""Forecasts from what analogs did next, by index and by embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.constants import (
    ANALOGS,
    ARROWS,
    FALLBACK_HORIZON,
    FALLBACK_THRESHOLDS,
    FEATURE_VERSION,
    HORIZON,
    HORIZONS,
    INDEX_LABELS,
    MIN_SAMPLES,
    MIN_TWINS,
    NOISE_SHARE,
    RANK_WEIGHTS,
    SIMILARITY_FLOOR,
)
from tarn.functions.checks import within
from tarn.functions.spectral import ECOLOGICAL, finite
from tarn.functions.vectors import rescaled
from tarn.operators.medians import exact_median

KEYS = tuple(ECOLOGICAL)


def ecological_indices(features: DataFrame) -> DataFrame:
    """``features`` with the five ecological indices of its mean bands."""
    bands = {c.removesuffix("_mean"): finite(F.col(c)) for c in features.columns if c.endswith("_mean")}
    return features.withColumns({name: index(bands) for name, index in ECOLOGICAL.items()})


def long_form(indexed: DataFrame) -> DataFrame:
    """(lake_id, year, index_name, value) of the ecological indices."""
    pairs = F.array(*(F.struct(F.lit(k).alias("index_name"), F.col(k).alias("value")) for k in KEYS))
    return indexed.select("lake_id", "year", F.inline(pairs))


def direction(score: Column, twins: Column, threshold: Column) -> Column:
    return (
        F.when(twins < MIN_TWINS, "uncertain")
        .when(score > threshold, "up")
        .when(score < -threshold, "down")
        .otherwise("stable")
    )


def yearly_changes(indexed: DataFrame, horizon: int) -> DataFrame:
    """(index_name, h, change): how far each index moves in 1 to ``horizon`` years.

    A site's years stand side by side in one list, as long as the calendar has
    years, so the table is shuffled once and not joined with itself.
    """
    years = indexed.groupBy("lake_id").agg(F.collect_list(F.struct("year", *KEYS)).alias("rows"))
    ahead = lambda a: F.filter("rows", lambda b: (b["year"] - a["year"]).between(1, horizon))
    moved = lambda a: F.transform(
        ahead(a), lambda b: F.struct((b["year"] - a["year"]).alias("h"), *(F.abs(b[k] - a[k]).alias(k) for k in KEYS))
    )
    pairs = years.select(F.inline(F.flatten(F.transform("rows", moved))))
    each = F.array(*(F.struct(F.lit(k).alias("index_name"), F.col(k).alias("change")) for k in KEYS))
    return pairs.select("h", F.inline(each)).where("change IS NOT NULL").select("index_name", "h", "change")


def noise_thresholds(features: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """(index_name, h, threshold, samples): half the median change in h years.

    Of current, completed rows; too few samples or no change give the fallback.
    """
    current = features.where((F.col("status") == "completed") & (F.col("feature_version") == FEATURE_VERSION))
    changes = exact_median(yearly_changes(ecological_indices(current), horizon), ["index_name", "h"], "change").select(
        "index_name", "h", F.col("median").alias("change"), F.col("n").alias("samples")
    )
    fallback = F.create_map(*(F.lit(x) for pair in FALLBACK_THRESHOLDS.items() for x in pair))
    grid = features.sparkSession.range(1, horizon + 1).select(
        F.explode(F.array(*map(F.lit, KEYS))).alias("index_name"), F.col("id").cast("int").alias("h")
    )
    usable = (F.col("samples") >= MIN_SAMPLES) & (F.col("change") > 0)
    return grid.join(changes, ["index_name", "h"], "left").select(
        "index_name",
        "h",
        F.when(usable, F.col("change") * NOISE_SHARE).otherwise(fallback[F.col("index_name")]).alias("threshold"),
        F.coalesce("samples", F.lit(0)).cast("long").alias("samples"),
    )


def latest_before(features: DataFrame, queries: DataFrame) -> DataFrame:
    """As of each query (lake_id, max_year), the site's last features up to then."""
    found = features.join(queries, "lake_id").where(F.col("year") <= F.col("max_year"))
    row = F.struct(*(c for c in features.columns if c != "lake_id"))
    return (
        found.groupBy("lake_id", "max_year")
        .agg(F.max_by(row, "year").alias("row"))
        .select("lake_id", "max_year", "row.*")
    )


def following_rows(features: DataFrame, starts: DataFrame) -> DataFrame:
    """Feature rows of each (lake_id, start_year) from that year on."""
    return features.join(starts, "lake_id").where(F.col("year") >= F.col("start_year"))


def candidates(analogs: DataFrame, site: int, num_analogs: int) -> DataFrame:
    """The first 2n of min(4n, 50) analogs, without the site itself, in order.

    The list is bounded by 50 rows, so one ordered window numbers it.
    """
    in_order = Window.orderBy(F.col("similarity_score").desc(), "lake_id")
    numbered = analogs.orderBy(F.col("similarity_score").desc(), "lake_id").limit(min(4 * num_analogs, 50))
    return (
        numbered.where(F.col("lake_id") != site)
        .withColumn("place", F.row_number().over(in_order))
        .where(F.col("place") <= 2 * num_analogs)
    )


def twin_deltas(
    analogs: DataFrame, features: DataFrame, site: int, num_analogs: int = 5, horizon: int = HORIZON
) -> DataFrame:
    """(rank, lake_id, matched_year, fixed_weight, index_name, h, delta) of twins.

    A twin is an analog with features in its matched year and a change from it
    in one of the next calendar years; ranks count twins only, and those past the
    fifth weigh nothing.
    """
    picked = candidates(analogs, site, num_analogs).select(
        "place", "lake_id", F.col("end_year").alias("matched_year"), "similarity_score"
    )
    near = features.join(F.broadcast(picked), "lake_id").withColumn("h", F.col("year") - F.col("matched_year"))
    pairs = F.array(*(F.struct(F.lit(k).alias("index_name"), F.col(k).alias("value")) for k in KEYS))
    own = Window.partitionBy("place", "index_name")
    deltas = (
        ecological_indices(near.where(F.col("h").between(0, horizon)))
        .select("place", "lake_id", "matched_year", "similarity_score", "h", F.inline(pairs))
        .withColumn("base", F.max(F.when(F.col("h") == 0, F.col("value"))).over(own))
        .withColumn("delta", F.col("value") - F.col("base"))
        .where((F.col("h") > 0) & F.col("delta").isNotNull())
    )
    weights = F.array(*map(F.lit, RANK_WEIGHTS))
    return (
        deltas.withColumn("rank", F.dense_rank().over(Window.orderBy("place")))
        .where(F.col("rank") <= num_analogs)
        .withColumn("fixed_weight", F.coalesce(F.get(weights, F.col("rank") - 1), F.lit(0.0)))
        .select("rank", "lake_id", "matched_year", "similarity_score", "fixed_weight", "index_name", "h", "delta")
    )


def contributions(deltas: DataFrame) -> DataFrame:
    """``deltas`` with each twin's weight among those that have the change."""
    there = F.sum("fixed_weight").over(Window.partitionBy("index_name", "h"))
    weight = F.when(there > 0, F.col("fixed_weight") / F.when(there > 0, there)).otherwise(0.0)
    return deltas.withColumn("normalized_weight", weight).withColumn(
        "weighted_contribution", F.col("normalized_weight") * F.col("delta")
    )


def ecological_forecast(
    analogs: DataFrame,
    features: DataFrame,
    site: int,
    anchor_year: int,
    num_analogs: int = 5,
    horizon: int = HORIZON,
) -> DataFrame:
    """One row per index and year ahead, with direction and expected value."""
    within("num_analogs", num_analogs, ANALOGS)
    within("horizon", horizon, HORIZONS)
    spark = features.sparkSession
    queries = spark.createDataFrame([(site, anchor_year)], "lake_id long, max_year int")
    current = long_form(ecological_indices(latest_before(features, queries))).select(
        "index_name", F.col("value").alias("current_value"), F.col("year").alias("current_year")
    )
    scores = (
        contributions(twin_deltas(analogs, features, site, num_analogs, horizon))
        .groupBy("index_name", "h")
        .agg(F.sum("weighted_contribution").alias("score"), F.count(F.lit(1)).alias("twins"))
    )
    score, twins = F.coalesce("score", F.lit(0.0)), F.coalesce("twins", F.lit(0))
    return (
        noise_thresholds(features, horizon)
        .join(F.broadcast(current), "index_name")
        .join(scores, ["index_name", "h"], "left")
        .select(
            "index_name",
            "h",
            (F.col("current_year") + F.col("h")).alias("forecast_year"),
            "current_value",
            score.alias("weighted_score"),
            twins.alias("twins_contributing"),
            "threshold",
            direction(score, twins, F.col("threshold")).alias("direction"),
            (F.col("current_value") + score).alias("expected_value"),
        )
    )


def nested_forecast(forecast: DataFrame) -> DataFrame:
    """One row per index with its years as a list, as a report shows it."""
    year = F.struct("forecast_year", "direction", "weighted_score", "twins_contributing", "expected_value", "threshold")
    return forecast.groupBy("index_name").agg(
        F.max("current_value").alias("current_value"), F.array_sort(F.collect_list(year)).alias("yearly_directions")
    )


def worded(column: Column, words: dict[str, str]) -> Column:
    """The words for a column's values; other values as they are."""
    pairs = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
    return F.coalesce(F.element_at(pairs, column), column)


def forecast_audit(forecast: DataFrame, contributed: DataFrame | None = None) -> DataFrame:
    """``forecast`` with a sentence for each row.

    ``contributed``, from ``contributions``, adds what each twin adds, by rank.
    """
    twins = F.lit("")
    if contributed is not None:
        one = F.format_string(
            "Twin#%d(Δ=%+.4f, w=%.2f [fixed %.2f])", F.col("rank").cast("int"), "delta", "normalized_weight", "fixed_weight"
        )
        lists = contributed.groupBy("index_name", "h").agg(F.array_sort(F.collect_list(F.struct("rank", one.alias("said")))).alias("_twins"))
        forecast = forecast.join(lists, ["index_name", "h"], "left")
        twins = F.coalesce(F.concat(F.lit(" ["), F.array_join("_twins.said", ", "), F.lit("]")), F.lit(""))
    audit = F.concat(
        F.format_string(
            "%s @ %d: %s (%s) — weighted score = %+.6f (threshold ±%.6f), %d twin(s) contributing",
            worded(F.col("index_name"), INDEX_LABELS),
            F.col("forecast_year").cast("int"),
            worded(F.col("direction"), ARROWS),
            "direction",
            "weighted_score",
            "threshold",
            "twins_contributing",
        ),
        twins,
        F.lit("."),
    )
    return forecast.withColumn("audit", audit).drop("_twins")


def analog_weights(analogs: DataFrame, method: str) -> DataFrame:
    """``analogs`` with weights that sum to 1; equal ones if their scores do not count."""
    score = F.col("similarity_score")
    raw = {
        "cosine": score,
        "euclidean": 1 / (1 + (1 / F.greatest(score, F.lit(1e-9)) - 1)),
        "knn": F.lit(1.0),
    }[method]
    every = Window.partitionBy()
    sum_ = F.sum("raw_weight").over(every)
    share = F.when(sum_ > 0, F.col("raw_weight") / F.when(sum_ > 0, sum_))
    equal = 1 / F.count(F.lit(1)).over(every)
    return analogs.withColumn("raw_weight", raw).withColumn("weight", F.coalesce(share, equal)).drop("raw_weight")


def embedding_analogs(analogs: DataFrame, records: DataFrame, site: int, num_analogs: int, horizon: int) -> DataFrame:
    """The first analogs with ``horizon`` records after their matched window."""
    near = F.broadcast(candidates(analogs, site, num_analogs))
    after = (
        records.join(near, "lake_id")
        .where(F.col("year") > F.col("end_year"))
        .groupBy("place")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= horizon)
    )
    return near.join(after, "place").orderBy("place").limit(num_analogs).drop("n")


def embedding_forecast(
    analogs: DataFrame,
    records: DataFrame,
    site: int,
    anchor_year: int,
    method: str = "cosine",
    num_analogs: int = 5,
    horizon: int = HORIZON,
) -> DataFrame:
    """(forecast_year, at, value): the weighted mean of the analogs' next records.

    The h-th year ahead takes each analog's h-th following record.
    """
    within("num_analogs", num_analogs, ANALOGS)
    within("horizon", horizon, HORIZONS)
    chosen = analog_weights(embedding_analogs(analogs, records, site, num_analogs, horizon), method)
    next_ = Window.partitionBy("place").orderBy("year")
    future = (
        records.join(F.broadcast(chosen.select("place", "lake_id", "end_year", "weight")), "lake_id")
        .where(F.col("year") > F.col("end_year"))
        .withColumn("h", F.row_number().over(next_))
        .where(F.col("h") <= horizon)
    )
    return (
        future.select("h", "weight", F.posexplode("embedding").alias("at", "x"))
        .groupBy("h", "at")
        .agg((F.sum(F.col("weight") * F.col("x").cast("double")) / F.sum("weight")).alias("value"))
        .select((F.lit(anchor_year) + F.col("h")).alias("forecast_year"), "at", "value")
    )


def forecast_confidence(chosen: DataFrame, anchor_year: int, method: str, horizon: int = HORIZON) -> DataFrame:
    """(forecast_year, confidence): the weighted score, less for years farther on.

    ``chosen`` has weights; without a row the years ahead get the fallback's.
    """
    overall = chosen.agg(
        F.round(rescaled(F.sum(F.col("weight") * F.col("similarity_score")), method, SIMILARITY_FLOOR), 3).alias("overall")
    )
    years = chosen.sparkSession.range(1, max(horizon, FALLBACK_HORIZON) + 1).select(F.col("id").cast("int").alias("h"))
    near = F.col("overall") * F.greatest(F.lit(0.3), 1 - (F.col("h") - 1) * 0.08)
    none = F.greatest(F.lit(0.05), 0.3 - (F.col("h") - 1) * 0.04)
    known = F.col("overall").isNotNull()
    return (
        years.join(F.broadcast(overall))
        .where(F.col("h") <= F.when(known, horizon).otherwise(FALLBACK_HORIZON))
        .select((F.lit(anchor_year) + F.col("h")).alias("forecast_year"), F.round(F.when(known, near).otherwise(none), 3).alias("confidence"))
    )


def empty_forecasts(anchors: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """``empty_forecast`` of each (lake_id, anchor_year)."""
    years = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")
    return anchors.select("lake_id", "anchor_year", years).select(
        "lake_id",
        F.explode(F.array(*map(F.lit, KEYS))).alias("index_name"),
        (F.col("anchor_year") + F.col("h")).cast("int").alias("forecast_year"),
        F.lit("uncertain").alias("direction"),
        F.lit(0.0).alias("weighted_score"),
        F.lit(0).alias("twins_contributing"),
    )


def empty_forecast(spark, anchor_year: int, horizon: int = HORIZON) -> DataFrame:
    """The forecast without twins: every index and year is uncertain."""
    return spark.range(1, horizon + 1).select(
        F.explode(F.array(*map(F.lit, KEYS))).alias("index_name"),
        (F.lit(anchor_year) + F.col("id")).cast("int").alias("forecast_year"),
        F.lit("uncertain").alias("direction"),
        F.lit(0.0).alias("weighted_score"),
        F.lit(0).alias("twins_contributing"),
    )
