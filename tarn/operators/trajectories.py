"""Analog search: sliding windows of consecutive records against a trajectory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.constants import MAX_TOP_K, SIMILARITY_FLOOR, TOP_K, TOP_KS, WINDOW
from tarn.functions.checks import within
from tarn.functions.vectors import cosine, distance, dot, matrix, pair_scores, rescaled

#: Sites of a block that meet a block of queries, and places that scores count to.
BLOCK, DIGITS = 256, 12


def query_trajectory(records: DataFrame, site: int, anchor_year: int, window: int = WINDOW) -> DataFrame:
    """One row (trajectory, n): the site's last records up to its anchor year.

    No row if the site has no record in that very year.
    """
    own = records.where((F.col("lake_id") == site) & (F.col("year") <= anchor_year))
    last = own.orderBy(F.col("year").desc()).limit(window)
    return (
        last.agg(
            F.transform(F.array_sort(F.collect_list(F.struct("year", "embedding"))), lambda r: r["embedding"]).alias(
                "trajectory"
            ),
            F.max("year").alias("anchor"),
            F.count(F.lit(1)).alias("n"),
        )
        .where(F.col("anchor") == anchor_year)
        .select("trajectory", "n")
    )


def record_scores(records: DataFrame, trajectory: list[list[float]], method: str) -> DataFrame:
    """(lake_id, year, scores): each record's similarity with the trajectory's vectors.

    One matrix step a batch; a record without a vector of that width has no scores.
    """
    queries = np.array(trajectory, np.float64)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, rows = matrix(batch.column(2), queries.shape[1])
            found = np.stack([pair_scores(rows, q, method) for q in queries], axis=1) if len(rows) else np.empty((0, len(queries)))
            sizes = np.where(mask, len(queries), 0)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            scores = pa.ListArray.from_arrays(offsets, pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], scores], ["lake_id", "year", "scores"])

    kinds = {c: records.schema[c].dataType.simpleString() for c in ("lake_id", "year")}
    schema = ", ".join(f"{c} {kind}" for c, kind in kinds.items()) + ", scores array<double>"
    return records.select("lake_id", "year", "embedding").mapInArrow(read, schema)


def scored_windows(records: DataFrame, trajectory: DataFrame, method: str, window: int = WINDOW) -> DataFrame:
    """(lake_id, start_year, end_year, raw_score) of all windows of all sites.

    Each record meets the trajectory's vectors in one pass; a window adds its
    records' entries up by ``lead``, so a site is shuffled once.  A trajectory of
    another length than ``window`` scores 0.  ``trajectory`` is at most one row of
    ``window`` vectors, which the driver hands to the tasks.
    """
    in_order = Window.partitionBy("lake_id").orderBy("year")
    asked = trajectory.first()
    if asked is None:
        years = records.schema["year"].dataType.simpleString()
        return records.limit(0).selectExpr(
            "lake_id", "year AS start_year", f"CAST(year AS {years}) AS end_year", "CAST(0 AS double) AS raw_score"
        )
    each = record_scores(records, asked["trajectory"], method)
    entry = lambda k: F.lead(F.try_element_at("scores", F.lit(k + 1)), k).over(in_order)
    score = sum((entry(k) for k in range(1, window)), F.try_element_at("scores", F.lit(1))) / window
    return (
        each.select(
            "lake_id",
            F.col("year").alias("start_year"),
            F.lead("year", window - 1).over(in_order).alias("end_year"),
            (score if asked["n"] == window else F.lit(0.0)).alias("raw_score"),
        )
        .where(F.col("end_year").isNotNull())
    )


def best_windows(windows: DataFrame, *keys: str) -> DataFrame:
    """Each site's best window; the first on ties."""
    best = F.max_by(
        F.struct("start_year", "end_year", "raw_score"), F.struct("raw_score", -F.col("start_year"))
    ).alias("best")
    return windows.groupBy(*keys, "lake_id").agg(best).select(*keys, "lake_id", "best.*")


def analogs(
    records: DataFrame, site: int, anchor_year: int, method: str = "cosine", top_k: int = TOP_K
) -> DataFrame:
    """The ``top_k`` sites whose past is most like the site's recent years.

    Ranked by the score as shown, so what lies below its floor ties, and ties go
    by site: columns lake_id, start_year, end_year, raw_score, similarity_score.
    """
    within("top_k", top_k, (TOP_KS[0], float("inf")))
    windows = scored_windows(
        records.where(F.col("lake_id") != site), query_trajectory(records, site, anchor_year), method
    )
    return (
        best_windows(windows)
        .withColumn("similarity_score", rescaled(F.col("raw_score"), method, SIMILARITY_FLOOR))
        .orderBy(F.col("similarity_score").desc(), "lake_id")
        .limit(min(top_k, MAX_TOP_K))
    )


#: Pairs of a query and a site that are scored by differences at once.
PAIRS = 4096


def near_scores(records: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, float]:
    """Euclidean similarity of each record with each query by one matrix product, and how far it may be off.

    A square of lengths is off by its rounding, so a distance by that one's root at
    most.  Infinite where squares are no numbers.
    """
    ours, theirs = (records**2).sum(axis=1), (queries**2).sum(axis=1)
    most = max(ours.max(initial=0), theirs.max(initial=0))
    if not np.isfinite(most):
        return np.zeros((len(records), len(queries))), np.inf
    square = ours[:, None] + theirs[None, :]
    square -= 2 * (records @ queries.T)
    np.sqrt(np.maximum(square, 0, out=square), out=square)
    square += 1
    off = np.sqrt(8 * (records.shape[1] + 4) * np.finfo(float).eps * most) + 10.0**-DIGITS
    return np.divide(1, square, out=square), float(off)


def block_scores(records: np.ndarray, queries: np.ndarray, method: str) -> np.ndarray:
    """Similarity of each record with each query vector, to ``DIGITS`` places.

    So equal vectors tie, in whatever order a product was summed.
    """
    if method == "euclidean":
        out = np.stack([pair_scores(records, q, method) for q in queries], axis=1)
    elif method == "knn":
        out = (records @ queries.T + 1) / 2
    else:
        size = np.sqrt((records**2).sum(axis=1))[:, None] * np.sqrt((queries**2).sum(axis=1))[None, :]
        out = np.where(size == 0, 1.0, records @ queries.T / np.where(size == 0, 1.0, size))
    return np.round(out, DIGITS)


def spread_rows(rows: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Rows at the places that ``mask`` marks, NaN elsewhere."""
    out = np.full((len(mask), rows.shape[1]), np.nan)
    out[mask] = rows
    return out


def exact_windows(records: np.ndarray, queries: np.ndarray, first: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean scores of windows that start at records ``first`` against trajectories ``query``, by differences."""
    added = np.zeros(len(first))
    for k in range(WINDOW):
        gap = records[first + k] - queries[query * WINDOW + k]
        added += np.round(1 / (1 + np.sqrt((gap**2).sum(axis=1))), DIGITS)
    return added / WINDOW


def best_of_block(method: str, top_k: int):
    """Of one block of queries, the best sites of one block of sites.

    Distances come from one matrix product; sites that may then be among the best are
    scored anew by differences, so that equal vectors tie.
    """

    def search(sites: pa.Table, queries: pa.Table) -> pa.Table:
        names = ("query_id", "lake_id", "start_year", "end_year", "raw_score")
        out, found = [], []
        if len(sites) and len(queries):
            sites = sites.sort_by([("lake_id", "ascending"), ("year", "ascending")])
            queries = queries.sort_by([("query_id", "ascending"), ("asked_year", "ascending")])
            width = len(queries.column("vector")[0])
            mask, rows = matrix(sites.column("embedding").combine_chunks(), width)
            asked, vectors = matrix(queries.column("vector").combine_chunks(), width)
            scores, off = np.full((len(sites), len(queries)), np.nan), 0.0
            if method == "euclidean":
                scores[np.ix_(mask, asked)], off = near_scores(rows, vectors)
            else:
                scores[np.ix_(mask, asked)] = block_scores(rows, vectors, method)
            site, year = sites.column("lake_id").to_numpy(), sites.column("year").to_numpy()
            query = queries.column("query_id").to_numpy()[::WINDOW]
            last = max(len(sites) - WINDOW + 1, 0)
            added = sum(scores[k : last + k, k::WINDOW] for k in range(WINDOW)) / WINDOW
            whole = np.flatnonzero(site[:last] == site[WINDOW - 1 :])
            added = added[whole]
            firsts = np.flatnonzero(np.concatenate(([True], np.diff(site[whole]) != 0))) if len(whole) else whole
            if len(whole):
                best = np.fmax.reduceat(added, firsts, axis=0)
                own = site[whole[firsts]]
                floor = 0.0 if method == "euclidean" else SIMILARITY_FLOOR
                if method == "euclidean":
                    spread = [spread_rows(v, m) for v, m in ((rows, mask), (vectors, asked))]
                    score = lambda i, j: exact_windows(*spread, i, j)
                else:
                    score = lambda i, j: added[np.searchsorted(whole, i), j]
                able = np.where(np.isnan(best) | (own[:, None] == query[None, :]), -np.inf, np.clip((best - floor) / (1 - floor), 0, 1))
                kth = np.partition(able, -min(top_k, len(own)), axis=0)[-min(top_k, len(own))]
                which, asking = np.nonzero((able >= kth - 2 * off) & (able > -np.inf))
                ends = np.append(firsts[1:], len(whole))
                for first in range(0, len(which), PAIRS):
                    i, j = which[first : first + PAIRS], asking[first : first + PAIRS]
                    n = ends[i] - firsts[i]
                    starts = np.cumsum(n) - n
                    at = whole[np.repeat(firsts[i] - starts, n) + np.arange(n.sum())]
                    raw = score(at, np.repeat(j, n))
                    top = np.fmax.reduceat(raw, starts)
                    place = np.minimum.reduceat(np.where(raw == np.repeat(top, n), at, len(site)), starts)
                    real = ~np.isnan(top)
                    i, j, top, place = i[real], j[real], top[real], place[real]
                    found.append((query[j], own[i], year[place], year[place + WINDOW - 1], top, np.clip((top - floor) / (1 - floor), 0, 1)))
        if found:
            query, own, start, end, raw, shown = map(np.concatenate, zip(*found))
            order = np.lexsort((own, -shown, query))
            place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
            kept = order[place < top_k]
            out = [c[kept] for c in (query, own, start, end, raw)]
        columns = out or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, kinds)})

    return search


def all_analogs(records: DataFrame, anchor_year: int, method: str = "cosine", top_k: int = TOP_K) -> DataFrame:
    """Analogs of every site at once: (query_id, rank, lake_id, ...).

    Sites and queries are dealt into blocks of about ``BLOCK``; a block of sites
    meets a block of queries in one matrix product, and only the ``top_k`` of each
    query leave the task.
    """
    top_k = min(top_k, MAX_TOP_K)
    records = records.select(F.col("lake_id").cast("long"), F.col("year").cast("int"), "embedding")
    recent = Window.partitionBy("lake_id").orderBy(F.col("year").desc())
    whole = Window.partitionBy("lake_id")
    queries = (
        records.where(F.col("year") <= anchor_year)
        .withColumn("back", F.row_number().over(recent))
        .where(F.col("back") <= WINDOW)
        .withColumns({"n": F.count(F.lit(1)).over(whole), "anchor": F.max("year").over(whole)})
        .where((F.col("anchor") == anchor_year) & (F.col("n") == WINDOW))
        .select(F.col("lake_id").alias("query_id"), F.col("year").alias("asked_year"), F.col("embedding").alias("vector"))
    )
    blocks = max(1, -(-records.select("lake_id").distinct().count() // BLOCK))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    left = records.select("lake_id", "year", "embedding", dealt("lake_id").alias("sites"), every.alias("asked"))
    right = queries.select("query_id", "asked_year", "vector", dealt("query_id").alias("asked"), every.alias("sites"))
    place = Window.partitionBy("query_id").orderBy(F.col("similarity_score").desc(), "lake_id")
    return (
        left.groupBy("sites", "asked")
        .cogroup(right.groupBy("sites", "asked"))
        .applyInArrow(best_of_block(method, top_k), "query_id long, lake_id long, start_year int, end_year int, raw_score double")
        .withColumn("similarity_score", rescaled(F.col("raw_score"), method, SIMILARITY_FLOOR))
        .withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= top_k)
    )


def centred(records: DataFrame) -> DataFrame:
    """``records`` with the mean vector of all taken from each, so that what all
    sites share no longer hides their differences."""
    width = F.posexplode("embedding").alias("at", "x")
    mean = (
        records.select(width)
        .groupBy("at")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda r: r["m"]).alias("mean"))
    )
    return (
        records.join(F.broadcast(mean))
        .withColumn("embedding", F.zip_with("embedding", "mean", lambda x, m: x.cast("double") - m))
        .drop("mean")
    )


#: Order and shown score of a single vector, by method: smaller distances first.
NEAREST = {
    "cosine": lambda a, b: (1 - cosine(a, b), cosine(a, b)),
    "l2": lambda a, b: (distance(a, b), 1 / (1 + distance(a, b))),
    "ip": lambda a, b: (-dot(a, b), dot(a, b)),
}


def nearest_vectors(
    vectors: DataFrame,
    query: list[float],
    method: str = "cosine",
    top_k: int = TOP_K,
    exclude: int | None = None,
    year: int | None = None,
    id_col: str = "vec_id",
) -> DataFrame:
    """(id, score) of the vectors nearest to one vector."""
    some = vectors.where(F.col("embedding").isNotNull())
    some = some if exclude is None else some.where(F.col(id_col) != exclude)
    some = some if year is None else some.where(F.col("year") == year)
    far, score = NEAREST[method](F.col("embedding"), F.array(*map(F.lit, query)))
    return (
        some.select(id_col, score.alias("score"), far.alias("far"))
        .orderBy("far", id_col)
        .limit(min(top_k, MAX_TOP_K))
        .select(id_col, "score")
    )


#: Vectors and queries of the blocks that meet.
VECTORS, QUERIES = 4096, 1024


def nearest_of_block(method: str, top_k: int):
    """Of one block of vectors, the nearest to each of one block of queries."""

    def search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(vectors) and len(queries):
            width = len(queries.column("query")[0])
            usable, rows = matrix(vectors.column("vector").combine_chunks(), width)
            asked, wanted = matrix(queries.column("query").combine_chunks(), width)
            ids = vectors.column("id").to_numpy()[usable]
            scores = np.round(rows @ wanted.T, DIGITS) if method == "ip" else block_scores(rows, wanted, {"l2": "euclidean"}.get(method, method))
            for q, column in zip(queries.column("query_id").to_numpy()[asked], scores.T):
                able = np.flatnonzero((ids != q) & ~np.isnan(column))
                if len(able) > top_k:
                    kth = np.partition(-column[able], top_k - 1)[top_k - 1]
                    able = able[-column[able] <= kth]
                best = able[np.lexsort((ids[able], -column[able]))][:top_k]
                found.append((np.full(len(best), q), ids[best], column[best]))
        parts = [np.concatenate(p) for p in zip(*found)] if found else [[], [], []]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table({n: pa.array(p, t) for n, p, t in zip(("query_id", "id", "score"), parts, kinds)})

    return search


def nearest_to_each(
    vectors: DataFrame, queries: DataFrame, method: str = "cosine", top_k: int = TOP_K, id_col: str = "vec_id"
) -> DataFrame:
    """(query_id, rank, id, score): the nearest of all vectors to each query's.

    Both tables have ``id_col`` and embedding; a query does not find its own id, and
    vectors of other widths, null or with NaN take no part.  Blocks of vectors meet
    blocks of queries in one matrix product, and only ``top_k`` of each leave it.
    Scores count to ``DIGITS`` places; ties go to the smaller id.
    """
    within("top_k", top_k, TOP_KS)
    ready = lambda df, name, vector: df.where(F.col(id_col).isNotNull() & (F.size("embedding") > 0)).select(
        F.col(id_col).cast("long").alias(name), F.col("embedding").alias(vector), F.size("embedding").alias("width")
    )
    rows, asked = ready(vectors, "id", "vector"), ready(queries, "query_id", "query")
    many, few = (max(1, -(-df.count() // size)) for df, size in ((rows, VECTORS), (asked, QUERIES)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("*", dealt("id", many).alias("part"), every(few).alias("block"))
    right = asked.select("*", dealt("query_id", few).alias("block"), every(many).alias("part"))
    keys = ["part", "block", "width"]
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return (
        left.groupBy(keys)
        .cogroup(right.groupBy(keys))
        .applyInArrow(nearest_of_block(method, top_k), "query_id long, id long, score double")
        .withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= top_k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )
