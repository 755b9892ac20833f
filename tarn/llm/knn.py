"""Exact top-k by inner product with KD-trees, a tree per shard.

Shards are parts of space: planes at the medians of a bounded sample cut it into
cells, every vector goes to its cell, and each cell has a tight box around all of
its vectors; cells with more than a shard's vectors are dealt into several.  A
shard's tree splits at the median of the widest dimension down to small leaves, and
each node keeps the tight box of its vectors.  A query visits nodes best first by the
largest inner product that a box allows, and stops when no box can reach its k-th
best score.  First it asks one shard of the cell whose box promises most; the k-th
score found there goes on to the others, and cells whose box cannot reach it are
not asked.

Queries travel in blocks of bounded size; a block meets a shard at most once in
each of the two rounds.  The driver holds the sample and a box for each cell.

Defined cases: vectors that are null, or hold null or non-finite components,
take no part; vectors of different length have no product and do not meet; an
empty vector scores 0 with empty ones; a row is no candidate for a query of the
same id, and candidates that repeat an id are rows of their own; a query that
repeats id and vector is asked once, and queries of one id share one list; null
ids take no part; an empty table gives no rows; very long vectors are held whole,
a shard of them in a task; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import cut

#: Vectors of a shard; queries of a block; vectors of a leaf; cells, and the sample
#: that their planes are fitted on.
SHARD, BLOCK, LEAF, CELLS, SAMPLE = 2048, 1024, 128, 256, 16384


def by_width(column: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, rows, vectors) of each length of vector in a column."""
    widths = column.map(len).to_numpy()
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        yield int(width), rows, np.array(column.iloc[rows].tolist(), np.int64).reshape(len(rows), -1)


class Planes:
    """Median planes that part the vectors of one width into cells."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.nodes: list[tuple[int, int, int, int] | int] = []
        self.cells = 0
        self._part(sample, levels)

    def _part(self, sample: np.ndarray, levels: int) -> int:
        node = len(self.nodes)
        self.nodes.append(0)
        spread = sample.max(axis=0) - sample.min(axis=0) if sample.size else np.zeros(0)
        if levels and spread.any():
            axis = int(np.argmax(spread))
            column = np.sort(sample[:, axis])
            middle = column[len(column) // 2]
            at = int(middle if middle > column[0] else column[column > column[0]][0])
            below = sample[:, axis] < at
            left = self._part(sample[below], levels - 1)
            self.nodes[node] = (axis, at, left, self._part(sample[~below], levels - 1))
        else:
            self.nodes[node] = self.cells
            self.cells += 1
        return node

    def cells_of(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros(len(vectors), np.int32)
        waiting = [(0, np.arange(len(vectors)))]
        while waiting:
            node, rows = waiting.pop()
            if isinstance(self.nodes[node], int):
                out[rows] = self.nodes[node]
                continue
            axis, at, left, right = self.nodes[node]
            below = vectors[rows, axis] < at
            waiting += [(left, rows[below]), (right, rows[~below])]
        return out


class Tree:
    """A KD-tree whose nodes are slices of the reordered vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.arange(len(ids))
        self.low, self.high, self.slices, self.children = [], [], [], []
        self._grow(vectors, order, 0, len(order))
        self.ids, self.vectors = ids[order], vectors[order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, vectors: np.ndarray, order: np.ndarray, first: int, last: int) -> int:
        """Add the node of ``order[first:last]`` and those below it."""
        node = len(self.slices)
        part = vectors[order[first:last]]
        low, high = part.min(axis=0), part.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.slices.append((first, last))
        self.children.append(None)
        if last - first > LEAF and len(low) and (high > low).any():
            widest = int(np.argmax(high - low))
            middle = (first + last) // 2
            split = np.argpartition(part[:, widest], middle - first)
            order[first:last] = order[first:last][split]
            left = self._grow(vectors, order, first, middle)
            self.children[node] = (left, self._grow(vectors, order, middle, last))
        return node

    def search(self, query_id: int, query: np.ndarray, k: int, floor: int):
        """The k best (score, id) of candidates that score ``floor`` or more."""
        bounds = np.where(query > 0, self.high, self.low) @ query
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        kth = floor
        waiting = [(-bounds[0], 0)]
        while waiting:
            bound, node = heapq.heappop(waiting)
            if -bound < kth:
                break
            if self.children[node]:
                for child in self.children[node]:
                    if bounds[child] >= kth:
                        heapq.heappush(waiting, (-bounds[child], child))
                continue
            first, last = self.slices[node]
            scores = self.vectors[first:last] @ query
            for i in np.flatnonzero(scores >= kth):
                if self.ids[first + i] == query_id:
                    continue
                item = (scores[i], -self.ids[first + i])
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                kth = max(floor, best[0][0])
        return [(int(score), int(-minus)) for score, minus in best]


def exact_type(vectors: np.ndarray, queries: np.ndarray) -> type:
    """A type in which the integer products are exact: doubles where they fit."""
    top = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0))
    if top * max(1, vectors.shape[1]) < 2**53:
        return np.float64
    return np.int64 if top * max(1, vectors.shape[1]) < 2**62 else object


def best_of_shard(k: int):
    """Search one shard's tree for one block of queries."""

    def search(key, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            vectors = np.array(rows["vector"].tolist(), np.int64).reshape(len(rows), -1)
            queries = np.array(asked["query"].tolist(), np.int64).reshape(len(asked), -1)
            kind = exact_type(vectors, queries)
            tree = Tree(rows["vec_id"].to_numpy(), vectors.astype(kind))
            for query_id, query, floor in zip(asked["query_id"], queries.astype(kind), asked["floor"]):
                out += [(query_id, i, score) for score, i in tree.search(query_id, query, k, int(floor))]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return search


def planes_of(usable: DataFrame, n: int) -> dict[int, Planes]:
    """Planes by width, fitted on at most ``SAMPLE`` vectors; other widths have one cell."""
    levels = max(0, math.ceil(math.log2(max(1, min(CELLS, n / SHARD)))))
    if not levels:
        return {}
    rows = usable.select("vector").sample(min(1.0, 1.2 * SAMPLE / n), seed=7).limit(SAMPLE).toPandas()
    return {width: Planes(vectors, levels) for width, _, vectors in by_width(rows["vector"])}


def placed(usable: DataFrame, planes: dict[int, Planes]) -> DataFrame:
    """``usable`` (vec_id, vector, row) with width and cell."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, length = np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int32)
            for width, rows, vectors in by_width(batch["vector"]):
                length[rows] = width
                if width in planes:
                    cell[rows] = planes[width].cells_of(vectors)
            yield batch.assign(width=length, cell=cell)

    return usable.mapInPandas(assign, "vec_id long, vector array<long>, row long, width int, cell int")


def boxes_of(rows: DataFrame) -> dict[int, pd.DataFrame]:
    """By width a frame of cells: how many vectors, and the tight box around them."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for (width, cell), own in batch.groupby(["width", "cell"]):
                vectors = np.array(own["vector"].tolist(), np.int64).reshape(len(own), -1)
                out.append((width, cell, vectors.min(axis=0).tolist(), vectors.max(axis=0).tolist()))
            yield pd.DataFrame(out, columns=["width", "cell", "low", "high"])

    of_batch = rows.select("width", "cell", "vector").mapInPandas(parts, "width int, cell int, low array<long>, high array<long>")
    sides = (
        of_batch.select("width", "cell", F.posexplode(F.arrays_zip("low", "high")).alias("at", "side"))
        .groupBy("width", "cell", "at")
        .agg(F.min("side.low").alias("low"), F.max("side.high").alias("high"))
        .groupBy("width", "cell")
        .agg(F.array_sort(F.collect_list(F.struct("at", "low", "high"))).alias("sides"))
    )
    counted = rows.groupBy("width", "cell").agg(F.count(F.lit(1)).alias("n"))
    none = F.array().cast("array<long>")
    both = counted.join(sides, ["width", "cell"], "left").select(
        "width", "cell", "n", F.coalesce("sides.low", none).alias("low"), F.coalesce("sides.high", none).alias("high")
    )
    found = both.toPandas().sort_values(["width", "cell"])
    found["shards"] = -(-found["n"] // SHARD)
    return {int(width): own.reset_index(drop=True) for width, own in found.groupby("width")}


def promises(queries: np.ndarray, boxes: pd.DataFrame) -> np.ndarray:
    """The largest product that each cell's box allows each query."""
    low, high = (np.array(boxes[side].tolist(), np.int64).reshape(len(boxes), -1) for side in ("low", "high"))
    kind = exact_type(np.concatenate([low, high]), queries)
    low, high, queries = low.astype(kind), high.astype(kind), queries.astype(kind)
    return np.where(queries > 0, queries, 0) @ high.T + np.where(queries < 0, queries, 0) @ low.T


def addressed(asked: DataFrame, boxes: dict[int, pd.DataFrame]) -> DataFrame:
    """``asked`` with width, the cell that promises most, and the cells that can reach ``floor``."""

    def address(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for width, rows, queries in by_width(batch["query"]):
                cells, bound = boxes[width]["cell"].to_numpy(), promises(queries, boxes[width])
                own = batch.iloc[rows]
                near = bound >= own["floor"].to_numpy()[:, None]
                yield own.assign(width=width, best=cells[bound.argmax(axis=1)], cells=[cells[n.astype(bool)] for n in near])

    schema = "query_id long, query array<long>, block int, floor long, width int, best int, cells array<int>"
    return asked.select("query_id", "query", "block", "floor").mapInPandas(address, schema)


def top_k(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best for each id divisible by ``every``.

    A component x counts as floor(scale * x).  Ties go to the smaller id.
    """
    x = F.col(vector_col)
    fits = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf"))
    )
    usable = vectors.where(fits).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long")).alias("vector"),
        F.monotonically_increasing_id().alias("row"),
    )
    whole = cut(placed(usable, planes_of(usable, usable.count())))
    boxes = boxes_of(whole)
    sizes = whole.sparkSession.createDataFrame(
        [(w, int(c), int(s)) for w, own in boxes.items() for c, s in zip(own["cell"], own["shards"])], "width int, cell int, shards int"
    )
    sharded = whole.join(F.broadcast(sizes), ["width", "cell"]).select(
        "vec_id", "vector", "width", "cell", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int").alias("shard")
    )
    asked = whole.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")).distinct()
    blocks = max(1, -(-asked.count() // BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    place = ["width", "cell", "shard"]

    def searched(to: DataFrame) -> DataFrame:
        """Each shard with each block of queries that asks it."""
        to, keys = cut(to), [*place, "block"]
        wanted = to.select(*(F.col(c).alias(c) for c in keys)).distinct()
        return (
            sharded.join(wanted, place)
            .groupBy(keys)
            .cogroup(to.groupBy(keys))
            .applyInPandas(best_of_shard(k), "query_id long, vec_id long, score long")
        )

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    least = F.lit(-(2**63))
    to_best = addressed(asked.withColumn("floor", least), boxes).withColumnsRenamed({"best": "cell"}).withColumn("shard", F.lit(0)).drop("cells")
    first = cut(searched(to_best))
    floors = (
        first.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") == k)
        .select("query_id", F.col("score").alias("kth"))
    )
    ready = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("kth", least))
    to_others = (
        addressed(ready, boxes)
        .withColumn("cell", F.explode("cells"))
        .join(F.broadcast(sizes), ["width", "cell"])
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        .where((F.col("cell") != F.col("best")) | (F.col("shard") != 0))
        .drop("cells", "best", "shards")
    )
    rest = searched(to_others)
    return (
        first.union(rest)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
