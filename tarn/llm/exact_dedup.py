"""Exact deduplication by recipes of content-defined chunks.

A text without its blanks is cut where a gear rolling hash hits a pattern, and
is from then on its recipe: the ordered list of its chunks' digests.  Only the
recipes, a few bytes a kilobyte, are grouped.  Where recipes are equal, the
chunks behind them are compared byte by byte, once; should two contents share a
digest, the identifier is extended by the content's rank, so identifiers stay
verified whatever the digest's length.

Defined cases: a null text is an empty one; texts of blanks only equal the
empty text; a null id is the smallest; of rows with the same id, length and
normalised text, all carry ``kept`` and ``distinct_documents`` returns one; an
empty table gives no rows; other columns are ignored.  A long text is read whole;
its hashes are found a slice at a time, and its recipe grows with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import among, chosen, cut, in_batches
from tarn.llm.text_bytes import BLANKS, gear_hits, slices, texts

#: Bytes of a chunk: least, about the mean above it (a power of two), and most.
LEAST, MEAN, MOST = 512, 2048, 16384


def chunk_ends(data: list[bytes]) -> list[list[int]]:
    """Where the chunks of each text of a slice end."""
    hits = gear_hits(b"".join(data), MEAN.bit_length() - 1)
    out: list[list[int]] = []
    begin = 0
    for text in data:
        n = len(text)
        ends, at = [], 0
        own = hits[np.searchsorted(hits, begin) : np.searchsorted(hits, begin + n)] - begin
        while n - at > LEAST:
            i = np.searchsorted(own, at + LEAST)
            end = min(int(own[i]) if i < len(own) else n, at + MOST, n)
            ends.append(end)
            at = end
        if at < n:
            ends.append(n)
        out.append(ends)
        begin += n
    return out


def bare_slices(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first, last, texts without blanks) of runs of rows of bounded size."""
    data = texts(column)
    for first, last in slices(data):
        yield first, last, [x.translate(None, BLANKS) for x in data[first:last]]


def digest(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def recipes(rows: DataFrame, digest_bytes: int) -> DataFrame:
    """Per row of (row_key, doc_id, n_chars, mark, text): its recipe and SHA-256."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, hashes = [], []
            for _, _, data in bare_slices(batch.column(4)):
                for text, ends in zip(data, chunk_ends(data)):
                    lists.append([digest(text[a:b], digest_bytes) for a, b in zip([0, *ends[:-1]], ends)])
                hashes += [hashlib.sha256(x).hexdigest() for x in data]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(lists, pa.list_(pa.binary())), pa.array(hashes, pa.string())],
                ["row_key", "doc_id", "n_chars", "mark", "recipe", "text_sha256"],
            )

    return rows.mapInArrow(
        read,
        "row_key long, doc_id long, n_chars long, mark long, recipe array<binary>, text_sha256 string",
    )


def contents(rows: DataFrame, digest_bytes: int) -> DataFrame:
    """The chunks themselves: (row_key, position, digest, content)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, last, data in bare_slices(batch.column(1)):
                out = []
                for key, text, ends in zip(keys[first:last], data, chunk_ends(data)):
                    for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
                        out.append((key, i, digest(text[a:b], digest_bytes), text[a:b]))
                types = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                columns = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)], ["row_key", "position", "digest", "content"]
                )

    return rows.mapInArrow(read, "row_key long, position int, digest binary, content binary")


def by_recipe(listed: DataFrame) -> DataFrame:
    """Per recipe: group_size, and the row that stays.

    Written once, so that joins with it are of two shuffled sides: a recipe that a
    third of all rows share is then split by adaptive execution.
    """
    best = F.min(F.struct((-F.col("n_chars")).alias("short"), "doc_id", "mark")).alias("best")
    return cut(
        listed.groupBy("recipe")
        .agg(F.count("*").alias("group_size"), best)
        .select("recipe", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.mark").alias("keep_mark"))
    )


def verified(rows: DataFrame, listed: DataFrame, digest_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(listed, groups) with recipes whose identifiers each stand for one content.

    Only texts whose recipe another row shares need their chunks compared.  The
    distinct (digest, content) pairs are found by a partial aggregation, so a
    chunk that half of all rows share costs one row a task.
    """
    groups = by_recipe(listed)
    shared = groups.where("group_size > 1").select("recipe")
    suspects = cut(listed.join(shared, "recipe", "left_semi").select("row_key").distinct())
    chunks = contents(among(rows.select("row_key", "text"), suspects, "row_key"), digest_bytes)
    variants = chunks.select("digest", "content").distinct()
    clashes = cut(variants.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    if clashes.isEmpty():
        return listed, groups
    rank = Window.partitionBy("digest").orderBy("content")
    ranked = variants.join(clashes, "digest").withColumn("rank", F.row_number().over(rank))
    marks = (
        chunks.join(ranked, ["digest", "content"])
        .select("row_key", "position", "rank")
        .distinct()
        .groupBy("row_key")
        .agg(F.array_sort(F.collect_list(F.struct("position", "rank"))).alias("marks"))
    )
    tail = F.transform("marks", lambda m: F.encode(F.concat_ws(":", m["position"], m["rank"]), "UTF-8"))
    extended = cut(
        listed.join(marks, "row_key", "left")
        .withColumn("recipe", F.when(F.col("marks").isNull(), F.col("recipe")).otherwise(F.concat("recipe", tail)))
        .select(*listed.columns)
    )
    return extended, by_recipe(extended)


def recipe_groups(
    docs: DataFrame, id_col: str, text_col: str, digest_bytes: int = 16
) -> tuple[DataFrame, DataFrame]:
    """(listed, groups): every row with its recipe, and every recipe."""
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col)
    rows = in_batches(docs).select(
        F.xxhash64(doc_id, text).alias("row_key"),
        doc_id.alias("doc_id"),
        F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"),
        F.xxhash64(text).alias("mark"),
        text.alias("text"),
    )
    return verified(rows, cut(recipes(rows, digest_bytes)), digest_bytes)


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 16
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Of equal texts, the longest original stays, then the smallest id.
    """
    listed, groups = recipe_groups(docs, id_col, text_col, digest_bytes)
    return listed.join(groups, "recipe").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        "n_chars",
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but one row of each group of equal texts."""
    _, groups = recipe_groups(docs, id_col, text_col)
    keys = groups.select(F.col("keep_id").alias("doc_id"), F.col("keep_mark").alias("mark"))
    return chosen(docs, keys, id_col, text_col)
