"""Quality by votes of nearest labelled neighbours in a latent space.

A text is described by two lists of terms, hashed to a fixed number of columns: runs
of three bytes, and runs of three shapes.  A shape is a class of letters, a mark, a
blank or a line's end, and letters of a word that equals the one before or after it
have a shape of their own; equal shapes side by side count once.  A term weighs the
root of its share of the text's terms, times how rare it is in the sample; either list
has length 1.  The sample's largest singular vectors make up the latent space.

Latent vectors of length 1 are rounded to whole numbers of 1/``GRID``, so products of
them are exact in any order of summation, and so are neighbours and votes.  The labelled
vectors, ``SAMPLE`` a class at most, are handed to every task; a document's products
with all of them are found in blocks of ``BLOCK`` documents.  The ``NEIGHBOURS`` best
(more if tied with the last) vote with their similarity, each class by its share of
the sample.

Bounds, for the fit alone: ``SAMPLE`` labelled documents a class, by a hash of their
id.  The score is 0.3 at the vote that parts the sample's documents best, each voted on
by the others.

Defined cases: a null text is an empty one, and empty texts are terms of their own,
as a text begins and ends a line; a long text is read whole, a slice at a time; rows
with a null id are neither held out nor learned from; labels other than 0 and 1 and
null ones are not learned from, and of different labels of one id each counts; where
a class has no label every score is 0 or 1, that of the other class, and 0 without
any labels; equal rows score alike; an empty table gives no rows; other columns are
ignored, and kept by ``of_quality``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import crc_mod, cut, in_batches
from tarn.llm.text_bytes import IS_BLANK, hashed, parts

#: Labelled documents of a class that are learned from.
SAMPLE = 1500
#: Columns of byte runs and of shape runs; latent dimensions; steps of a component.
BYTE_TERMS, SHAPE_TERMS, DIMENSIONS, GRID = 2048, 1024, 64, 2048
#: Neighbours that vote, and documents whose products are held at once.
NEIGHBOURS, BLOCK = 15, 256
#: The score of the vote that parts the classes best.
CUT = 0.3
#: Bytes of a text that are counted at once, and rounds of the power iteration.
SLICE, ROUNDS = 1 << 20, 4
#: A share of good documents lost counts so many times that of bad ones kept.
KEEP = 2.0

TERMS = BYTE_TERMS + SHAPE_TERMS
#: Shapes: blank, line end, lower-case letter, capital, digit, letter beyond ASCII, letter of a repeated word, and every mark.
BLANK, LINE, LOWER, UPPER, DIGIT, BEYOND, REPEATED, MARK = range(8)
SHAPES = 48


def shape_table() -> np.ndarray:
    """The shape of each byte."""
    table = np.full(256, BEYOND, np.int64)
    table[:128] = MARK
    table[IS_BLANK] = BLANK
    table[ord("\n")] = LINE
    table[ord("a") : ord("z") + 1] = LOWER
    table[ord("A") : ord("Z") + 1] = UPPER
    table[ord("0") : ord("9") + 1] = DIGIT
    marks = [b for b in range(33, 127) if table[b] == MARK]
    table[marks] = MARK + 1 + np.arange(len(marks))
    return table


SHAPE = shape_table()


def buckets(codes: np.ndarray, size: int) -> np.ndarray:
    """Counts of codes by a hash of each, in ``size`` columns, a power of two."""
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return np.bincount((mixed >> np.uint64(65 - size.bit_length())).astype(np.int64), minlength=size)


def shapes(part: bytes) -> np.ndarray:
    """Shapes of some bytes, one for each run of equal ones."""
    data = np.frombuffer(part, np.uint8)
    shape = SHAPE[data]
    blank = IS_BLANK[data]
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    if len(starts) > 1:
        words, _ = hashed([part])
        same = words[1:] == words[:-1]
        again = np.concatenate((same, [False])) | np.concatenate(([False], same))
        begins = np.zeros(len(data), np.int64)
        begins[starts] = 1
        shape[again[np.maximum(np.cumsum(begins) - 1, 0)] & ~blank] = REPEATED
    return shape[np.concatenate(([True], shape[1:] != shape[:-1]))]


def term_counts(text: bytes) -> np.ndarray:
    """How often the text has the terms of each column."""
    out = np.zeros(TERMS, np.int64)
    for part in parts(b"\n" + text + b"\n", SLICE):
        data = np.frombuffer(part, np.uint8).astype(np.int64)
        out[:BYTE_TERMS] += buckets(data[:-2] << 16 | data[1:-1] << 8 | data[2:], BYTE_TERMS)
        own = shapes(part)
        out[BYTE_TERMS:] += buckets((own[:-2] * SHAPES + own[1:-1]) * SHAPES + own[2:], SHAPE_TERMS)
        if len(own) < 3:
            out[BYTE_TERMS:] += buckets(own, SHAPE_TERMS)
    return out


def weighed(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Rows of counts as rows of weights; both lists of length 1, or 0 if empty."""
    out = np.sqrt(counts) * rarity
    for columns in (slice(0, BYTE_TERMS), slice(BYTE_TERMS, TERMS)):
        size = np.sqrt((out[:, columns] ** 2).sum(axis=1, keepdims=True))
        out[:, columns] /= np.where(size > 0, size, 1)
    return out


def latent(counts: np.ndarray, rarity: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Latent vectors of length 1 in whole steps of 1/``GRID``."""
    rows = weighed(counts, rarity) @ axes
    size = np.sqrt((rows**2).sum(axis=1, keepdims=True))
    return np.rint(rows / np.where(size > 0, size, 1) * GRID)


def singular_axes(rows: np.ndarray, most: int) -> np.ndarray:
    """The right singular vectors of the largest singular values, as columns.

    Subspace iteration from fixed numbers; each has its largest component positive,
    and all are rounded, so that the last bits of a sum do not count.
    """
    most = min(most, *rows.shape)
    base = np.random.default_rng(20240607).standard_normal((rows.shape[1], min(most + 16, *rows.shape)))
    for _ in range(ROUNDS):
        base, _ = np.linalg.qr(rows.T @ (rows @ base))
    _, _, inner = np.linalg.svd(rows @ base, full_matrices=False)
    axes = base @ inner[:most].T
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return np.round(axes * signs, 7)


def votes(products: np.ndarray, good: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Each row's vote, from 0 to 1: the good neighbours' part of the similarity.

    ``share`` is what a labelled vector weighs for its class.
    """
    k = min(NEIGHBOURS, products.shape[1])
    last = np.partition(products, products.shape[1] - k, axis=1)[:, -k][:, None]
    near = np.where((products >= last) & (products > 0), products, 0.0) * share
    total = near.sum(axis=1)
    return np.where(total > 0, (near * good).sum(axis=1) / np.where(total > 0, total, 1), good @ share)


def best_cut(found: np.ndarray, good: np.ndarray) -> float:
    """The vote that parts good and bad best; of equally good places the middle one."""
    order = np.argsort(found, kind="stable")
    steps, good = found[order], good[order]
    lost = np.concatenate(([0], np.cumsum(good))) / good.sum()
    kept = 1 - np.concatenate(([0], np.cumsum(1 - good))) / (1 - good).sum()
    places = np.concatenate(([True], steps[1:] != steps[:-1], [True]))
    wrong = np.where(places, KEEP * lost + kept, np.inf)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    edges = np.concatenate(([0.0], (steps[1:] + steps[:-1]) / 2, [1.0]))
    return float(np.clip(edges[best].mean(), 1e-6, 1 - 1e-6))


class Voters:
    """Labelled latent vectors, and the vote that parts their classes."""

    def __init__(self, counts: np.ndarray, good: np.ndarray):
        self.good = good.astype(np.float64)
        self.one_class = None if len(set(good.tolist())) == 2 else float(good[0]) if len(good) else 0.0
        if self.one_class is not None:
            return
        in_texts = (counts > 0).sum(axis=0)
        self.rarity = np.log((1 + len(counts)) / (1 + in_texts)) + 0.05
        self.axes = singular_axes(weighed(counts, self.rarity), DIMENSIONS)
        self.vectors = latent(counts, self.rarity, self.axes)
        self.share = np.where(good == 1, 0.5 / good.sum(), 0.5 / (1 - good).sum())
        found = []
        for first in range(0, len(counts), BLOCK):
            products = self.vectors[first : first + BLOCK] @ self.vectors.T
            at = np.arange(len(products))
            products[at, first + at] = -np.inf
            found.append(votes(products, self.good, self.share))
        self.cut = best_cut(np.concatenate(found), self.good)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """A score from 0 to 1 for each text; ``CUT`` where the classes part."""
        if self.one_class is not None:
            return np.full(len(texts), self.one_class)
        out = []
        for first in range(0, len(texts), BLOCK):
            counts = np.array([term_counts(t) for t in texts[first : first + BLOCK]])
            products = latent(counts, self.rarity, self.axes) @ self.vectors.T
            out.append(votes(products, self.good, self.share))
        found = np.concatenate(out) if out else np.empty(0)
        above = CUT + (1 - CUT) * (found - self.cut) / (1 - self.cut)
        return np.clip(np.where(found < self.cut, CUT * found / self.cut, above), 0, 1)


def trained(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Voters:
    """Voters from the labels of documents that are not held out.

    The driver holds the terms of ``SAMPLE`` documents a class.
    """
    doc_id = F.col(id_col).cast("long")
    known = (
        labels.select(doc_id.alias("doc_id"), F.col(label_col).cast("int").alias("good"))
        .where((crc_mod(F.col("doc_id"), 5) != 0) & F.col("good").isin(0, 1))
        .distinct()
    )
    ids = [known.where(F.col("good") == mark).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for mark in (0, 1)]
    chosen = F.broadcast(cut(ids[0].union(ids[1])))
    rows = in_batches(docs).select(doc_id.alias("doc_id"), F.col(text_col).alias("text")).join(chosen, "doc_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, good, text in zip(*(batch.column(c) for c in ("doc_id", "good", "text"))):
                counts = term_counts((text.as_py() or "").encode("utf-8", "surrogatepass"))
                columns = np.flatnonzero(counts)
                arrays = [pa.array([doc_id.as_py()]), pa.array([good.as_py()], pa.int32())]
                lists = [pa.array([columns], pa.list_(pa.int64())), pa.array([counts[columns]], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays + lists, ["doc_id", "good", "columns", "counts"])

    found = (
        rows.mapInArrow(read, "doc_id long, good int, columns array<long>, counts array<long>")
        .orderBy("doc_id", "good", "columns", "counts")
        .toArrow()
    )
    counts = np.zeros((len(found), TERMS), np.int32)
    for at, (columns, own) in enumerate(zip(found.column("columns"), found.column("counts"))):
        counts[at, columns.values.to_numpy()] = own.values.to_numpy()
    return Voters(counts, found.column("good").to_numpy())


def scored(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    voters = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, id_col, text_col, label_col))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = voters.value.scores([x or b"" for x in batch.column(2).cast(pa.binary()).to_pylist()])
            arrays = [pa.array(score), pa.array((score >= CUT).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *arrays], ["doc_id", "held_out", "score", "predicted"])

    doc_id = F.col(id_col).cast("long")
    rows = docs.select(
        doc_id.alias("doc_id"),
        F.coalesce(crc_mod(doc_id, 5) == 0, F.lit(False)).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    return rows.mapInArrow(read, "doc_id long, held_out boolean, score double, predicted int")


def of_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """``docs`` without the rows whose text is predicted to be bad, row by row."""
    voters = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, id_col, text_col, label_col))
    place = docs.columns.index(text_col)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = voters.value.scores([x or b"" for x in batch.column(place).cast(pa.binary()).to_pylist()])
            yield batch.filter(pa.array(score >= CUT, pa.bool_()))

    return docs.mapInArrow(good, docs.schema)
