"""Language identification by rank-order profiles.

A language's profile is the ``PROFILE`` most frequent letter n-grams of its
training texts, in order; a document's is the same of its own text.  The distance
sums, over the document's n-grams, how far each is out of place in the language's
order; one that the language lacks costs ``PROFILE``.  The nearest language wins,
the smaller name on ties.

N-grams are of one to three letters, in lower case, with one blank at either end
of a word; anything but letters separates words.  Counts are of all training
texts, summed per task before they shuffle; the driver sees the profiles only.

Defined cases: a null text, or one without letters, is ``und`` with score 0, and
so is every text where no language could be learned; rows with a null id are
neither held out nor learned from; rows with a null lang are not learned from;
equal rows are predicted alike; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import crc_mod

#: N-grams of a profile.
PROFILE = 300
#: Characters of a text that are counted at once.
BLOCK = 1 << 20
#: Distinct n-grams that a task holds before it passes its sums on.
HELD = 1 << 19
BLANK = 32

_tables: dict[str, np.ndarray] = {}


def is_letter() -> np.ndarray:
    """Whether a code point is a letter, built once a worker."""
    if "letter" not in _tables:
        _tables["letter"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _tables["letter"]


def folded(text: str) -> np.ndarray:
    """Code points of the words of a text, with one blank around each."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = is_letter()[points]
    wanted = letter.copy()
    wanted[:-1] |= letter[1:]
    wanted[1:] |= letter[:-1]
    points = np.where(letter, points, BLANK)[wanted]
    double = np.zeros(len(points), bool)
    double[1:] = (points[1:] == BLANK) & (points[:-1] == BLANK)
    return points[~double]


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the n-grams of a text, by code; 21 bits a letter."""
    points = folded(text)
    codes, counts = [], []
    for first in range(0, len(points), BLOCK):
        part = points[first : first + BLOCK + 2]
        own = min(BLOCK, len(part))
        a, b, c = part[:own], part[1 : own + 1], part[2 : own + 2]
        pairs = (a[: len(b)] << 21) | b
        triples = (pairs[: len(c)] << 21) | c
        grams = np.concatenate((a[a != BLANK], pairs, triples[b[: len(c)] != BLANK]))
        grams.sort()
        starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.empty(0, int)
        codes.append(grams[starts])
        counts.append(np.diff(starts, append=len(grams)))
    return summed(codes, counts)


def summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of several lists added up by code."""
    if len(codes) == 1:
        return codes[0], counts[0]
    if not codes:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    every, number = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, number = every[order], number[order]
    starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.empty(0, int)
    return every[starts], np.add.reduceat(number, starts) if len(starts) else number


def ranked(text: str, most: int) -> np.ndarray:
    """Codes of the most frequent n-grams of a text, in order; ties by code."""
    codes, counts = counted(text)
    return codes[np.argsort(-counts, kind="stable")[:most]]


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) of rows of (lang, text), partly summed."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}
        size = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang, (codes, counts) in held.items():
                grams, n = summed(codes, counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n.astype(np.int64))],
                    ["lang", "gram", "n"],
                )
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes, counts = counted(text.as_py())
                lists = held.setdefault(lang, ([], []))
                lists[0].append(codes)
                lists[1].append(counts)
                size += len(codes)
                if size > 4 * HELD:
                    for own in held.values():
                        grams, n = summed(*own)
                        own[0][:], own[1][:] = [grams], [n]
                    size = sum(len(own[0][0]) for own in held.values())
                    if size > HELD:
                        yield from passed_on()
                        size = 0
        yield from passed_on()

    return rows.mapInArrow(read, "lang string, gram long, n long")


def profiles(train: DataFrame, most: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's codes in order, learned from rows of (lang, text)."""
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    rows = (
        gram_counts(train.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text"))
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= most)
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("place", "gram"))).alias("grams"))
        .orderBy("lang")
        .collect()
    )
    return {r["lang"]: np.array([g["gram"] for g in r["grams"]], np.int64) for r in rows}


def distances(own: np.ndarray, known: list[tuple[np.ndarray, np.ndarray]], most: int) -> list[float]:
    """Out-of-place distance of a ranked list to each profile, from 0 to 1."""
    places = np.arange(len(own))
    out = []
    for codes, ranks in known:
        at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
        off = np.where(codes[at] == own, np.minimum(np.abs(ranks[at] - places), most), most)
        out.append(float(off.sum()) / (len(own) * most))
    return out


def predicted(
    docs: DataFrame,
    learned: dict[str, np.ndarray],
    most: int = PROFILE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    names = list(learned)
    known = []
    for codes in learned.values():
        order = np.argsort(codes)
        known.append((codes[order], order))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores = [], []
            for text in batch.column(2):
                own = ranked(text.as_py() or "", most)
                if len(own) and known:
                    far = distances(own, known, most)
                    best = int(np.argmin(far))
                    found.append(names[best])
                    scores.append(1.0 - far[best])
                else:
                    found.append("und")
                    scores.append(0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    doc_id = F.col(id_col).cast("long")
    rows = docs.select(
        doc_id.alias("doc_id"),
        F.coalesce(crc_mod(doc_id, 5) == 0, F.lit(False)).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    return rows.mapInArrow(read, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(
    docs: DataFrame,
    most: int = PROFILE,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Learn from the documents that are not held out, and predict all."""
    train = docs.where(crc_mod(F.col(id_col).cast("long"), 5) != 0).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    return predicted(docs, profiles(train, most), most, id_col, text_col)
