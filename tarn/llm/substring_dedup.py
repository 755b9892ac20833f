"""Passages that repeat across documents, by content-defined chunks.

A gear hash rolls over the bytes and forgets what is ``GEAR_BYTES`` back.  A word is
a cut point where its hash is the least of some ``WINDOW`` words on end, so the
cut points follow the content alone: inside an equal passage they are the same
whatever stands around it, and an insertion moves those next to it only.  A chunk
reaches from a cut point to the first one ``chunk_words`` words on or more; chunks
start at every cut point, so they vary in length and overlap.  Chunks are
deduplicated by a digest of 128 bits: one in more than one document is a repeat.  A
document's repeated chunks that touch are merged into spans, which are returned.

Cut points are nowhere more than ``WINDOW`` words apart.  In a passage, those of the
first two words may depend on the bytes before it and those of the last word on what
comes after.  With 20 words a chunk, of a passage of 51 words at least 25 lie in a span,
whatever its words; a span reaches over the passage only where what is around repeats
as well.

Defined cases: null and empty texts and those of fewer words hold no chunk; rows of
one id count as one document, so a text that repeats under one id does not repeat;
rows with a null id are told apart by text, come after all ids, and keep a null
id; ids are taken to lie within 2**62; of words with equal hashes the next word's
decides, and of two such places in a window, as in a text of a short period, the later
one is the cut point; a long text is read in parts that overlap;
an empty table gives no rows; other columns are ignored, or kept by
``without_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import cut, in_batches, unused
from tarn.llm.text_bytes import BLANK, BYTE, GEAR, IS_BLANK, SLICE, mix, powers, slices, texts

#: Words on end of which the one with the least hash is a cut point.
WINDOW = 8
#: Bytes that the rolling hash remembers, a power of two.
GEAR_BYTES = 4
#: Words by which the parts of a long text overlap: more than a chunk and two windows.
OVERLAP = 128
#: Keys from here on are of rows without an id.
NO_ID = 1 << 62


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of the words of a text; a blank is put behind it."""
    joined = np.frombuffer(data + b" ", np.uint8)
    blank = IS_BLANK[joined]
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    ends = np.flatnonzero(blank & np.concatenate(([False], ~blank[:-1])))
    return joined, starts, ends


def cut_points(joined: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words of texts, each of the words bounds[i] to bounds[i + 1], that are cut points."""
    rolling = GEAR[joined]
    width = 1
    while width < GEAR_BYTES:
        rolling[width:] = rolling[width:] + (rolling[:-width] << np.uint32(width))
        width *= 2
    n = len(ends)
    # Of words with equal hashes the next word decides, then the later one comes first:
    # never the place in the slice, which depends on what else is read.
    own = mix(rolling[ends - 1].astype(np.uint64)) >> np.uint64(32)
    ranks = own << np.uint64(32) | np.append(own[1:], np.uint64(0))
    least = np.arange(n)
    for ahead in range(1, WINDOW):
        rival = np.arange(ahead, n)
        less = ranks[rival] <= ranks[least[: n - ahead]]
        least[: n - ahead][less] = rival[less]
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    stays = np.zeros(n, bool)
    stays[least[left >= WINDOW]] = True
    return np.flatnonzero(stays)


def digests(joined: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each run of bytes from a head to a tail, as two numbers."""
    up, down = powers(len(joined) + 1)
    length = (tails - heads).astype(np.uint64)
    out = []
    for values in (BYTE, mix(BYTE)):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[joined] * up[:-1], dtype=np.uint64)))
        out.append(mix((sums[tails] - sums[heads]) * down[heads] + length).view(np.int64))
    return out[0], out[1]


def chunks(data: list[bytes], n_words: int) -> tuple[np.ndarray, ...]:
    """(text, digest, digest, start, end, first word, last word) of the chunks of texts."""
    joined, starts, ends = word_bounds(b" ".join(data))
    begins = np.cumsum([0, *(len(x) + 1 for x in data)])
    bounds = np.searchsorted(starts, begins)
    points = cut_points(joined, ends, bounds) if len(ends) else np.empty(0, np.int64)
    which = np.searchsorted(bounds, points, "right") - 1
    until = np.searchsorted(points, points + n_words)
    whole = until < len(points)
    whole[whole] = which[until[whole]] == which[whole]
    first, last, which = points[whole], points[until[whole]] - 1, which[whole]
    one, two = digests(joined, starts[first], ends[last])
    same = (np.diff(which) == 0) & (one[1:] == one[:-1]) & (two[1:] == two[:-1]) & (first[1:] <= last[:-1] + 1)
    opens, closes = np.append(True, ~same)[: len(first)], np.append(~same, True)[: len(first)]
    first, last, which = first[opens], last[closes], which[opens]
    offset = begins[which]
    return which, one[opens], two[opens], starts[first] - offset, ends[last] - offset, first - bounds[which], last - bounds[which]


def overlapping(text: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(byte, word, part) of a long text: where each of its parts begins."""
    at, word = 0, 0
    while True:
        blank = BLANK.search(text, at + SLICE)
        end = blank.start() if blank else len(text)
        yield at, word, text[at:end]
        if end == len(text):
            return
        _, starts, _ = word_bounds(text[at:end])
        back = max(len(starts) - OVERLAP, 1)
        word += min(back, len(starts))
        at = at + int(starts[back]) if back < len(starts) else end


def occurrences(rows: DataFrame, n_words: int, with_places: bool) -> DataFrame:
    """Per chunk of (row_key, text): row_key and digest, and its place if asked."""

    def found(data: list[bytes]) -> tuple[np.ndarray, ...]:
        if len(data) > 1 or len(data[0]) <= SLICE:
            return chunks(data, n_words)
        every = []
        for byte, word, part in overlapping(data[0]):
            which, one, two, start, end, first, last = chunks([part], n_words)
            every.append((which, one, two, start + byte, end + byte, first + word, last + word))
        return tuple(map(np.concatenate, zip(*every)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            data = texts(batch.column(1))
            for first, last in slices(data):
                which, one, two, *places = found(data[first:last])
                arrays = [pa.array(keys[first + which], pa.int64()), pa.array(one), pa.array(two)]
                if with_places:
                    start, end, first_word, last_word = (x.astype(np.int64) for x in places)
                    arrays += [pa.array(start << 32 | first_word), pa.array((end - start) << 32 | (last_word - first_word))]
                yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    names = ["row_key", "digest", "digest2", "where", "reach"]
    places = ", where long, reach long" if with_places else ""
    return rows.mapInArrow(read, "row_key long, digest long, digest2 long" + places)


def unpacked(found: DataFrame) -> DataFrame:
    """Places of chunks, which travel as two numbers of 32 bits in one."""
    high, low = lambda c: F.shiftright(c, 32), lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1))
    return found.withColumns(
        {
            "start": high("where"),
            "end": high("where") + high("reach"),
            "first_word": low("where"),
            "last_word": low("where") + low("reach"),
        }
    ).drop("where", "reach")


def key_of(doc_id: Column, text: Column) -> Column:
    """The id, or a number above all ids that the text decides."""
    return F.coalesce(doc_id, F.xxhash64(text).bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID))


def id_of(row_key: Column) -> Column:
    return F.when(row_key < NO_ID, row_key)


def repeated_passages(
    docs: DataFrame,
    least_words: int = 25,
    chunk_words: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per repeated span: doc_id, start, length, n_words, first_doc_id, kept.

    ``start`` and ``length`` are bytes of the text in UTF-8.  ``kept`` marks spans
    that no document with a smaller id holds; they end where a span that one
    holds begins.  Of the first ids of a span's chunks the largest is given.
    """
    spans = keyed_passages(docs, least_words, chunk_words, id_col, text_col)
    return spans.select(
        id_of(F.col("row_key")).alias("doc_id"),
        "start",
        "length",
        "n_words",
        id_of(F.col("first_key")).alias("first_doc_id"),
        "kept",
    )


def keyed_passages(docs: DataFrame, least_words: int, chunk_words: int, id_col: str, text_col: str) -> DataFrame:
    """``repeated_passages`` with row_key and first_key, which are never null."""
    text = F.col(text_col)
    rows = in_batches(docs).select(key_of(F.col(id_col).cast("long"), text).alias("row_key"), text.alias("text"))
    digest = ["digest", "digest2"]
    repeated = cut(
        occurrences(rows, chunk_words, False)
        .groupBy(*digest)
        .agg(F.min("row_key").alias("first_key"), F.max("row_key").alias("last_key"))
        .where("first_key < last_key")
        .select(*digest, "first_key")
    )
    found = unpacked(occurrences(rows, chunk_words, True).join(repeated, digest))
    found = found.withColumn("kept", F.col("row_key") == F.col("first_key"))
    # What an earlier document holds is taken off the chunks that it holds in part.
    before = Window.partitionBy("row_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row_key").orderBy(F.desc("start"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    held = lambda kind, column, over: kind(F.when(~F.col("kept"), F.col(column))).over(over)
    trimmed = (
        found.withColumns({"_end": held(F.max, "end", before), "_last": held(F.max, "last_word", before) + 1})
        .withColumns({"_start": held(F.min, "start", after), "_first": held(F.min, "first_word", after) - 1})
        .select(
            "row_key",
            "kept",
            "first_key",
            F.when(F.col("kept"), F.greatest("start", "_end")).otherwise(F.col("start")).alias("start"),
            F.when(F.col("kept"), F.least("end", "_start")).otherwise(F.col("end")).alias("end"),
            F.when(F.col("kept"), F.greatest("first_word", "_last")).otherwise(F.col("first_word")).alias("first_word"),
            F.when(F.col("kept"), F.least("last_word", "_first")).otherwise(F.col("last_word")).alias("last_word"),
        )
        .where("first_word <= last_word")
    )
    in_doc = Window.partitionBy("row_key", "kept").orderBy("start", "end")
    reach = F.max("end").over(in_doc.rowsBetween(Window.unboundedPreceding, -1))
    return (
        trimmed.withColumn("apart", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
        .withColumn("span", F.sum("apart").over(in_doc))
        .groupBy("row_key", "kept", "span")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            (F.max("last_word") - F.min("first_word") + 1).cast("long").alias("n_words"),
            F.max("first_key").alias("first_key"),
        )
        .where(F.col("n_words") >= least_words)
        .select("row_key", "start", (F.col("end") - F.col("start")).alias("length"), "n_words", "first_key", "kept")
    )


def without_repeats(
    docs: DataFrame,
    least_words: int = 25,
    chunk_words: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with repeated spans cut out of all texts but the first's."""
    row_key, key, spans = unused(docs, "_row_key", "_key", "_spans")
    repeats = (
        keyed_passages(docs, least_words, chunk_words, id_col, text_col)
        .where("NOT kept")
        .groupBy(F.col("row_key").alias(key))
        .agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias(spans))
    )
    utf8 = F.encode(text_col, "UTF-8")
    last = F.element_at(spans, -1)
    kept = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<binary>").alias("parts")),
        lambda held, span: F.struct(
            (span["start"] + span["length"]).alias("at"),
            F.array_append(
                held["parts"],
                F.substring(utf8, (held["at"] + 1).cast("int"), (span["start"] - held["at"]).cast("int")),
            ).alias("parts"),
        ),
    )["parts"]
    tail = F.substring(utf8, (last["start"] + last["length"] + 1).cast("int"), F.octet_length(text_col))
    joined = F.array_join(F.transform(F.array_append(kept, tail), F.hex), "")
    whole = F.col(text_col)
    return (
        docs.withColumn(row_key, key_of(F.col(id_col).cast("long"), F.col(text_col)))
        .join(repeats, F.col(row_key) == F.col(key), "left")
        .withColumn(text_col, F.when(F.col(spans).isNull(), whole).otherwise(F.decode(F.unhex(joined), "UTF-8")))
        .select(*docs.columns)
    )
