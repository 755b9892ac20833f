"""Packing documents into fixed windows of tokens.

Every document is cut into whole windows and one remainder.  The remainders'
lengths form a histogram of at most ``window`` bins, whatever the corpus size.
Shallow combinations of lengths that fill a window are enumerated, their repeat
counts are solved against the histogram by non-negative least squares and
rounded down, and what is left is packed greedily, longest first.  The driver
only ever sees the histogram; documents meet the plan by a join on length.

Defined cases: a null text is an empty one, and an empty text is the single end
id; a null id is packed as any other; rows with the same id are packed as
separate documents; an empty table gives no rows; other columns are ignored; a
long text is encoded whole, as its ids depend on the whole, and cut after that.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import cut, in_batches, numbered

#: Shortest fill of a window, as its share, that a combination may have.
FILL = 0.99
#: Pieces of one length that a task numbers, about.
PART_ROWS = 1 << 20
#: Units of text whose ids a worker remembers.
REMEMBERED = 150_000


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, remembering units.

    The vocabulary splits a text before each space that precedes a visible
    character, so the units between such spaces can be encoded one by one and
    joined.  ``ranks`` names the same vocabulary as ``vocabulary``; it is quicker
    and serves units of Latin letters, the other serves the rest, and texts that
    hold one of its special tokens, as a whole.
    """

    GAP = re.compile(r" (?:\s|\Z)")

    def __init__(self, vocabulary: str, ranks: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.full = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        marks = [re.escape(token.content) for token in self.full.get_added_tokens_decoder().values()]
        self.marked = re.compile("|".join(marks) or r"(?!)")
        with open(public_tokenizers.path(ranks), "rb") as lines:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.quick = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}
        )
        self.inner = Remembered(lambda unit: self.plain(" " + unit), self)
        self.bare = Remembered(self.plain, self)
        self.ends = {mark: self.plain(mark) for mark in ".,\n"}

    def plain(self, text: str) -> bytes:
        if text.isascii() or max(text) < "ɐ":
            ids = self.quick.encode_ordinary(text)
        else:
            return self.whole(text)
        return np.array(ids, "<u4").tobytes() if len(ids) > 64 else array("I", ids).tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.marked.search(text):
            return self.whole(text)
        if self.GAP.search(text):
            return self.plain(text)
        first, *rest = text.split(" ")
        return self.plain(first) + b"".join(map(self.inner.__getitem__, rest))

    def forget(self) -> None:
        for known in (self.inner, self.bare):
            if len(known) > REMEMBERED:
                known.clear()


class Remembered(dict):
    """Ids of units; a new unit is split at a line end or a last mark first."""

    def __init__(self, encode, owner):
        self.encode, self.owner = encode, owner

    def __missing__(self, unit: str) -> bytes:
        head, line, tail = unit.partition("\n")
        if line and head and tail and not head[-1].isspace() and not tail[0].isspace():
            ids = self[head] + self.owner.ends["\n"] + self.owner.bare[tail]
        elif unit and unit[-1] in ".," and unit[:-1].isalpha():
            ids = self[unit[:-1]] + self.owner.ends[unit[-1]]
        else:
            ids = self.encode(unit)
        self[unit] = ids
        return ids


ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(vocabulary: str, ranks: str) -> Encoder:
    """The worker's encoder of a vocabulary, loaded once."""
    if (vocabulary, ranks) not in ENCODERS:
        ENCODERS[vocabulary, ranks] = Encoder(vocabulary, ranks)
    return ENCODERS[vocabulary, ranks]


def pieces(
    docs: DataFrame,
    window: int,
    id_col: str,
    text_col: str,
    vocabulary: str,
    ranks: str,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: whole windows of a document, then its remainder."""
    end = array("I", [end_id]).tobytes()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        for batch in batches:
            ids, starts, lengths, sums, totals, tokens = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = memoryview(encode.encode(text.as_py() or "") + end)
                n = len(data) // 4
                for start in range(0, n, window):
                    part = data[4 * start : 4 * (start + window)]
                    ids.append(doc_id)
                    starts.append(start)
                    lengths.append(len(part) // 4)
                    sums.append(crc32(part))
                    totals.append(n)
                    if with_ids:
                        tokens.append(np.frombuffer(part, "<u4").astype("i4"))
                encode.forget()
            arrays = [pa.array(ids, pa.int64())]
            arrays += [pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                arrays.append(pa.array(tokens, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    rows = in_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(split, schema + (", ids array<int>" if with_ids else ""))


def combinations(counts: dict[int, int], window: int) -> list[tuple[int, ...]]:
    """Combinations of up to three lengths that fill the window, longest first."""
    present = np.array(sorted(counts))
    least = int(np.ceil(window * FILL))

    def below(room: int) -> int:
        """The longest length up to ``room``, or 0."""
        at = np.searchsorted(present, room, "right")
        return int(present[at - 1]) if at else 0

    found = {(int(x),) for x in present if x >= least}
    for long in map(int, present):
        last = below(window - long)
        if last and long + last >= least:
            found.add(tuple(sorted((long, last), reverse=True)))
        for share in (0.5, 0.65, 0.8, 0.9):
            middle = below(int((window - long) * share))
            last = below(window - long - middle) if middle else 0
            if last and long + middle + last >= least:
                found.add(tuple(sorted((long, middle, last), reverse=True)))
    return sorted(found, reverse=True)


def solve(
    combos: list[tuple[int, ...]], counts: dict[int, int], sweeps: int = 60
) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared rest of the histogram.

    Non-negative least squares by projected coordinate descent: each step sets
    one repeat count to its best value for the others and clips it at zero.
    """
    rest = {length: float(n) for length, n in counts.items()}
    columns = [list(Counter(c).items()) for c in combos]
    norms = [sum(k * k for _, k in column) for column in columns]
    x = np.zeros(len(combos))
    for _ in range(sweeps):
        moved = 0.0
        for j, column in enumerate(columns):
            step = sum(k * rest[length] for length, k in column) / norms[j]
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for length, k in column:
                    rest[length] -= k * step
        if moved < 0.25:
            break
    return x


def plan(counts: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) that use every piece of the histogram just once."""
    left = {length: n for length, n in counts.items() if n}
    out = []
    if window in left:
        out.append(((window,), left.pop(window)))
    combos = combinations(left, window)
    for combo, repeats in zip(combos, solve(combos, left)):
        need = Counter(combo)
        n = min(int(repeats), *(left.get(length, 0) // k for length, k in need.items()))
        if n > 0:
            out.append((combo, n))
            for length, k in need.items():
                left[length] -= k * n
    present = np.array(sorted(length for length, n in left.items() if n))
    while len(present):
        combo: list[int] = []
        used: Counter[int] = Counter()
        room = window
        at = len(present)
        while at and room:
            at = min(at, int(np.searchsorted(present, room, "right")))
            while at and left[int(present[at - 1])] <= used[int(present[at - 1])]:
                at -= 1
            if at:
                length = int(present[at - 1])
                combo.append(length)
                used[length] += 1
                room -= length
        n = min(left[length] // k for length, k in used.items())
        out.append((tuple(combo), n))
        for length, k in used.items():
            left[length] -= k * n
        present = np.array([length for length in present if left[int(length)]])
    return out


def allotments(steps: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first, last, sequence, offset): where the pieces of a length go.

    Piece number i of a length, first <= i < last, starts at ``offset`` in
    sequence ``sequence + i - first``.
    """
    rows, taken, sequence = [], Counter(), 0
    for combo, repeats in steps:
        offset = 0
        for length in combo:
            first = taken[length]
            taken[length] += repeats
            rows.append((length, first, first + repeats, sequence, offset))
            offset += length
        sequence += repeats
    return rows


def pack(
    docs: DataFrame,
    window: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.json",
    ranks: str = "byte_bpe_50k.tiktoken",
) -> DataFrame:
    """Place every token of ``docs`` in sequences of at most ``window`` tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id and offset.  The plan that is joined has a row for each place of
    a combination: some thousands at most, as lengths are below ``window``.
    """
    spark = docs.sparkSession
    rows = cut(pieces(docs, window, id_col, text_col, vocabulary, ranks))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts = 256 + max(counts.values(), default=0) // PART_ROWS
    places = spark.createDataFrame(
        allotments(plan(counts, window)),
        "p_length long, first long, last long, sequence long, place long",
    )
    return (
        numbered(rows, "length", ["doc_id", "start"], "piece", parts)
        .join(
            F.broadcast(places),
            (F.col("length") == F.col("p_length"))
            & (F.col("piece") >= F.col("first"))
            & (F.col("piece") < F.col("last")),
        )
        .select(
            "doc_id",
            "start",
            "length",
            "ids_crc32",
            "doc_tokens",
            (F.col("sequence") + F.col("piece") - F.col("first")).alias("sequence_id"),
            F.col("place").alias("offset"),
        )
    )


def sequences(
    docs: DataFrame,
    packed: DataFrame,
    window: int = 1024,
    pad_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.json",
    ranks: str = "byte_bpe_50k.tiktoken",
) -> DataFrame:
    """(sequence_id, n_ids, ids): the packed windows themselves, padded.

    ``packed`` is what ``pack`` gave for the same documents.  A sequence whose
    length is a power of two stays unpadded.  Ids of documents may repeat, as in a
    mix, and be null: pieces with equal ids of tokens stand for each other.
    """
    same = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ids = pieces(docs, window, id_col, text_col, vocabulary, ranks, with_ids=True)
    ids = ids.groupBy(*same).agg(F.first("ids").alias("ids"))
    joined = [packed[c].eqNullSafe(ids[c]) for c in same]
    n = F.col("n_ids")
    power = F.col("n_ids").bitwiseAND(n - 1) == 0
    return (
        packed.join(ids, joined[0] & joined[1] & joined[2] & joined[3] & joined[4])
        .groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        .select("sequence_id", F.flatten("parts.ids").alias("ids"))
        .withColumn("n_ids", F.size("ids"))
        .withColumn(
            "ids",
            F.when(power, F.col("ids")).otherwise(
                F.concat("ids", F.array_repeat(F.lit(pad_id), (F.lit(window) - n).cast("int")))
            ),
        )
        .select("sequence_id", "n_ids", "ids")
    )
