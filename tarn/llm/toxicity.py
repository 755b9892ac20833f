"""Toxicity by a subsequence string-kernel machine with Nyström landmarks.

The strings are windows of labelled sentences: from the start of each word,
``WIDTH`` places of the sentence, a letter each, and one place for the gap between
two words.  Letters that stand alone side by side make up one word, and marks
inside a word count nothing, so neither part the letters of an insult.

The kernel of two strings sums, over the three-letter subsequences they share, a
decay for each place that the letters span in either, up to ``SPAN`` places; so
letters put between those of an insult lower its match but do not end it.

The machine is a linear one with squared hinge loss over Nyström features, whose
landmarks are strings of the sentences themselves, chosen by pivoted Cholesky
steps.  Labels are of documents, and only some strings of a toxic document earn
it: the machine starts with all strings of the shortest labelled documents, and
is trained again, ``ROUNDS`` times, on the string that it puts highest in each
toxic document of the sample, against the start's clean strings and those that it
put highest in each clean one in the last two rounds.  No string is left out for
where else it occurs.

In the kernel's own feature space the machine is one vector, found from the
landmarks' coefficients, so a document is scored by one pass over its letters:
its highest string decides.

Bounds, for the fit alone: ``SAMPLE`` labelled documents a class, by a hash of
their id, and ``FIRST`` labelled strings a class for the start.

Defined cases: a null or empty text scores as one without letters, and so does
every text where nothing toxic could be learned; a long text is read whole, a
slice at a time; rows with a null id are neither held out nor learned from; labels
other than 0 and 1 and null ones are not learned from, and of different labels of
one id each counts; equal rows score alike; an empty table gives no rows; other
columns, of documents or labels, are ignored, and kept by ``without_toxic``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import crc_mod, cut, in_batches

#: Labelled documents of a class that are learned from, and strings of the start.
SAMPLE, FIRST = 3000, 12_000
#: Landmarks, and the rounds of training after the start.
LANDMARKS, ROUNDS = 384, 5
#: Strings of a clean document that a round takes up.
HARDEST = 8
#: Places of a string; places that a subsequence may span, and its decay for each.
WIDTH, SPAN, DECAY = 9, 6, 0.65
#: Strings of a round that landmarks are chosen from: toxic ones and clean ones.
POOL = 800, 200
#: Code points of text that are scored at once; longer texts are scored in portions
#: that overlap by ``OVERLAP``, which is more than a string reaches over.
SLICE, OVERLAP = 1 << 19, 1 << 10
#: Steps of the document margins in which the cut is sought, over (-RANGE, RANGE).
STEPS, RANGE, CLEAN_COUNTS = 4096, 4.0, 2.0
#: Tasks that the sample is read by.
SAMPLE_PARTS = 24

#: Classes of letters: a to z, and the other letters by code point.
BITS = 6
CODES = 1 << (3 * BITS)
OFFSETS = [(i, j) for i in range(1, SPAN - 1) for j in range(1, SPAN - i)]

_tables: dict[str, np.ndarray] = {}


def classes() -> np.ndarray:
    """The class of each code point: 0 if it is no letter, 64 for a blank."""
    if "class" not in _tables:
        table = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            if chr(i).isalpha():
                table[i] = 27 + i % 37
            elif chr(i).isspace():
                table[i] = 64
        table[ord("a") : ord("z") + 1] = np.arange(1, 27)
        _tables["class"] = table
    return _tables["class"]


def spelled(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, starts, owners): classes of letters in their places, where the
    strings start, and the text that each is of.

    A new word is one place on; a new sentence is ``WIDTH`` places on, so that no
    string reaches over its end.
    """
    folded = [text.lower() + "\n" for text in texts]
    points = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[points]
    blank = kind == 64
    mark = (points == ord(".")) | (points == ord("!")) | (points == ord("?"))
    ends = points == ord("\n")
    ends[:-1] |= mark[:-1] & blank[1:]
    at = np.flatnonzero((kind > 0) & ~blank)
    if not len(at):
        return np.zeros(WIDTH, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
    sentence = np.cumsum(ends)[at]
    word = np.cumsum(blank)[at]
    opens = np.concatenate(([True], sentence[1:] != sentence[:-1]))
    begins = opens | np.concatenate(([True], word[1:] != word[:-1]))
    first = np.flatnonzero(begins)
    single = np.diff(first, append=len(at)) == 1
    joined = np.concatenate(([False], single[1:] & single[:-1])) & ~opens[first]
    begins[first[joined]] = False
    places = np.cumsum(np.where(opens, WIDTH, begins)) + np.arange(len(at)) - WIDTH
    letters = np.zeros(int(places[-1]) + 1 + WIDTH, np.uint32)
    letters[places] = kind[at]
    bounds = np.cumsum([len(text) for text in folded])
    return letters, places[begins], np.searchsorted(bounds, at[begins], "right")


def margins(letters: np.ndarray, starts: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """The vector's product with the subsequences of each string."""
    out = np.zeros(len(starts))
    high, middle = letters << np.uint32(2 * BITS), letters << np.uint32(BITS)
    for span in range(3, SPAN + 1):
        n = len(letters) - span + 1
        value = np.zeros(n, np.float32)
        for i in range(1, span - 1):
            value += vector[high[:n] | middle[i : i + n] | letters[span - 1 : span - 1 + n]]
        sums = np.concatenate((np.zeros(1), np.cumsum(value, dtype=np.float64)))
        out += DECAY**span * (sums[np.minimum(starts + WIDTH - span + 1, n)] - sums[starts])
    return out


def strings(letters: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The strings as rows of ``WIDTH`` classes, 0 for a gap."""
    return letters[starts[:, None] + np.arange(WIDTH)].astype(np.uint8)


def subsequences(rows: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
    """(decay, code of each string's subsequence), for all places; 0 holds a gap."""
    rows = rows.astype(np.int64)
    for i, j in OFFSETS:
        for p in range(WIDTH - i - j):
            a, b, c = rows[:, p], rows[:, p + i], rows[:, p + i + j]
            yield DECAY ** (i + j + 1), np.where((a > 0) & (b > 0) & (c > 0), a << (2 * BITS) | b << BITS | c, 0)


def feature_table(landmarks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column of each code, features by column and landmark); column 0 is empty."""
    own = [np.unique(codes) for _, codes in subsequences(landmarks)]
    present = np.union1d([0], np.concatenate(own) if own else [])
    column = np.zeros(CODES, np.int64)
    column[present] = np.arange(len(present))
    table = np.zeros((len(present), len(landmarks)), np.float32)
    for decay, codes in subsequences(landmarks):
        np.add.at(table, (column[codes], np.arange(len(landmarks))), decay)
    table[0] = 0
    return column, table


def kernel(rows: np.ndarray, landmarks: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Kernel values of each string with each landmark, times ``root`` if given."""
    column, table = feature_table(landmarks)
    out = np.zeros((len(rows), len(landmarks) if root is None else root.shape[1]), np.float32)
    for first in range(0, len(rows), 4096):
        part = np.zeros((len(rows[first : first + 4096]), len(landmarks)), np.float32)
        for decay, codes in subsequences(rows[first : first + 4096]):
            part += np.float32(decay) * table[column[codes]]
        out[first : first + 4096] = part if root is None else part @ root
    return out


def chosen_landmarks(pool: np.ndarray, most: int) -> np.ndarray:
    """Strings of a pool, one by one that which the ones before explain least."""
    gram = kernel(pool, pool).astype(np.float64)
    rest = np.diag(gram).copy()
    picked, parts = [], np.zeros((len(pool), 0))
    while len(picked) < most and rest.max(initial=0) > 1e-3:
        i = int(np.argmax(rest))
        picked.append(i)
        new = (gram[:, i] - parts @ parts[i]) / np.sqrt(rest[i])
        parts = np.column_stack((parts, new))
        rest = np.maximum(0, rest - new**2)
        rest[i] = 0
    return pool[picked]


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights of the linear machine with squared hinge loss; the last is a bias."""
    n = x.shape[1] + 1
    w, keep = np.zeros(n), ridge * np.eye(n)
    keep[-1, -1] = 1e-6
    active = None
    for _ in range(30):
        now = y * (x @ w[:-1].astype(x.dtype) + w[-1]) < 1
        if active is not None and (now == active).all():
            break
        active = now
        left, right = keep.copy(), np.zeros(n)
        at = np.flatnonzero(active)
        for first in range(0, len(at), 8192):
            own = at[first : first + 8192]
            part = np.column_stack((x[own], np.ones(len(own), x.dtype)))
            heavy = (part * weight[own, None].astype(x.dtype)).T
            left += heavy @ part
            right += heavy @ y[own].astype(x.dtype)
        w = np.linalg.solve(left, right)
    return w


def fitted(toxic: np.ndarray, clean: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, float]:
    """(vector, bias) from toxic and clean strings, with landmarks from a pool."""
    landmarks = chosen_landmarks(pool, LANDMARKS)
    if not len(landmarks) or not len(toxic) or not len(clean):
        return np.zeros(CODES, np.float32), -1.0
    values, axes = np.linalg.eigh(kernel(landmarks, landmarks).astype(float))
    kept = values > 1e-4
    root = axes[:, kept] / np.sqrt(values[kept])
    rows = np.concatenate((toxic, clean))
    x = kernel(rows, landmarks, root.astype(np.float32))
    y = np.where(np.arange(len(rows)) < len(toxic), 1.0, -1.0)
    weight = np.where(y > 0, 0.5 * len(rows) / len(toxic), 0.5 * len(rows) / len(clean)) / len(rows) * 1000
    w = machine(x, y, weight)
    column, table = feature_table(landmarks)
    own = table @ (root @ w[:-1])
    vector = own[column].astype(np.float32)
    vector[0] = 0
    return vector, float(w[-1])


def portions(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """(owners, portions of their texts) in slices of bounded size."""
    owners, held, size = [], [], 0
    for owner, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > SLICE:
                end = at + SLICE
                blank = text.rfind(" ", end - OVERLAP // 2, end)
                end = blank if blank > 0 else end
            if held and size + end - at > SLICE:
                yield owners, held
                owners, held, size = [], [], 0
            owners.append(owner)
            held.append(text[at:end])
            size += end - at
            if end == len(text):
                break
            blank = text.find(" ", end - OVERLAP, end)
            at = blank if blank > 0 else end - OVERLAP
    if held:
        yield owners, held


def document_margins(texts: list[str], vector: np.ndarray, bias: float) -> np.ndarray:
    """The margin of each text's highest string; ``bias`` for one without letters."""
    out = np.full(len(texts), -np.inf)
    for owners, held in portions(texts):
        letters, starts, which = spelled(held)
        np.maximum.at(out, np.array(owners)[which], margins(letters, starts, vector))
    return np.where(np.isinf(out), 0.0, out) + bias


def hardest_strings(texts: list[str], vector: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(owners, strings): the ``most`` highest different strings of each text."""
    every = []
    for owners, held in portions(texts):
        letters, starts, which = spelled(held)
        value, owner = margins(letters, starts, vector), np.array(owners, np.int64)[which]
        order = np.lexsort((-value, owner))
        place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        some = order[place < most]
        every += zip(owner[some].tolist(), (-value[some]).tolist(), map(bytes, strings(letters, starts[some])))
    every = sorted(set(every))
    owner = np.array([row[0] for row in every], np.int64)
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    kept = np.flatnonzero(place < most)
    rows = np.frombuffer(b"".join(every[i][2] for i in kept), np.uint8).reshape(-1, WIDTH)
    return owner[kept], rows


def string_rows(sample: DataFrame, of_batch) -> DataFrame:
    """(toxic, n, string) of rows of (toxic, text), as ``of_batch`` picks them.

    ``of_batch`` maps texts and their labels to (owners, strings); ``n`` is how
    many of them the text has.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            owner, rows = of_batch(batch.column(1).to_pylist(), toxic)
            n = np.bincount(owner, minlength=len(toxic))[owner]
            yield pa.RecordBatch.from_arrays(
                [pa.array(toxic[owner], pa.int32()), pa.array(n, pa.int64()), pa.array(map(bytes, rows), pa.binary())],
                ["toxic", "n", "string"],
            )

    return sample.mapInArrow(read, "toxic int, n long, string binary")


def taken(found: DataFrame, toxic: int, order: list, most: int) -> np.ndarray:
    """Strings of a class, the first ``most`` in an order, on the driver."""
    rows = found.where(F.col("toxic") == toxic).orderBy(*order, F.xxhash64("string"), "string").limit(most)
    data = b"".join(bytes(r["string"]) for r in rows.select("string").collect())
    return np.frombuffer(data, np.uint8).reshape(-1, WIDTH)


def pooled(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Different strings that landmarks are chosen from: evenly spread ones of both."""
    some = [np.unique(x, axis=0) for x in (toxic, clean) if len(x)]
    spread = [x[np.linspace(0, len(x) - 1, min(len(x), most)).astype(int)] for x, most in zip(some, POOL)]
    return np.unique(np.concatenate(spread), axis=0) if spread else np.empty((0, WIDTH), np.uint8)


def learned(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, float]:
    """(vector, bias, cut) from documents (doc_id, text) and labels (doc_id, toxic).

    The driver holds the sample's strings of a round: ``FIRST`` of a class, then one
    a toxic document and ``HARDEST`` a clean one, ``SAMPLE`` documents a class.
    """
    ids = [
        labels.where(F.col("toxic") == mark).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for mark in (0, 1)
    ]
    sample = cut(
        docs.where("text IS NOT NULL")
        .join(F.broadcast(ids[0].union(ids[1])), "doc_id")
        .select("toxic", "text")
        .repartition(SAMPLE_PARTS)
    )

    def all_strings(texts: list[str], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        owners, rows = [np.empty(0, np.int64)], [np.empty((0, WIDTH), np.uint8)]
        for own, held in portions(texts):
            letters, starts, which = spelled(held)
            owners.append(np.array(own, np.int64)[which])
            rows.append(strings(letters, starts))
        return np.concatenate(owners), np.concatenate(rows)

    first = string_rows(sample, all_strings)
    toxic, start = taken(first, 1, ["n"], FIRST), taken(first, 0, [], FIRST)
    vector, bias = fitted(toxic, start, pooled(toxic, start))
    before = np.empty((0, WIDTH), np.uint8)
    for _ in range(ROUNDS):

        def hardest(texts: list[str], toxic: np.ndarray, vector: np.ndarray = vector) -> tuple[np.ndarray, np.ndarray]:
            owner, rows = hardest_strings(texts, vector, HARDEST)
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            kept = (toxic[owner] == 0) | (place == 0)
            return owner[kept], rows[kept]

        found = cut(string_rows(sample, hardest))
        toxic, hard = taken(found, 1, [], SAMPLE), taken(found, 0, [], SAMPLE * HARDEST)
        clean = np.unique(np.concatenate((start, before, hard)), axis=0)
        vector, bias = fitted(toxic, clean, pooled(toxic, hard))
        before = hard
    return vector, bias, best_cut(cut_counts(sample, vector, bias))


def cut_counts(sample: DataFrame, vector: np.ndarray, bias: float) -> list[tuple[int, int, int]]:
    """(step, toxic, clean): documents of the sample by steps of their margin."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = document_margins(batch.column(1).to_pylist(), vector, bias)
            step = np.clip((found + RANGE) * (STEPS / (2 * RANGE)), 0, STEPS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(step)], ["toxic", "step"])

    rows = (
        sample.mapInArrow(read, "toxic int, step int")
        .groupBy("step")
        .agg(F.sum("toxic").alias("n"), F.sum(1 - F.col("toxic")).alias("m"))
        .collect()
    )
    return [(r["step"], r["n"], r["m"]) for r in rows]


def best_cut(counts: list[tuple[int, int, int]]) -> float:
    """The margin that parts toxic and clean best, from (step, toxic, clean) rows.

    Of equally good places the middle one.  A share of the clean documents taken
    counts ``CLEAN_COUNTS`` times the same share of the toxic ones missed.
    """
    toxic, clean = np.zeros(STEPS), np.zeros(STEPS)
    for step, n, m in counts:
        toxic[step] += n
        clean[step] += m
    if not toxic.sum() or not clean.sum():
        return 0.0
    wrong = np.concatenate(([0], np.cumsum(toxic))) / toxic.sum()
    wrong += CLEAN_COUNTS * (1 - np.concatenate(([0], np.cumsum(clean))) / clean.sum())
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float((best[0] + best[-1]) / 2 * 2 * RANGE / STEPS - RANGE)


def trained(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[np.ndarray, float, float]:
    """(vector, bias, cut) from the labels of documents that are not held out."""
    doc_id = F.col(id_col).cast("long")
    known = (
        labels.select(doc_id.alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
        .where((crc_mod(F.col("doc_id"), 5) != 0) & F.col("toxic").isin(0, 1))
        .distinct()
    )
    return learned(in_batches(docs).select(doc_id.alias("doc_id"), F.col(text_col).alias("text")), known)


def scored(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The score is 0.5 where the sample's documents part best.
    """
    vector, bias, at = trained(docs, labels, id_col, text_col, label_col)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = document_margins([t or "" for t in batch.column(2).to_pylist()], vector, bias)
            score = 1 / (1 + np.exp(np.clip((at - margin) * 4, -60, 60)))
            arrays = [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *arrays], ["doc_id", "held_out", "score", "predicted"])

    doc_id = F.col(id_col).cast("long")
    rows = docs.select(
        doc_id.alias("doc_id"),
        F.coalesce(crc_mod(doc_id, 5) == 0, F.lit(False)).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    return rows.mapInArrow(read, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic, row by row."""
    vector, bias, at = trained(docs, labels, id_col, text_col, label_col)
    place = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = document_margins([t or "" for t in batch.column(place).to_pylist()], vector, bias)
            yield batch.filter(pa.array(margin < at, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
