"""Alignment of two tokenizers over the same text.

Both tokenizers cut a text, with a space before it, into tokens of bytes.  Places
where both end a token cut the tokens into groups; tokens whose bytes overlap are
linked.  A pair of ids counts as many links as it has in the whole corpus.

Both vocabularies end a token before each space or line end that follows something
other than white space, so a text falls into units there and a group never spans two.  A
partition's units are aligned once each: their tokens are tables of intervals in
DuckDB, where as-of joins find the first and the last token that a token overlaps, a
range join lists all between them, and sums over a window number the groups.  DuckDB
sums the links of a partition by pair, and Spark merges these partial counts.  What the
texts' tokens give is cut with each text's links, which then meet the merged counts.

The counts are held by every task, ``PAIRS`` pairs at most.  Where the corpus has more,
they are dealt into slices of about that size by a hash, and slice after slice is added
up; the vocabularies bound their number, whatever the corpus size.  A worker remembers
``REMEMBERED`` units, or ``REMEMBERED_BYTES`` of them; beyond that it keeps those that
it used most.

Defined cases: texts that are null or empty have no tokens, and so have those whose
tokens' bytes, joined, are not the text with a space before it (one that holds
U+2581, which the pieces write for a space); special tokens' strings are plain text;
white space of several kinds side by side makes the text one unit; long texts are
read whole, ``PART`` units at a time; rows with a null id and repeated rows are rows
like others, and each counts links of its own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import cut, in_batches

#: Pairs with their counts that a task holds at once.
PAIRS = 2_000_000
#: Units, and their bytes, that a worker remembers; units of a text read at once.
REMEMBERED, REMEMBERED_BYTES, PART = 250_000, 24 << 20, 1 << 18
#: Tokens that DuckDB aligns at once, about; a longer unit is aligned by itself.
ALIGNED = 1 << 18
#: Characters of short texts that are prepared at once.
PREPARED = 1 << 20

UNIT = re.compile(r"[ \n]+[^ \n]*")
#: White space whose tokens may depend on what comes after the next unit's start.
MIXED_BLANKS = re.compile(r"[^\S \n][ \n]")
#: Characters below this are cut alike by both forms of the byte vocabulary.
BEYOND_LATIN = "ɐ"

#: Tokens with the number of their group: how many common ends come before them.
GROUPED = """
    CREATE OR REPLACE TEMP TABLE {side}_grouped AS
    WITH common AS (SELECT a.e FROM a JOIN b ON a.e = b.e)
    SELECT t.*, coalesce(sum((c.e IS NOT NULL)::INT) OVER (ORDER BY t.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part
    FROM {side} t LEFT JOIN common c ON t.e = c.e
"""
LINKS = """
    WITH opened AS (SELECT b.*, a.i AS first FROM b_grouped b ASOF JOIN a_grouped a ON b.s >= a.s)
    SELECT o.unit, a.id AS a_id, o.id AS b_id
    FROM opened o JOIN a_grouped a ON a.part = o.part AND a.i >= o.first AND a.s < o.e
    ORDER BY o.unit
"""
COUNTS = "SELECT a_id, b_id, sum(n)::BIGINT AS n FROM links JOIN uses USING (unit) WHERE n > 0 GROUP BY a_id, b_id"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Printable bytes of Latin-1 stand for themselves, the rest for letters from 256 on.
    """
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + at): b for at, b in enumerate(rest)}


class Aligner:
    """A worker's tokenizers, and the units that it remembers as aligned.

    A unit is known by its number; lists hold, by number, what is remembered.
    """

    def __init__(self, vocabulary: str, ranks: str, pieces: str):
        import base64

        import duckdb
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.full = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.full.encode_special_tokens = True
        with open(public_tokenizers.path(ranks), "rb") as lines:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces))
        letters = byte_letters()
        self.a_bytes = [b""] * self.full.get_vocab_size()
        for token, i in self.full.get_vocab().items():
            known = all(letter in letters for letter in token)
            self.a_bytes[i] = bytes(letters[letter] for letter in token) if known else token.encode()
        self.b_bytes = []
        for i in range(self.pieces.get_piece_size()):
            piece = self.pieces.id_to_piece(i)
            if re.search("[^▁]▁|\n", piece):
                raise ValueError(f"{pieces}: a piece reaches over the start of a word")
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.space = self.pieces.piece_to_id("▁")
        #: An id in a group's string: followed by an id, by the other side, by a group, by nothing.
        self.spelled = [str(i).encode() + mark for i in range(max(len(self.a_bytes), len(self.b_bytes))) for mark in (b",", b"|", b";", b"")]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
        self.forget()

    def forget(self) -> None:
        """Begin with no units; numbers given before no longer count."""
        self.known: dict[str, int] = {}
        self.size = 0
        self.exact = np.empty(0, bool)
        self.counts = np.empty((0, 4), np.int64)
        self.groups: list[bytes] = []
        self.links = np.empty(0, np.int64)
        self.first = np.empty(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def full_up(self) -> bool:
        return len(self.known) > REMEMBERED or self.size > REMEMBERED_BYTES

    def thin_out(self) -> None:
        """Keep the units used most, half of what may be held at most.

        Other units, and all if those used once fill half, are forgotten.
        """
        units, sizes = list(self.known), np.fromiter(map(len, self.known), np.int64)
        least = 2
        while least < 1 << 10 and (2 * (self.uses >= least).sum() > REMEMBERED or 2 * sizes[self.uses >= least].sum() > REMEMBERED_BYTES):
            least += 1
        kept = self.uses >= least if least < 1 << 10 else np.zeros(len(units), bool)
        own = np.flatnonzero(kept).tolist()
        self.known = {units[u]: at for at, u in enumerate(own)}
        self.size = int(sizes[kept].sum())
        self.links = self.links[np.repeat(kept, self.counts[:, 3])]
        self.exact, self.counts, self.groups = self.exact[kept], self.counts[kept], [self.groups[u] for u in own]
        self.first = np.cumsum(self.counts[:, 3]) - self.counts[:, 3]
        self.uses = np.zeros(len(own), np.int64)

    def a_ids(self, unit: str) -> list[int]:
        if unit.isascii() or max(unit) < BEYOND_LATIN:
            return self.quick.encode_ordinary(unit)
        return self.full.encode(unit, add_special_tokens=False).ids

    def b_ids(self, units: list[str]) -> list[list[int]]:
        """The piece model puts a space before what it reads: the unit's own, or one more."""
        found = self.pieces.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [ids or [self.space] if u[0] == " " else ids[1:] for u, ids in zip(units, found)]

    def learn(self, units: list[str]) -> None:
        """Tokenize and align units that are not known yet."""
        a_ids, b_ids = list(map(self.a_ids, units)), self.b_ids(units)
        first = held = 0
        for at in range(len(units)):
            held += len(a_ids[at]) + len(b_ids[at])
            if held > ALIGNED or at == len(units) - 1:
                self.align(units[first : at + 1], a_ids[first : at + 1], b_ids[first : at + 1])
                first, held = at + 1, 0

    def align(self, units: list[str], a_ids: list[list[int]], b_ids: list[list[int]]) -> None:
        flat_a, flat_b = list(chain.from_iterable(a_ids)), list(chain.from_iterable(b_ids))
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(units)) for x in (a_ids, b_ids))
        size_a, size_b = self.a_size[flat_a], self.b_size[flat_b]
        exact = np.diff(np.cumsum(size_a)[np.cumsum(n_a) - 1], prepend=0) == np.diff(np.cumsum(size_b)[np.cumsum(n_b) - 1], prepend=0)
        a_of, b_of = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        if not exact.all() or not b"".join(map(a_of, flat_a)) == b"".join(map(b_of, flat_b)) == "".join(units).encode():
            exact = np.array([b"".join(map(a_of, a)) == b"".join(map(b_of, b)) == u.encode() for u, a, b in zip(units, a_ids, b_ids)])

        def intervals(ids: list[int], n: np.ndarray, size: np.ndarray) -> pa.Table:
            kept = np.repeat(exact, n)
            flat, ends = np.array(ids, np.int64)[kept], np.cumsum(size[kept])
            unit = np.repeat(np.arange(len(units)), n)[kept]
            return pa.table({"i": np.arange(len(flat)), "unit": unit, "id": flat, "s": ends - size[kept], "e": ends})

        self.db.register("a", intervals(flat_a, n_a, size_a))
        self.db.register("b", intervals(flat_b, n_b, size_b))
        n_a, n_b = n_a * exact, n_b * exact
        tokens = []
        for side in "ab":
            self.db.execute(GROUPED.format(side=side))
            tokens.append(self.db.sql(f"SELECT unit, id, part::BIGINT AS part FROM {side}_grouped ORDER BY i").fetchnumpy())
        links = self.db.sql(LINKS).fetchnumpy()
        self.db.unregister("a")
        self.db.unregister("b")
        n_links = np.bincount(links["unit"].astype(np.int64), minlength=len(units))
        n_groups = np.bincount(tokens[0]["unit"][np.diff(tokens[0]["part"], prepend=-1) > 0].astype(np.int64), minlength=len(units))
        self.groups += self.strings(tokens, n_a + n_b)
        self.known.update(zip(units, range(len(self.exact), len(self.exact) + len(units))))
        self.size += sum(map(len, units))
        self.exact = np.concatenate((self.exact, exact))
        self.counts = np.concatenate((self.counts, np.column_stack((n_a, n_b, n_groups, n_links))))
        self.first = np.concatenate((self.first, len(self.links) + np.cumsum(n_links) - n_links))
        self.links = np.concatenate((self.links, links["a_id"].astype(np.int64) << 32 | links["b_id"].astype(np.int64)))
        self.uses = np.concatenate((self.uses, np.zeros(len(units), np.int64)))

    def strings(self, tokens: list[dict[str, np.ndarray]], n: np.ndarray) -> list[bytes]:
        """Each unit's groups, as the ids of one side, then of the other."""
        unit, ids, part = (np.concatenate([t[c] for t in tokens]) for c in ("unit", "id", "part"))
        side = np.repeat([0, 1], [len(t["id"]) for t in tokens])
        order = np.lexsort((side, part))
        unit, ids, part, side = unit[order], ids[order], part[order], side[order]
        mark = np.zeros(len(ids), np.int64)
        turns = np.concatenate((side[1:] != side[:-1], [True])) if len(ids) else np.empty(0, bool)
        mark[turns] = 1 + side[turns]
        mark[np.concatenate((unit[1:] != unit[:-1], [True])) if len(ids) else []] = 3
        spelled = list(map(self.spelled.__getitem__, (4 * ids + mark).tolist()))
        bounds = np.concatenate(([0], np.cumsum(n))).tolist()
        return [b"".join(spelled[a:b]) for a, b in zip(bounds, bounds[1:])]

    def numbers(self, units: list[str]) -> np.ndarray:
        """The numbers of units, learned where they are new."""
        new = [u for u in dict.fromkeys(units) if u not in self.known]
        if new:
            self.learn(new)
        return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))

    def parts(self, text: str) -> Iterator[list[str]]:
        """The units of a text with a space before it, ``PART`` at a time."""
        spaced = " " + text
        if MIXED_BLANKS.search(spaced):
            yield [spaced]
        elif len(spaced) <= PART:
            yield UNIT.findall(spaced)
        else:
            found = UNIT.finditer(spaced)
            while part := [m.group() for m in islice(found, PART)]:
                yield part

    def prepared(self, texts: list[str | None]) -> list[list[str] | None]:
        """The units of short texts, learned where they are new."""
        out = [next(self.parts(t)) if t and len(t) < PART else None for t in texts]
        new = [u for u in dict.fromkeys(chain.from_iterable(filter(None, out))) if u not in self.known]
        if new:
            self.learn(new)
        return out

    def read(self, text: str | None, units: list[str] | None) -> Iterator[np.ndarray]:
        """Numbers of the text's units; nothing for a text without tokens.

        ``units`` are those of a short text, as prepared.  A longer one is gone through
        once to see whether all of them are exact.
        """
        if not text:
            return
        if units is not None:
            numbers = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
            if self.all_exact(numbers):
                yield numbers
                return
        elif all(self.all_exact(self.numbers(part)) for part in self.parts(text)):
            yield from map(self.numbers, self.parts(text))
            return
        whole = self.numbers([" " + text])
        if self.all_exact(whole):
            yield whole

    def all_exact(self, numbers: np.ndarray) -> bool:
        return bool(self.exact[numbers].all())

    def read_all(self, texts: pa.Array) -> Iterator[Iterator[np.ndarray]]:
        """``read`` of each text; units are prepared for some texts at once."""
        first, size, lengths = 0, 0, pc.utf8_length(texts).to_pylist()
        for at, n in enumerate(lengths):
            size += n or 0
            if size >= PREPARED or at == len(lengths) - 1:
                some = texts[first : at + 1].to_pylist()
                for text, units in zip(some, self.prepared(some)):
                    yield self.read(text, units)
                first, size = at + 1, 0

    def counted(self) -> bytes:
        """Partial counts of pairs from how often each unit was used: ids, then counts."""
        unit = np.repeat(np.arange(len(self.exact)), self.counts[:, 3])
        self.db.register("uses", pa.table({"unit": np.arange(len(self.uses)), "n": self.uses}))
        self.db.register("links", pa.table({"unit": unit, "a_id": self.links >> 32, "b_id": self.links & 0xFFFFFFFF}))
        found = self.db.sql(COUNTS).fetchnumpy()
        self.db.unregister("uses")
        self.db.unregister("links")
        return np.concatenate([found[c].astype(np.int64) for c in ("a_id", "b_id", "n")]).tobytes()

    def links_of(self, numbers: np.ndarray) -> np.ndarray:
        """The links of some units, one after the other: ids of A and of B."""
        n = self.counts[numbers, 3]
        at = np.arange(n.sum()) + np.repeat(self.first[numbers] - np.cumsum(n) + n, n)
        return self.links[at]


ALIGNERS: dict[tuple[str, ...], Aligner] = {}


def aligner(*files: str) -> Aligner:
    """The worker's aligner of some vocabularies, loaded once."""
    if files not in ALIGNERS:
        ALIGNERS[files] = Aligner(*files)
    return ALIGNERS[files]


OWN = ["n_a", "n_b", "n_groups", "n_links"]
COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def tokenized(rows: DataFrame, files: tuple[str, ...]) -> DataFrame:
    """What the tokens of each (doc_id, text) give, with its links; and partial counts.

    ``links`` holds ids of A and B by turns; rows of partial counts, which have
    ``counts``, stand between those of documents.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*files)
        own.uses[:] = 0
        wide = max(len(own.a_bytes), len(own.b_bytes)) > 1 << 16
        kind = np.dtype("<u4" if wide else "<u2")

        def numbers_of(n: int, counts: bytes | None) -> dict[str, list]:
            return {"doc_id": [None] * n} | {c: [0] * n for c in OWN} | {"groups_sha256": [""] * n, "links": [None] * n, "counts": [counts] * n}

        def batch_of(out: dict[str, list]) -> pa.RecordBatch:
            kinds = {"groups_sha256": pa.string(), "links": pa.binary(), "counts": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(x, kinds.get(c, pa.int64())) for c, x in out.items()], list(out))

        for batch in batches:
            out = numbers_of(0, None)
            out["doc_id"] = batch.column(0).to_pylist()
            for parts in own.read_all(batch.column(1)):
                total, digest, glue, links = np.zeros(4, np.int64), sha256(), b"", []
                for numbers in parts:
                    np.add.at(own.uses, numbers, 1)
                    total += own.counts[numbers].sum(axis=0)
                    digest.update(glue + b";".join(map(own.groups.__getitem__, numbers.tolist())))
                    glue = b";"
                    packed = own.links_of(numbers)
                    links.append(np.column_stack((packed >> 32, packed & 0xFFFFFFFF)).astype(kind).tobytes())
                for name, value in zip(OWN, total.tolist()):
                    out[name].append(value)
                out["groups_sha256"].append(digest.hexdigest() if total[0] else "")
                out["links"].append(b"".join(links))
                out["counts"].append(None)
            yield batch_of(out)
            if own.full_up():
                yield batch_of(numbers_of(1, own.counted()))
                own.thin_out()
        yield batch_of(numbers_of(1, own.counted()))

    return rows.mapInArrow(read, COLUMNS + ", links binary, counts binary")


def pair_counts(partial: DataFrame) -> DataFrame:
    """(a_id, b_id, n, best) from partial counts, cut.

    ``best`` marks the pairs that have the most links of their b_id.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts in batch.column(0):
                own = np.frombuffer(counts.as_py(), np.int64).reshape(3, -1)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, own)), ["a_id", "b_id", "n"])

    counts = partial.mapInArrow(read, "a_id long, b_id long, n long").groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))
    return cut(counts.withColumn("best", (F.col("n") == F.max("n").over(Window.partitionBy("b_id"))).cast("long")))


def weighed(rows: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """Rows of ``tokenized`` with n_best and count_sum, without their links.

    ``width`` is the number of bytes of an id.
    """
    context = rows.sparkSession.sparkContext
    slices = max(1, -(-counts.count() // PAIRS))
    rows = rows.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for at in range(slices):
        found = counts.where(F.pmod(F.xxhash64("a_id", "b_id"), F.lit(slices)) == at).toArrow()
        key = found.column("a_id").to_numpy() << 32 | found.column("b_id").to_numpy()
        order = np.argsort(key)
        held = context.broadcast((key[order], *(found.column(c).to_numpy()[order] for c in ("best", "n"))))

        def read(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            keys, *values = held.value
            for batch in batches:
                sums = []
                for links in batch.column("links"):
                    ids = np.frombuffer(links.as_buffer(), f"<u{width}").reshape(-1, 2).astype(np.int64)
                    packed = ids[:, 0] << 32 | ids[:, 1]
                    place = np.minimum(np.searchsorted(keys, packed), len(keys) - 1)
                    hit = place[keys[place] == packed] if len(keys) else place[:0]
                    sums.append([int(value[hit].sum()) for value in values])
                for name, more in zip(("n_best", "count_sum"), zip(*sums)):
                    place = batch.schema.get_field_index(name)
                    batch = batch.set_column(place, name, pc.add(batch.column(place), pa.array(more, pa.int64())))
                yield batch

        rows = rows.mapInArrow(read, rows.schema)
    return rows.drop("links")


def aligned(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.json",
    ranks: str = "byte_bpe_50k.tiktoken",
    pieces: str = "piece_bpe_32k.model",
) -> DataFrame:
    """One row per document: tokens, groups and links of both vocabularies.

    ``ranks`` names the same vocabulary as ``vocabulary``, which is A; ``pieces`` is B.
    """
    rows = in_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    files = (vocabulary, ranks, pieces)
    found = cut(tokenized(rows, files))
    counts = pair_counts(found.where("counts IS NOT NULL").select("counts"))
    own = aligner(*files)
    width = 4 if max(len(own.a_bytes), len(own.b_bytes)) > 1 << 16 else 2
    return weighed(found.where("counts IS NULL").drop("counts"), counts, width).select(
        "doc_id", *OWN, "n_best", "count_sum", "groups_sha256"
    )
