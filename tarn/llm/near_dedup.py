"""Near-duplicate documents by MinHash, banding, verification and components.

A document is the set of its distinct shingles.  Documents with equal sets are
one node.  A node's signature holds the minima of many universal hashes of its
shingles; nodes that agree in a band of the signature are candidates, and a
candidate pair links if its signatures agree often enough and then the full sets
do.

The pairs of a band are not listed.  In rounds, each member is tried against one
leader of its band, and the leader leaves the band, as it has met all others;
bands whose members lie in one component are settled.  When a further round would
settle little, the members still open gather in blocks by the most crowded band
they are in; blocks that share a band meet, and a task that holds two blocks
counts what their full sets have in common and returns the links only.  So every
candidate of every band meets the same test of full sets, whatever the band's
size.

Defined cases: null and blank texts have no shingles, link with nothing and are
their own component; shorter texts are one shingle of all their words; rows with
a null id get the smallest id of their component, if it has any; rows with the
same id are separate nodes unless their sets are equal; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import among, chosen, cut, in_batches
from tarn.llm.components import components
from tarn.llm.text_bytes import mix, shingle_sets, slices, texts

#: Hashes of a signature, and the hashes of a band.  At a similarity of 0.75 a
#: pair shares none of the 32 bands with a probability of 5e-6.
HASHES, BAND = 128, 4
#: Share of equal minima below which a pair's full sets are not compared; at a
#: similarity of 0.75 that is over six standard deviations off.
LEAST_AGREEING = 0.5
#: Share of the open places in bands that a further round of leaders must settle
#: for another round to follow.
WORTHWHILE = 0.2
#: Nodes and shingles of a block, and shingles that a task counts at once.
BLOCK, BLOCK_SHINGLES, COLUMNS = 1024, 1 << 19, 4096

_RANDOM = np.random.default_rng(7)
MULTIPLIERS = _RANDOM.integers(0, 1 << 64, HASHES, dtype=np.uint64) | np.uint64(1)
OFFSETS = _RANDOM.integers(0, 1 << 64, HASHES, dtype=np.uint64)


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set of shingles; none for the empty set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def signatures(sets: list[np.ndarray]) -> list[bytes | None]:
    """Minima of (a x + b) >> 32 modulo 2**64 over each set, as 32-bit bytes."""
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    out: list[bytes | None] = [None] * len(sets)
    if not len(full):
        return out
    x = np.concatenate([sets[i] for i in full])
    starts = np.cumsum(sizes[full]) - sizes[full]
    minima = np.empty((len(full), HASHES), np.uint32)
    room = np.empty_like(x)
    for j in range(HASHES):
        np.multiply(x, MULTIPLIERS[j], out=room)
        np.add(room, OFFSETS[j], out=room)
        minima[:, j] = np.minimum.reduceat(room, starts) >> np.uint64(32)
    for row, i in zip(minima, full):
        out[i] = row.tobytes()
    return out


def sketches(rows: DataFrame, width: int) -> DataFrame:
    """Per row of (row_key, doc_id, text, mark): its set's size, key and signature."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, minima = [], [], []
            data = texts(batch.column(2))
            for first, last in slices(data):
                sets = shingle_sets(data[first:last], width)
                sizes += map(len, sets)
                keys += map(set_key, sets)
                minima += signatures(sets)
            arrays = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(minima, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], batch.column(3), *arrays],
                ["row_key", "doc_id", "mark", "n_shingles", "node", "signature"],
            )

    return rows.mapInArrow(
        read, "row_key long, doc_id long, mark long, n_shingles long, node binary, signature binary"
    )


def full_sets(rows: DataFrame, width: int) -> DataFrame:
    """Per row of (row_key, text): its node and the sorted hashes of its set."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = texts(batch.column(1))
            for first, last in slices(data):
                sets = [s for s in shingle_sets(data[first:last], width) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([set_key(s) for s in sets], pa.binary()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    ["node", "shingles"],
                )

    return rows.mapInArrow(read, "node binary, shingles binary")


def similar(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are ``percent`` alike or more."""

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32) for i in (2, 3))
            same = (one == other).reshape(-1, HASHES).mean(axis=1) >= LEAST_AGREEING
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(same))

    def overlapping(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                n = (len(one) + len(other)) // 8
                both = np.concatenate((np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)))
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (n - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def beside(df: DataFrame, column: str) -> DataFrame:
        return df.join(nodes.select(F.col("node").alias("a"), F.col(column).alias("one")), "a").join(
            nodes.select(F.col("node").alias("b"), F.col(column).alias("other")), "b"
        ).select("a", "b", "one", "other")

    schema = "a binary, b binary"
    return beside(beside(pairs, "signature").mapInArrow(agreeing, schema), "shingles").mapInArrow(
        overlapping, schema
    )


def common_counts(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of the intersections of sets before ``split`` with those from it on.

    Shingles of one set only are left out; the others become columns of zeros and
    ones, and their products are added up.
    """
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((split, len(sets) - split), np.float32)
    for first in range(0, int(shared.sum()), COLUMNS):
        low, high = np.searchsorted(column, (first, first + COLUMNS))
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[owner[low:high], column[low:high] - first] = 1
        out += held[:split] @ held[split:].T
    return out


def links_of_blocks(percent: int):
    """Links between two blocks, or inside one: a forest over their labels."""

    def read(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: not r["first"])
        sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
        split = sum(r["first"] for r in rows)
        if split == len(rows):  # one block with itself
            rows, sets = rows * 2, sets * 2
        sizes = np.array([len(x) for x in sets])
        common = common_counts(sets, split) if len(rows) > split > 0 else np.zeros((0, 0))
        union = sizes[:split, None] + sizes[None, split:] - common if common.size else common
        above: dict[bytes, bytes] = {}

        def top(x: bytes) -> bytes:
            while x in above:
                x = above[x]
            return x

        found = []
        for i, j in np.argwhere(100 * common >= percent * union):
            one, other = rows[i], rows[split + j]
            a, b = sorted((top(one["label"]), top(other["label"])))
            if a != b:
                above[b] = a
                found.append((one["node"], other["node"]))
        pairs = [(min(p), max(p)) for p in found]
        return pa.table({k: pa.array([p[i] for p in pairs], pa.binary()) for i, k in enumerate("ab")})

    return read


def block_links(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of bands, found block by block.

    ``members``, a cut table, has (node, band, label, n), n the members of a band.
    A node's home is the most crowded band that it or one it shares a band with is
    in, so that a group of near copies has few homes; homes are cut into blocks.
    Homes that share a band meet, whole and once, however many bands they share;
    that is more than the candidates, never less.
    """
    own = members.groupBy("node").agg(F.max(F.struct("n", "band")).alias("most"))
    best = cut(members.select("node", "band").join(own, "node").groupBy("band").agg(F.max("most").alias("most")))
    home = cut(
        members.join(best, "band")
        .groupBy("node", "label")
        .agg(F.max("most").alias("most"))
        .select("node", "label", F.col("most.band").alias("home"))
    )
    weight = F.greatest(F.count("*") / BLOCK, F.sum("shingles") / BLOCK_SHINGLES)
    blocks = cut(
        home.join(nodes.select("node", (F.octet_length("shingles") / 8).alias("shingles")), "node")
        .groupBy("home")
        .agg(F.ceil(weight).cast("int").alias("blocks"))
    )
    in_homes = cut(members.select("node", "band").join(home, "node").select("band", "home").distinct())
    other = in_homes.select("band", F.col("home").alias("other"))
    met = in_homes.join(other, "band").select("home", "other").distinct()
    theirs = blocks.select(F.col("home").alias("other"), F.col("blocks").alias("others"))
    dealt = (
        home.join(met.join(blocks, "home").join(theirs, "other"), "home")
        .withColumn("mine", F.struct("home", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        .withColumn("theirs", F.struct(F.col("other").alias("home"), "block"))
        .withColumn("one", F.least("mine", "theirs"))
        .withColumn("two", F.greatest("mine", "theirs"))
        .select("node", "label", "one", "two", (F.col("mine") == F.col("one")).alias("first"))
    )
    return (
        dealt.join(nodes.select("node", "shingles"), "node")
        .groupBy("one", "two")
        .applyInArrow(links_of_blocks(percent), "a binary, b binary")
    )


def node_links(rows: DataFrame, sketched: DataFrame, width: int, percent: int) -> DataFrame | None:
    """(node, label) of every node with a link; the label names its component."""
    nodes = (
        sketched.where("node IS NOT NULL")
        .groupBy("node")
        .agg(F.min("row_key").alias("row_key"), F.first("signature").alias("signature"))
    )
    band = F.explode(F.sequence(F.lit(0), F.lit(HASHES // BAND - 1)))
    banded = (
        nodes.select("node", "signature", band.alias("i"))
        .select("node", F.xxhash64("i", F.substring("signature", F.col("i") * BAND * 4 + 1, F.lit(BAND * 4))).alias("band"))
    )
    shared = cut(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"))
    members = cut(banded.join(shared, "band"))
    near = cut(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "row_key", "signature"))
    read = full_sets(among(rows.select("row_key", "text"), cut(near.select("row_key").distinct()), "row_key"), width)
    candidates = cut(near.select("node", "signature").join(read.groupBy("node").agg(F.first("shingles").alias("shingles")), "node"))

    labels, seed, before = None, 0, None
    while True:
        seed += 1
        if labels is None:
            known = members.withColumn("label", F.col("node"))
        else:
            known = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        open_bands = cut(
            known.groupBy("band")
            .agg(
                F.count("*").alias("n"),
                F.min("label").alias("low"),
                F.max("label").alias("high"),
                F.min(F.struct(F.xxhash64(F.lit(seed), "node").alias("h"), "node", "label")).alias("lead"),
            )
            .where("low <> high")
            .select("band", "n", F.col("lead.node").alias("leader"), F.col("lead.label").alias("leader_label"))
        )
        held = cut(known.join(open_bands, "band"))
        left = held.count()
        if not left:
            return labels
        last = seed > 2 and left > (1 - WORTHWHILE) * before
        before = left
        if last:
            found = block_links(held.select("node", "band", "label", "n"), candidates, percent)
        else:
            tried = held.where("label <> leader_label")
            pairs = tried.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
            found = similar(pairs, candidates, percent)
        links = found if labels is None else found.union(labels.where("node <> label").toDF("a", "b"))
        labels = components(links)
        if last:
            return labels
        members = held.where("node <> leader").select("node", "band")


def near_groups(
    docs: DataFrame,
    width: int = 5,
    percent: int = 75,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked where their sets of ``width``-word shingles are
    ``percent`` per cent alike or more; a component's smallest id is kept.
    """
    groups = marked_groups(docs, width, percent, id_col, text_col)
    return groups.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).drop("mark")


def marked_groups(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: doc_id, mark (a hash of the text), n_shingles, component_id."""
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col)
    rows = in_batches(docs).select(
        F.xxhash64(doc_id, text).alias("row_key"), doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark")
    )
    sketched = cut(sketches(rows, width))
    labels = node_links(rows, sketched, width, percent)
    by_node = sketched.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least_id"))
    if labels is None:
        labels = by_node.select("node", F.col("node").alias("label")).limit(0)
    named = by_node.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    component = cut(named.join(least, "label").select("node", "component_id"))
    found = (
        sketched.where("node IS NOT NULL")
        .join(component, "node")
        .select("doc_id", "mark", "n_shingles", "component_id")
    )
    alone = sketched.where("node IS NULL").select("doc_id", "mark", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(alone)


def one_of_each_group(
    docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one row of each near-duplicate group.

    Rows that share the kept id are told apart by a hash of their text: the least
    stays.  Texts without words are in no group; rows of them stay, one of those
    equal in id and text.
    """
    groups = cut(marked_groups(docs, width, percent, id_col, text_col))
    grouped = groups.where("n_shingles > 0 AND doc_id <=> component_id")
    kept = grouped.groupBy("doc_id").agg(F.min("mark").alias("mark"))
    alone = groups.where("n_shingles = 0").select("doc_id", "mark").distinct()
    return chosen(docs, kept.union(alone), id_col, text_col)
