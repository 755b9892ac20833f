"""Repair of damaged conversations by cheapest edits.

A conversation's rows, in turn order, are edited until its roles' initials read
``(s?(ua)+)?``.  Edits are arcs of a graph whose nodes are (rows gone by, state of
that pattern).  Minimum costs from the start (forward) and to the end (backward)
tell all arcs that lie on a cheapest path: those where forward cost, own cost and
backward cost sum up to the whole.  From the set of start nodes, each step takes the
least letter among the tight arcs out of its frontier, so of all cheapest edits the
ASCII-least string comes out; a prefix is less than what it begins.

Large conversations: rows are dealt out by ranges of (conversation, turn), so one that
holds most rows spans many partitions.  A partition's rows of one conversation act on
costs as a 4 x 4 matrix (minimum of sums), and the driver multiplies the matrices of
those conversations that cross a partition's edge: two a partition at most, whatever
the number of rows.  Every partition then knows the costs at its own edges and walks
its own rows.  A task holds the rows of one conversation in one partition at a time.
A digest of a whole conversation is one pass over its text by definition: the pieces
of those that cross an edge are streamed through one task in order, a megabyte at a
time.  A letter for each edit is part of the result, so that row grows with its
conversation.

Defined cases: a null text, role, id or turn is one space where it is read as text;
a null turn comes before others and counts for no gap; rows of one turn are in order
of role, then of the text's SHA-256; rows with a null id are one conversation; of
equal rows the first counts and the others are duplicates; an empty or blank text is
blank; other roles than those of the pattern can only be changed or deleted; a
conversation without rows is whole at no cost; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import cut, in_batches

FAR = 1 << 60
#: States of the pattern: nothing yet, after s, after u, after a; and where it may end.
STATES, WHOLE = range(4), (0, 3)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLE = {2: "user", 3: "assistant"}
RIGHT_PAIRS = ("su", "ua", "au")
#: Faults of a row.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
RELABEL, DELETE, INSERT, UNFINISHED = 2, 3, 2, 1
#: Bytes of repaired text in a row that travels.
PIECE = 1 << 20

Matrix = tuple[tuple[int, ...], ...]
Arc = tuple[str, int, int]


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows after damage, n of each; 0 if dropped."""
    spelled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    harm = F.crc32(F.encode(F.concat(spelled[0], F.lit(":"), spelled[1]), "UTF-8")) % 20
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(harm == 4, "user").otherwise(spelled[2]).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.regexp_replace(spelled[3], "[.!?]", "")).otherwise(spelled[3]).alias("text"),
        F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def ordered(rows: DataFrame) -> DataFrame:
    """Runs of equal rows in order, over partitions by ranges, cut.

    Columns: part, conv_id, turn, role, text, n, fault.  ``fault`` is of a run's
    first row; the rows after it are duplicates, or blank.
    """
    runs = (
        rows.withColumn("digest", F.sha2("text", 256))
        .groupBy("conv_id", "turn", "role", "digest")
        .agg(F.first("text").alias("text"), F.sum("n").alias("n"))
    )
    place = F.struct(F.col("turn").isNotNull().alias("has_turn"), "turn")
    seen = (
        runs.where("n > 0")
        .groupBy("conv_id", "role", "digest")
        .agg(F.min(place).alias("first"), F.count("*").alias("uses"))
        .where("uses > 1")
        .select(*(F.col(c).alias("s_" + c) for c in ("conv_id", "role", "digest")), "first")
    )
    same = F.col("conv_id").eqNullSafe(F.col("s_conv_id")) & (F.col("role") == F.col("s_role")) & (F.col("digest") == F.col("s_digest"))
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK)
        .when(F.col("first") < place, DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED)
        .otherwise(SOUND)
    )
    order = ["conv_id", "turn", "role", "digest"]
    return cut(
        runs.join(seen, same, "left")
        .select(*order, "text", "n", fault.alias("fault"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(F.spark_partition_id().alias("part"), "conv_id", "turn", "role", "text", "n", "fault")
    )


def arcs_of(fault: int, initial: str) -> list[list[Arc]]:
    """(letter, next state, cost) of the edits that use up a row, for each state."""
    extra = UNFINISHED if fault == TRUNCATED else 0
    out = []
    for state in STATES:
        own = [("D", state, DELETE)]
        if fault not in (BLANK, DUPLICATE):
            if (state, initial) in STEP:
                own.append(("K", STEP[state, initial], extra))
            own += [("R", STEP[state, role], RELABEL + extra) for role in "ua" if (state, role) in STEP]
        out.append(own)
    return out


INSERTS = [[("I", STEP[state, role], INSERT) for role in "ua" if (state, role) in STEP] for state in STATES]


def product(left: Matrix, right: Matrix) -> Matrix:
    """The costs of going through ``left``, then ``right``."""
    return tuple(tuple(min(map(sum, zip(row, column))) for column in zip(*right)) for row in left)


def inserting() -> Matrix:
    """The least cost of inserts that lead from one state to another."""
    one = tuple(
        tuple(min([0 if p == q else FAR] + [c for _, to, c in INSERTS[p] if to == q]) for q in STATES) for p in STATES
    )
    return product(one, one)


FREE = inserting()
END: Matrix = product(FREE, tuple((0 if state in WHOLE else FAR,) for state in STATES))
ARCS = {(fault, initial): arcs_of(fault, initial) for fault in range(4) for initial in ("s", "u", "a", "")}
ROWS = {
    kind: product(FREE, tuple(tuple(min([c for _, to, c in arcs[p] if to == q], default=FAR) for q in STATES) for p in STATES))
    for kind, arcs in ARCS.items()
}

Kind = tuple[int, str]


def matrix(kinds: list[Kind]) -> Matrix:
    """What rows, and inserts before each, cost from state to state."""
    out: Matrix = tuple(tuple(0 if p == q else FAR for q in STATES) for p in STATES)
    for kind in kinds:
        out = product(out, ROWS[kind])
    return out


def edits(kinds: list[Kind], costs: tuple[int, ...], after: tuple[int, ...] | None, start: set[int]) -> tuple[list[tuple[str, int]], set[int], int]:
    """(edits, last frontier, whole cost) of rows from a frontier of states.

    ``costs`` are those of reaching each state before the rows.  ``after`` are those
    of getting from each state to the end once the rows are gone by; None where the
    rows end the conversation.  An edit is its letter and the state it leads to.
    """
    forward = [product((costs,), FREE)[0]]
    for kind in kinds:
        costs = product((costs,), ROWS[kind])[0]
        forward.append(product((costs,), FREE)[0])
    backward = [END if after is None else tuple((c,) for c in after)]
    for kind in reversed(kinds):
        backward.append(product(ROWS[kind], backward[-1]))
    backward.reverse()
    whole = min(f + b[0] for f, b in zip(forward[0], backward[0]))
    out: list[tuple[str, int]] = []
    at, frontier = 0, start
    while at < len(kinds) or after is None and not any(s in WHOLE and forward[at][s] == whole for s in frontier):
        best: dict[str, set[int]] = {}
        for state in frontier:
            for letter, to, cost in INSERTS[state] + (ARCS[kinds[at]][state] if at < len(kinds) else []):
                if forward[at][state] + cost + backward[at if letter == "I" else at + 1][to][0] == whole:
                    best.setdefault(letter, set()).add(to)
        letter = min(best)
        frontier = best[letter]
        # From one state a letter leads to one other, so the frontier that begins with one stays one.
        out.append((letter, min(frontier)))
        at += letter != "I"
    return out, frontier, whole


Row = tuple[int | None, str, str, int]


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, list[Row]]]:
    """(part, conv_id, rows of turn, role, text and fault) of a partition, in order."""

    def runs() -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    for (part, conv_id), own in groupby(runs(), lambda r: (r["part"], r["conv_id"])):
        rows = []
        for r in own:
            again = BLANK if r["fault"] == BLANK else DUPLICATE
            row = (r["turn"], r["role"], r.get("text"))
            rows += [(*row, r["fault"])] * min(r["n"], 1) + [(*row, again)] * (r["n"] - 1)
        yield part, conv_id, rows


def kinds_of(rows: list[Row]) -> list[Kind]:
    return [(fault, role[:1] if role[:1] in ("s", "u", "a") else "") for _, role, _, fault in rows]


def edges(rows: DataFrame) -> list[tuple[int | None, list[tuple[int, Matrix]]]]:
    """Conversations that cross a partition's edge: (conv_id, matrices by partition).

    A partition passes on its first and its last conversation only.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for part, conv_id, own in conversations(batches):
            last = (part, conv_id, kinds_of(own))
            first = first or last
        found = [first] if first is last else [first, last]
        for part, conv_id, kinds in filter(None, found):
            costs = sum(matrix(kinds), ())
            yield pa.RecordBatch.from_pylist([{"part": part, "conv_id": conv_id, "costs": list(costs)}], pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("costs", pa.list_(pa.int64()))]))

    found: dict[int | None, list[tuple[int, Matrix]]] = {}
    for r in rows.drop("text").mapInArrow(read, "part int, conv_id long, costs array<long>").collect():
        found.setdefault(r["conv_id"], []).append((r["part"], tuple(tuple(r["costs"][4 * q : 4 * q + 4]) for q in STATES)))
    return [(conv_id, sorted(own)) for conv_id, own in found.items() if len(own) > 1]


Place = tuple[int, int | None]
Costs = tuple[tuple[int, ...], tuple[int, ...] | None]


def costs_at_edges(crossing: list[tuple[int | None, list[tuple[int, Matrix]]]]) -> dict[Place, Costs]:
    """(costs before, costs after) of each partition's share of a conversation."""
    out: dict[Place, Costs] = {}
    for conv_id, own in crossing:
        before: list[tuple[int, ...]] = [(0, FAR, FAR, FAR)]
        for _, costs in own:
            before.append(product((before[-1],), costs)[0])
        after: tuple[int, ...] | None = None
        for at in reversed(range(len(own))):
            out[own[at][0], conv_id] = (before[at], after)
            after = tuple(row[0] for row in product(own[at][1], END if after is None else tuple((c,) for c in after)))
    return out


def starts_at_edges(rows: DataFrame, crossing: list, costs: dict[Place, Costs]) -> dict[Place, int]:
    """The state in which each share of a crossing conversation is entered."""
    inner = {(part, conv_id) for conv_id, own in crossing for part, _ in own[:-1]}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, conv_id, own in conversations(batches):
            if (part, conv_id) in inner:
                before, after = costs[part, conv_id]
                kinds, ends = kinds_of(own), []
                tight = product(matrix(kinds), tuple((c,) for c in after))
                whole = min(f + b[0] for f, b in zip(before, tight))
                for state in STATES:
                    on_path = before[state] + tight[state][0] == whole
                    ends.append(min(edits(kinds, before, after, {state})[1]) if on_path else -1)
                yield pa.RecordBatch.from_pylist([{"part": part, "conv_id": conv_id, "ends": ends}], pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("ends", pa.list_(pa.int32()))]))

    found = {}
    if inner:
        found = {(r["part"], r["conv_id"]): r["ends"] for r in rows.drop("text").mapInArrow(read, "part int, conv_id long, ends array<int>").collect()}
    out = {}
    for conv_id, own in crossing:
        state = 0
        for part, _ in own:
            out[part, conv_id] = state
            state = found[part, conv_id][state] if (part, conv_id) in found else -1
    return out


COUNTS = ["blank", "duplicate", "truncated", "illegal"]
SHARES = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int32())]
    + [(c, pa.int64()) for c in [*COUNTS, "least", "most", "turns", "cost"]]
    + [(c, pa.string()) for c in ("first_role", "last_role", "audit")]
    + [("lines", pa.int64()), ("body", pa.binary()), ("repaired_sha256", pa.string())]
)
SHARE_COLUMNS = "conv_id long, part int, piece int, blank long, duplicate long, truncated long, illegal long, least long, most long, turns long, cost long, first_role string, last_role string, audit string, lines long, body binary, repaired_sha256 string"


def share(rows: list[Row], done: list[tuple[str, int]], whole: int) -> tuple[dict, Iterator[tuple[str, list[bytes]]]]:
    """(counts of a share of a conversation, its letters and lines in pieces)."""
    faults = [r[3] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    counts = {
        "blank": faults.count(BLANK),
        "duplicate": faults.count(DUPLICATE),
        "truncated": faults.count(TRUNCATED),
        "illegal": sum(a + b not in RIGHT_PAIRS for a, b in zip(initials, initials[1:])),
        "least": min(turns, default=None),
        "most": max(turns, default=None),
        "turns": len(set(turns)),
        "cost": whole,
        "first_role": initials[0] if rows else None,
        "last_role": initials[-1] if rows else None,
    }

    def pieces() -> Iterator[tuple[str, list[bytes]]]:
        at, letters, lines, size = 0, [], [], 0
        for letter, state in done:
            letters.append(letter)
            role, text = ROLE.get(state), ""
            if letter != "I":
                _, own, text, _ = rows[at]
                role = own if letter == "K" else role
                at += 1
            if letter != "D":
                lines.append(f"{role}:{text}".encode("utf-8", "surrogatepass"))
                size += len(lines[-1])
            if size > PIECE or len(letters) > PIECE:
                yield "".join(letters), lines
                letters, lines, size = [], [], 0
        yield "".join(letters), lines

    return counts, pieces()


def shares(rows: DataFrame, costs: dict[Place, Costs], starts: dict[Place, int]) -> DataFrame:
    """Counts, letters and either the digest or the pieces of repaired text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for part, conv_id, own in conversations(batches):
            crosses = (part, conv_id) in costs
            before, after = costs.get((part, conv_id), ((0, FAR, FAR, FAR), None))
            done, _, whole = edits(kinds_of(own), before, after, {starts.get((part, conv_id), 0)})
            counts, pieces = share(own, done, whole)
            row = {"conv_id": conv_id, "part": part, "piece": 0} | counts
            if not crosses:
                letters, every = [], sha256()
                glue = b""
                for audit, lines in pieces:
                    letters.append(audit)
                    if lines:
                        every.update(glue + b"\n".join(lines))
                        glue = b"\n"
                held.append(row | {"audit": "".join(letters), "repaired_sha256": every.hexdigest()})
            else:
                for at, (audit, lines) in enumerate(pieces):
                    body = {"piece": at, "audit": audit, "lines": len(lines), "body": b"\n".join(lines)}
                    yield pa.RecordBatch.from_pylist([row | body], SHARES)
            if len(held) >= 1024:
                yield pa.RecordBatch.from_pylist(held, SHARES)
                held = []
        yield pa.RecordBatch.from_pylist(held, SHARES)

    return rows.mapInArrow(read, SHARE_COLUMNS)


RESULT = pa.schema(
    [(c, pa.int64()) for c in ("conv_id", "gaps", *COUNTS, "cost")] + [(c, pa.string()) for c in ("audit", "repaired_sha256")]
)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations from their shares and pieces, which come in order."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    held = []
    for conv_id, own in groupby(rows(), lambda r: r["conv_id"]):
        total = dict.fromkeys(COUNTS, 0) | {"conv_id": conv_id}
        least = most = last_role = digest = None
        turns, letters, every, glue = 0, [], sha256(), b""
        for r in own:
            letters.append(r["audit"])
            total["cost"] = r["cost"]
            digest = r["repaired_sha256"]
            if r["lines"]:
                every.update(glue + r["body"])
                glue = b"\n"
            if r["piece"]:
                continue
            for c in COUNTS:
                total[c] += r[c]
            if r["first_role"] is not None:
                total["illegal"] += last_role is not None and last_role + r["first_role"] not in RIGHT_PAIRS
                last_role = r["last_role"]
            if r["least"] is not None:
                turns += r["turns"] - (most == r["least"])
                least = r["least"] if least is None else least
                most = r["most"]
        total["gaps"] = 0 if least is None else most - least + 1 - turns
        held.append(total | {"audit": "".join(letters), "repaired_sha256": digest or every.hexdigest()})
        if len(held) >= 1024:
            yield pa.RecordBatch.from_pylist(held, RESULT)
            held = []
    yield pa.RecordBatch.from_pylist(held, RESULT)


def mended(rows: DataFrame) -> DataFrame:
    """Faults and cheapest edits of each conversation of (conv_id, turn, role, text, n).

    ``n`` is how many rows alike there are; a conversation all of whose n are 0 is
    one without rows.
    """
    runs = ordered(rows)
    crossing = edges(runs)
    costs = costs_at_edges(crossing)
    found = shares(runs, costs, starts_at_edges(runs, crossing, costs))
    return (
        found.repartition("conv_id")
        .sortWithinPartitions("conv_id", "part", "piece")
        .mapInArrow(gathered, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    )


def repaired(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) damaged by a fixed rule, then mended."""
    return mended(damaged(in_batches(rows)))
