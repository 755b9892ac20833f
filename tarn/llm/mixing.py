"""Mixing sources to target weights by Pareto order sampling.

A source's target, in words, is its share of the mix by weight, at most ``most``
times its own size.  A document is due copies in proportion to a weight of its own,
by default the root of its size, at most ``most``, so that the due copies of a
source make up its target.  The whole part of what a document is due is certain; the
rest p is its inclusion probability for one more copy.  Documents are ranked by
random odds over inclusion odds, U / (1 - U) over p / (1 - p), and taken in that
order until the source's words are used up: the sample's size is fixed in words, as
the targets are.  A document that no longer fits is passed over, and the order is
gone down again, ``PASSES`` times in all, so what stays open is a few words.

The order is cut without sorting a source: sizes are summed in ``BUCKETS`` equal
steps of the rank, the step where the running sum passes the rest is found, and
only that step's documents are put in order.

All of it is DataFrame operations.  Defined cases: a null text has size 0 and
takes 0; a null source is a source, last in order; documents of size 0 are taken
0 times; rows equal in id, source and text are separate documents with one rank,
and ``mixed_documents`` spreads their copies evenly over them; a long text counts
whole; an empty table gives no rows; other columns are ignored, or kept by
``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import cut, unused, word_count

#: Steps in which a source's ranks are summed.
BUCKETS = 1 << 16
#: Times that the order is gone down; after the first, for what still fits.
PASSES = 4
#: Classes of the documents' weights a doubling, for the level at which they are due.
CLASSES = 16


def targets(
    sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2
) -> DataFrame:
    """Per source of (source, size): source_size and target.

    The sources in order of code point, null last, weigh ``weights`` in turn.
    Reshared excess keeps to the weights, so the targets are the least of the cap
    and weight times one level; the level is where, with the sources in order of
    cap by weight, the capped ones and the rest make up the whole.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    cap = (F.col("source_size") * most).cast("double")
    every = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    return (
        per.withColumn("weight", weight.cast("double"))
        .withColumn("cap", cap)
        .withColumn("whole", F.sum("source_size").over(every) * percent / 100.0)
        .withColumn("capped", F.sum("cap").over(by_cap) - F.col("cap"))
        .withColumn("open", F.sum("weight").over(every) - F.sum("weight").over(by_cap) + F.col("weight"))
        .withColumn("level", (F.col("whole") - F.col("capped")) / F.col("open"))
        .withColumn("ends", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("level", F.max(F.when(F.col("ends"), F.col("level"))).over(every))
        .withColumn("target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")))
        .select("source", "source_size", "target")
    )


def uniform(seed: int, *columns: Column) -> Column:
    """A number in (0, 1) that only the columns and the seed decide."""
    bits = F.xxhash64(F.lit(seed), *columns).bitwiseAND((1 << 52) - 1)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def levels(sized: DataFrame, goals: DataFrame, most: int) -> DataFrame:
    """Per source of (source, size, weight): ``level``, copies due a unit of weight.

    A document is due min(most, level * weight); the level is null where all are due
    ``most``.  Weights count by classes, heaviest first: those before the level's
    class are due ``most``, the others in proportion.
    """
    classes = (
        sized.where("size > 0 AND weight > 0")
        .groupBy("source", F.floor(F.log2("weight") * CLASSES).alias("class"))
        .agg(
            F.sum("size").alias("words"),
            F.sum(F.col("size") * F.col("weight")).alias("weighed"),
            F.max("weight").alias("heaviest"),
        )
    )
    down = Window.partitionBy("source").orderBy(F.col("class").desc())
    heavier = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lighter = F.sum("weighed").over(down.rowsBetween(0, Window.unboundedFollowing))
    joined = classes.join(goals, F.col("source").eqNullSafe(F.col("goal_source")))
    return (
        joined.withColumn("level", (F.col("target") - most * heavier) / lighter)
        .where(F.col("level") * F.col("heaviest") <= most)
        .groupBy(F.col("source").alias("level_source"))
        .agg(F.max_by("level", "class").alias("level"))
    )


def filled(ranked: DataFrame) -> DataFrame:
    """``ranked`` with ``more`` set where the order, gone down once, takes a document.

    Open are documents not yet taken that fit in what their source still lacks.
    """
    used = F.sum(F.col("size") * (F.col("whole") + F.col("more")))
    gaps = cut(
        ranked.groupBy(F.col("source").alias("gap_source"))
        .agg((F.max("target") - used).alias("gap"))
        .where("gap >= 1")
    )
    at_hand = ranked.join(gaps, F.col("source").eqNullSafe(F.col("gap_source")), "left").withColumn(
        "open", F.coalesce((F.col("more") == 0) & F.col("rank").isNotNull() & (F.col("size") <= F.col("gap")), F.lit(False))
    )
    so_far = Window.partitionBy("source").orderBy("step")
    border = cut(
        at_hand.where("open")
        .groupBy("source", "step")
        .agg(F.sum("size").alias("words"), F.max("gap").alias("gap"))
        .withColumn("before", F.sum("words").over(so_far) - F.col("words"))
        .where("before <= gap")
        .groupBy(F.col("source").alias("border_source"))
        .agg(F.max(F.struct("step", "before")).alias("last"))
        .select("border_source", F.col("last.step").alias("border"), F.col("last.before").alias("before"))
    )
    placed = at_hand.join(border, F.col("source").eqNullSafe(F.col("border_source")), "left")
    in_order = Window.partitionBy("source").orderBy("rank", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.where("open AND step = border").withColumn(
        "more", (F.col("before") + F.sum("size").over(in_order) <= F.col("gap")).cast("long")
    )
    outside = placed.where("NOT open OR step <> border").withColumn(
        "more", F.when(F.col("open") & (F.col("step") < F.col("border")), 1).otherwise(F.col("more")).cast("long")
    )
    return cut(outside.select(ranked.columns).union(inside.select(ranked.columns)))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    percent: int = 150,
    most: int = 2,
    seed: int = 20240229,
    favour: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken,
    copies, due (expected copies), and mark, a hash of the text.

    A document's weight is its size to the power of ``favour``, or ``weight_col``,
    of which null and less than 0 count as 0, and 0 is due nothing.
    """
    text = F.col(text_col)
    size = word_count(text)
    weight = F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)) if weight_col else F.pow(size, F.lit(favour))
    sized = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).alias("source"),
            size.alias("size"),
            F.xxhash64(text).alias("mark"),
            weight.alias("weight"),
        )
    )
    goals = cut(targets(sized, weights, percent, most).withColumnRenamed("source", "goal_source"))
    known = cut(
        goals.join(levels(sized, goals, most), F.col("goal_source").eqNullSafe(F.col("level_source")), "left")
        .select("goal_source", "source_size", "target", "level")
    )
    due = F.when((F.col("size") > 0) & (F.col("weight") > 0), F.least(F.lit(float(most)), F.coalesce(F.col("level") * F.col("weight"), F.lit(float(most)))))
    u = uniform(seed, F.col("doc_id"), F.col("mark"))
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    ranked = cut(
        sized.join(known, F.col("source").eqNullSafe(F.col("goal_source")))
        .withColumn("due", F.coalesce(due, F.lit(0.0)))
        .withColumn("whole", F.floor("due"))
        .withColumn("p", F.col("due") - F.col("whole"))
        .withColumn("rank", F.when(F.col("p") > 0, odds / (1 + odds)))
        .withColumn("step", F.least(F.floor(F.col("rank") * BUCKETS), F.lit(BUCKETS - 1)))
        .withColumn("more", F.lit(0).cast("long"))
        .select("doc_id", "mark", "source", "size", "source_size", "target", "due", "whole", "rank", "step", "more")
    )
    for _ in range(PASSES):
        ranked = filled(ranked)
    copies = F.col("whole") + F.col("more")
    return ranked.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * copies).cast("long").alias("taken"),
        copies.cast("int").alias("copies"),
        "due",
        "mark",
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: a document taken twice is there twice."""
    id_col, text_col, source_col = (options.get(f"{x}_col", y) for x, y in (("id", "doc_id"), ("text", "text"), ("source", "source")))
    own_id, own_source, own_mark, mark, total, n, place, copy = unused(
        docs, "_id", "_source", "_own_mark", "_mark", "_total", "_n", "_place", "_copy"
    )
    taken = (
        mix(docs, **options)
        .groupBy(F.col("doc_id").alias(own_id), F.col("source").alias(own_source), F.col("mark").alias(own_mark))
        .agg(F.sum("copies").alias(total), F.count("*").alias(n))
        .where(F.col(total) > 0)
    )
    same = (
        F.col(id_col).cast("long").eqNullSafe(F.col(own_id))
        & F.col(source_col).eqNullSafe(F.col(own_source))
        & (F.col(mark) == F.col(own_mark))
    )
    row = F.row_number().over(Window.partitionBy(own_id, own_source, own_mark).orderBy(own_id))
    copies = F.floor((F.col(total) + F.col(n) - F.col(place)) / F.col(n)).cast("int")
    return (
        docs.withColumn(mark, F.xxhash64(text_col))
        .join(taken, same)
        .withColumn(place, row)
        .withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies)))
        .select(*docs.columns)
    )
