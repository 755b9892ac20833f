"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One word of a text, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch that a Python task holds at once; one row may be more.
BATCH_BYTES = 4 << 20
#: Rows of keys up to which they are broadcast; beyond it the join shuffles.
BROADCAST_KEYS = 200_000


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The folder is the cluster's ``spark.checkpoint.dir``.  Where that is unset, a
    local session takes a temporary folder; on a cluster that is an error, as
    executors do not share such a folder and a lost one would take it along.
    What led to ``df`` is garbage then: the driver collects it at once, so that
    executors let go of its shuffle files, which would else pile up over many
    rounds.  ``spark.cleaner.referenceTracking.cleanCheckpoints`` lets Spark
    delete the files of cuts that are no longer referred to.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tarn-checkpoint-"))
    out = df.checkpoint()
    gc.collect()
    context._jvm.System.gc()
    return out


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of its session held to ``BATCH_BYTES``.

    A batch is rows or bytes, whichever fills first; long texts would else make
    batches of many times the size that a task needs.  A smaller setting stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) in ("67108864b", "64MB", "67108864"):
        conf.set(name, f"{BATCH_BYTES}b")
    return df


def among(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is one of the distinct ``keys``, a cut table.

    Few keys are broadcast, so that ``df`` stays where it is read; more shuffle.
    """
    few = keys.count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if few else keys, column, "left_semi")


def chosen(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each distinct (doc_id, mark) of ``keys``.

    ``mark`` is the hash of the text as it stands, so rows of one id are told
    apart, and of rows equal in both one is returned.
    """
    own_id, own_mark, mark, place = unused(docs, "_chosen_id", "_chosen_mark", "_mark", "_place")
    wanted = keys.select(F.col("doc_id").alias(own_id), F.col("mark").alias(own_mark))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & (F.col(mark) == F.col(own_mark))
    first = F.row_number().over(Window.partitionBy(own_id, own_mark).orderBy(own_id))
    return (
        docs.withColumn(mark, F.xxhash64(text_col))
        .join(wanted, same)
        .withColumn(place, first)
        .where(F.col(place) == 1)
        .select(*docs.columns)
    )


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Words of ``text``; 0 for null."""
    marks = F.regexp_replace(text, WORD + r"[\x20\x09-\x0D]*", "w")
    blanks = F.length(F.regexp_extract(marks, r"^[\x20\x09-\x0D]*", 0))
    return F.coalesce(F.length(marks) - blanks, F.lit(0)).cast("long")


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null stays null."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % modulus


def numbered(
    df: DataFrame, key: str, order: list[str], name: str, salts: int = 256
) -> DataFrame:
    """Add ``name``: a gapless number from 0 within each ``key``.

    Rows of a key are spread over ``salts`` parts by a hash of ``order``; each
    part is numbered by itself and lifted by the count of the parts before it,
    so a key that holds most rows is never one task's work.  ``order`` should
    identify a row; rows equal in it are numbered in any order.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        salted.groupBy(key, "_salt")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select(F.col(key).alias("_key"), F.col("_salt").alias("_part"), "_base")
    )
    part = Window.partitionBy(key, "_salt").orderBy(*order)
    return (
        salted.withColumn("_at", F.row_number().over(part) - 1)
        .join(base, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_part")))
        .withColumn(name, (F.col("_at") + F.col("_base")).cast("long"))
        .drop("_salt", "_at", "_key", "_part", "_base")
    )
