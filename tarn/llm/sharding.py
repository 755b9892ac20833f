"""Sharding by vector bin packing over bytes, tokens and rows.

Documents of equal text form a group, and groups are the items.  So that the
packing sees a bounded number of items, groups up to a fine share of a shard are
gathered in parcels by a hash of their text; larger groups, of which there can
only be so many, are items of their own, and a group above a shard's fair share
is first split into parts by a hash of the id.  Items are placed largest first,
each in the shard where the dot product of its vector with the shard's residual
capacity is highest.

The law of the result is ``bytes``.  Defined cases: a null text counts one byte
and no token and groups with empty texts; null ids are ids; items of one size are
placed in order of their sums and name, and the first of equally good shards is
taken; a long text is encoded whole; an empty table gives no rows; other columns are
ignored; rows equal in id and text differ in slot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import cut, in_batches
from tarn.llm.packing import encoder

#: Parcels a shard: the packing's grain.
GRAIN = 256
#: How much each dimension counts in the dot product: the law is ``bytes``.
EMPHASIS = np.array([16.0, 1.0, 1.0])
#: Parts a shard in which slots are counted.
SLOT_PARTS = 256


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each row of ``items`` (its bytes, tokens and rows)."""
    total = items.sum(axis=0)
    shares = items / np.where(total, total, 1)
    residual = np.full((shards, items.shape[1]), 1.0 / shards)
    out = np.empty(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -shares.sum(axis=1), -items[:, 0])):
        out[i] = np.argmax(residual @ (EMPHASIS * shares[i]))
        residual[out[i]] -= shares[i]
    return out


def measured(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, ranks: str) -> DataFrame:
    """Per document: doc_id, size, tokens, text_crc32 and group, a digest of its text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        for batch in batches:
            sizes, tokens, sums, groups = [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                data = text.encode("utf-8", "surrogatepass")
                sizes.append(len(data) + 1)
                tokens.append(len(encode.encode(text)) // 4)
                sums.append(crc32(data))
                groups.append(hashlib.sha256(data).hexdigest())
            encode.forget()
            arrays = [pa.array(x, pa.int64()) for x in (sizes, tokens, sums)] + [pa.array(groups, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "size", "tokens", "text_crc32", "group"])

    rows = in_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(read, "doc_id long, size long, tokens long, text_crc32 long, group string")


def shard(
    docs: DataFrame,
    shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.json",
    ranks: str = "byte_bpe_50k.tiktoken",
) -> DataFrame:
    """One row per document: doc_id, size, tokens, text_crc32, law, shard, slot, grown_shard.

    The driver sees at most ``shards * GRAIN`` parcels and twice as many large
    groups or parts, as each of those holds that share of a dimension or more.
    """
    spark = docs.sparkSession
    sized = cut(measured(docs, id_col, text_col, vocabulary, ranks))
    whole = sized.agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")).first()
    if not whole["n"]:
        return sized.select(
            "doc_id", "size", "tokens", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"),
            F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    parcel_bytes = max(1, whole["size"] // (shards * GRAIN))
    parcel_rows = max(1, whole["n"] // (shards * GRAIN))
    fair = max(1, whole["size"] // shards)

    groups = sized.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    large = cut(
        groups.where((F.col("bytes") > parcel_bytes) & ((F.col("bytes") > 1) | (F.col("rows") > parcel_rows)))
        .select(
            F.col("group").alias("large_group"),
            F.when(F.col("bytes") > fair, F.ceil(F.col("bytes") / F.lit(parcel_bytes))).otherwise(1).alias("parts"),
        )
    )
    parcel = F.when(
        F.col("large_group").isNotNull(),
        F.concat_ws("/", "group", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("parts"))),
    ).otherwise(F.pmod(F.xxhash64("group"), F.lit(shards * GRAIN)).cast("string"))
    dealt = sized.join(large, F.col("group") == F.col("large_group"), "left").withColumn("parcel", parcel)
    sums = (
        dealt.groupBy("parcel")
        .agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
        .orderBy("parcel")
        .collect()
    )
    placed = place(np.array([(r["size"], r["tokens"], r["n"]) for r in sums], float), shards)
    plan = spark.createDataFrame(
        [(r["parcel"], int(s)) for r, s in zip(sums, placed)], "to_parcel string, shard int"
    )
    parts = shards * SLOT_PARTS
    seated = dealt.join(F.broadcast(plan), F.col("parcel") == F.col("to_parcel")).withColumn(
        "part", F.pmod(F.xxhash64("doc_id"), F.lit(parts))
    )
    before = Window.partitionBy("in_shard").orderBy("in_part").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        seated.groupBy(F.col("shard").alias("in_shard"), F.col("part").alias("in_part"))
        .agg(F.count("*").alias("n"))
        .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    row = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    return (
        seated.withColumn("row", row)
        .join(base, (F.col("shard") == F.col("in_shard")) & (F.col("part") == F.col("in_part")))
        .select(
            "doc_id",
            "size",
            "tokens",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("base") + F.col("row") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
