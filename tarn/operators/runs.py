"""Whole runs, from a work list to the merged table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.constants import EMBEDDING_VERSION, LAKE_WEIGHT
from tarn.operators import merges, pooling

KEYS = ["lake_id", "year"]


def todo(images: DataFrame, regions: DataFrame) -> DataFrame:
    """Images whose embedding is missing or stale."""
    return merges.work_list(images, regions, EMBEDDING_VERSION, "embedding_version")


def embedding_run(images: DataFrame, regions: DataFrame, tokens: DataFrame, lake_weight: float = LAKE_WEIGHT) -> DataFrame:
    """``regions`` after a run over the images whose embedding is missing or stale.

    ``tokens`` has the shares and vectors of each image's tokens, as
    ``token_fractions`` and ``encoded`` give them; only those of the work list are
    pooled and blended.  A new row is completed and has the image's time; an image
    without a lake vector is failed and holds no vectors.  Other rows stay.
    """
    wanted = todo(images, regions).select(*KEYS, "updated_at")
    vectors = pooling.blended(pooling.pooled(tokens.join(wanted, KEYS, "left_semi")), lake_weight)
    made = wanted.join(vectors, KEYS, "left").withColumn("embedding_version", F.lit(EMBEDDING_VERSION))
    good = F.col("lake_embedding").isNotNull() & F.col("embedding").isNotNull()
    done = made.withColumns(
        {
            **{c: F.when(good, F.col(c)) for c in ("embedding", "lake_embedding", "shore_embedding", "lake_weight")},
            "status": F.when(good, "completed").otherwise("failed"),
            "error_message": F.when(~good, "no valid lake pixels in any token"),
        }
    )
    return merges.merged(regions, done, KEYS)
