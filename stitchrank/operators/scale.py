"""Distributed helpers shared by the operators: checkpoints, global order, seeded ranks."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Inner products are rounded to this many decimals before they are compared, so that equal
# vectors tie whatever the summation order was, and ids alone break the tie.
SIM_DECIMALS = 9
# Fused scores are put on a binary grid for the same reason. They are made of decimal
# similarities, weights and bonuses, which never fall half-way between two binary grid points;
# on a decimal grid they often would, and noise would decide.
SCORE_GRID = float(1 << 30)


def stable(score: Column) -> Column:
    """A fused score without the noise of the summation order."""
    return F.rint(score * F.lit(SCORE_GRID)) / F.lit(SCORE_GRID)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the session names it in ``spark.checkpoint.dir``.

    Only a session within one process (``local`` or ``local[n]``, not ``local-cluster``) may leave it unset; it
    then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0]
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="stitchrank-")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut; survives lost executors."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def global_position(df: DataFrame, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """Add the 0-based place of every row in the total order ``order``.

    A window without a partition key would pull all rows into one task. Here rows are
    range-sorted, numbered inside their partition, and shifted by the sizes of the
    partitions before. ``order`` must be total. The sorted rows are checkpointed, since
    both the sizes and the result must see the same partitions.
    """
    sorted_rows = checkpointed(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    # Layout of the generated id: partition number above bit 33, row number below.
    part = F.shiftright("_mid", 33)
    sizes = sorted_rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sort: bounded by the number of partitions.
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        sorted_rows.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mid", "_part", "_offset")
    )


HASH_DIGITS = 3  # hex digits of the digest that name a bucket: 4096 buckets


def hash_rank(df: DataFrame, key: str, seed: int, by: Sequence[str] = (), name: str = "hash_rank") -> DataFrame:
    """Add the 1-based rank of every row in seeded hash order, per stratum ``by``.

    Rank = rows in lower hash buckets + place inside the bucket, so that no task sees more
    than one bucket of one stratum. ``key`` must be unique.
    """
    digest = F.sha2(F.concat_ws("||", F.lit(str(seed)), F.col(key).cast("string")), 256)
    rows = df.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, HASH_DIGITS))
    strata = [*by, "_bucket"]
    counts = rows.groupBy(*strata).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most 16 ** HASH_DIGITS rows per stratum reach this window.
    offsets = counts.select(*strata, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy(*strata).orderBy("_digest"))
    return (
        rows.withColumn("_place", place)
        .join(offsets, strata)
        .withColumn(name, F.col("_offset") + F.col("_place"))
        .drop("_digest", "_bucket", "_place", "_offset")
    )
