"""Disjoint validation splits and listwise training records.

Membership depends on the seeded hash of an id only, never on row order or partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stitchrank.operators.catalog import mark_hits
from stitchrank.operators.scale import hash_rank


def _val_size(n: Column, ratio: float) -> Column:
    """Half-even rounded share, at least 1."""
    return F.greatest(F.lit(1), F.rint(n * F.lit(ratio)).cast("bigint"))


def val_ids(ids: DataFrame, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """The validation ids, ``max(1, round(n * ratio))`` of the distinct ones."""
    key = ids.columns[0]
    distinct = ids.select(key).distinct()
    if ratio <= 0:
        return distinct.limit(0)
    n_val = _val_size(distinct.agg(F.count("*")).scalar(), ratio)
    return hash_rank(distinct, key, seed).filter(F.col("hash_rank") <= n_val).select(key)


def split_ids(ids: DataFrame, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Every distinct id with its ``split``; both sides are non-empty from two ids on."""
    key = ids.columns[0]
    distinct = ids.select(key).distinct()
    if ratio <= 0:
        return distinct.withColumn("split", F.lit("train"))
    n = distinct.agg(F.count("*")).scalar()
    n_val = F.when(n > 1, F.least(n - 1, _val_size(n, ratio))).otherwise(0)
    return hash_rank(distinct, key, seed).select(
        key, F.when(F.col("hash_rank") <= n_val, "val").otherwise("train").alias("split")
    )


def allocate(strata: DataFrame, ratio: float) -> DataFrame:
    """Validation slots per stratum ``(stratum, n)``.

    Each gets the floor of its share; the shortfall to the half-even rounded total goes to the
    largest remainder up to its capacity, then to the next.
    """
    share = F.col("n") * F.lit(ratio)
    base = strata.withColumn("base", F.floor(share).cast("bigint")).withColumn("remainder", share - F.col("base"))
    base = base.withColumn("capacity", F.col("n") - F.col("base"))
    totals = base.agg(
        F.struct(F.sum("n").alias("n"), F.sum("base").alias("base"))
    ).scalar()
    short = F.greatest(F.lit(0), F.rint(totals["n"] * F.lit(ratio)).cast("bigint") - totals["base"])
    # One row per stratum: the number of distinct label counts.
    before = Window.orderBy(F.desc("remainder"), F.asc("stratum")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("capacity").over(before), F.lit(0))
    extra = F.greatest(F.lit(0), F.least(F.col("capacity"), short - F.col("ahead")))
    return base.withColumn("ahead", ahead).select(
        "stratum", "n", (F.col("base") + extra).cast("bigint").alias("n_val")
    )


def stratified_split(records: DataFrame, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """``(bundle_id, stratum, split)``, stratified by the number of labels."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must be between 0 and 1")
    rows = records.select("bundle_id", F.size("labels").alias("stratum"))
    slots = allocate(rows.groupBy("stratum").agg(F.count("*").alias("n")), ratio)
    ranked = hash_rank(rows, "bundle_id", seed, by=["stratum"]).join(slots, "stratum")
    return ranked.select(
        "bundle_id", "stratum",
        F.when(F.col("hash_rank") <= F.col("n_val"), "val").otherwise("train").alias("split"),
    )


def split_pairs(links: DataFrame, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Links with a ``split`` that is the same for all links of a bundle.

    All links are training links when one side would be empty.
    """
    if ratio <= 0:
        return links.withColumn("split", F.lit("train"))
    distinct = links.select("bundle_id").distinct()
    n = distinct.agg(F.count("*")).scalar()
    wanted = _val_size(n, ratio)
    n_val = F.when((n > 1) & (wanted < n), wanted).otherwise(0)
    chosen = hash_rank(distinct, "bundle_id", seed).select(
        "bundle_id", F.when(F.col("hash_rank") <= n_val, "val").otherwise("train").alias("split")
    )
    return links.join(chosen, "bundle_id")


def listwise_records(candidates: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate rows with their ``positive`` mask, and counts of the queries dropped.

    ``truth`` is limited to indexed products. Queries without truth, without a positive in the
    pool, or with nothing but positives carry no signal and are dropped.
    """
    marked = mark_hits(candidates, truth).withColumnRenamed("hit", "positive")
    has_truth = truth.select("bundle_id").distinct().withColumn("_truth", F.lit(True))
    per = (
        marked.groupBy("bundle_id").agg(F.count("*").alias("_n"), F.count_if("positive").alias("_pos"))
        .join(has_truth, "bundle_id", "left")
    )
    reason = (
        F.when(F.col("_truth").isNull(), "no_truth")
        .when(F.col("_pos") == 0, "no_positive")
        .when(F.col("_pos") == F.col("_n"), "all_positive")
        .otherwise("usable")
    )
    per = per.withColumn("reason", reason)
    counts = per.groupBy("reason").agg(F.count("*").alias("queries"))
    usable = per.filter(F.col("reason") == "usable").select("bundle_id")
    return marked.join(usable, "bundle_id", "left_semi"), counts
