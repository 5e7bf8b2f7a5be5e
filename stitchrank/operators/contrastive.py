"""In-batch losses of (bundle, product) pairs: soft multi-positive cross entropy and the margin to the hardest negatives."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stitchrank.operators.scale import checkpointed, hash_rank

LOSSES = "batch bigint, pairs int, loss double, loss_products double, hard_loss double, hard_rows int"


def deal_batches(pairs: DataFrame, batch_size: int, seed: int = 42) -> DataFrame:
    """``pairs`` (bundle_id, product_id, ...) without repeats, with ``batch`` and ``row``: seeded hash order cut every ``batch_size`` pairs.

    Another seed deals another epoch. No batch but the last is short, and none is larger, whatever bundle or product is frequent.
    """
    key = F.concat_ws("||", F.col("bundle_id").cast("string"), F.col("product_id").cast("string"))
    ranked = hash_rank(pairs.dropDuplicates(["bundle_id", "product_id"]).withColumn("_key", key), "_key", seed, name="_rank")
    place = F.col("_rank") - 1
    return ranked.withColumn("batch", F.floor(place / batch_size)).withColumn("row", (place % batch_size).cast("int")).drop("_key", "_rank")


def soft_targets(rows: int, matches: np.ndarray) -> np.ndarray:
    """Row-normalised targets from (row, column) matches; a row without any has its own column."""
    targets = np.zeros((rows, rows))
    targets[matches[:, 0], matches[:, 1]] = 1.0
    alone = np.flatnonzero(targets.sum(axis=1) == 0)
    targets[alone, alone] = 1.0
    return targets / targets.sum(axis=1, keepdims=True)


def soft_cross_entropy(logits: np.ndarray, targets: np.ndarray) -> float:
    """Mean over rows of the cross entropy with probability targets."""
    top = logits.max(axis=1, keepdims=True)
    logs = logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True))
    return float(-(targets * logs).sum(axis=1).mean())


def margin_loss(sims: np.ndarray, targets: np.ndarray, k: int, margin: float) -> tuple[float, int]:
    """Mean of max(0, negative - positive + margin) over the ``k`` hardest negatives of the rows that have one, and their number.

    The positive score of a row is the mean similarity of its targets. A row with fewer than ``k`` negatives counts those it has.
    """
    negative = np.where(targets > 0, -np.inf, sims)
    k = min(k, sims.shape[1] - 1)
    valid = np.isfinite(negative).any(axis=1)
    if k <= 0 or not valid.any():
        return 0.0, 0
    hardest = -np.sort(-negative[valid], axis=1)[:, :k]
    gap = np.maximum(0.0, hardest - (sims * targets).sum(axis=1)[valid][:, None] + margin)
    real = np.isfinite(hardest)
    return float(gap[real].sum() / real.sum()), int(valid.sum())


def batch_losses(
    pairs: DataFrame, queries: DataFrame, index: DataFrame, truth: DataFrame, batch_size: int = 256, seed: int = 42,
    scale: float = 1 / 0.07, top_k: int = 16, margin: float = 0.2,
) -> DataFrame:
    """One row per batch: pairs, loss, loss_products, hard_loss, hard_rows.

    A batch is one block of similarities, ``batch_size`` squared at most, in one task. Column c is a target of row r if its
    product is a positive of r's bundle in ``truth``. ``loss`` is the soft cross entropy of the rows' scaled similarities,
    ``loss_products`` that of the columns', ``hard_loss`` the margin loss of the plain similarities, 0 in a
    batch without negatives. Pairs without a vector on both sides are left out before dealing. Only the truth of a batch's own bundles and
    products goes to it.
    """
    q = queries.select("bundle_id", F.col("v").cast("array<double>").alias("q")).where(F.col("v").isNotNull())
    p = index.select("product_id", F.col("v").cast("array<double>").alias("p")).where(F.col("v").isNotNull())
    known = pairs.select("bundle_id", "product_id").join(q.select("bundle_id"), "bundle_id", "left_semi").join(p.select("product_id"), "product_id", "left_semi")
    # Numbers are written before vectors are joined: both sides below see the same deal.
    dealt = checkpointed(deal_batches(known, batch_size, seed))
    rows = dealt.join(q, "bundle_id").join(p, "product_id")
    positives = truth.select("bundle_id", "product_id").distinct()
    matches = (
        dealt.select("batch", "row", "bundle_id").join(positives, "bundle_id")
        .join(dealt.select("batch", "product_id", F.col("row").alias("col")), ["batch", "product_id"])
        .select(F.col("batch").alias("of"), F.col("row").alias("r"), F.col("col").alias("c"))
    )

    def losses(key: tuple, block: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("row")
        sims = np.stack(block["q"].to_numpy()) @ np.stack(block["p"].to_numpy()).T
        targets = soft_targets(len(block), held[["r", "c"]].to_numpy(dtype=int))
        columns = soft_targets(len(block), held[["c", "r"]].to_numpy(dtype=int))
        hard, hard_rows = margin_loss(sims, targets, top_k, margin)
        values = (int(key[0]), len(block), soft_cross_entropy(scale * sims, targets), soft_cross_entropy(scale * sims.T, columns), hard, hard_rows)
        return pd.DataFrame([values], columns=["batch", "pairs", "loss", "loss_products", "hard_loss", "hard_rows"])

    return rows.groupBy("batch").cogroup(matches.groupBy("of")).applyInPandas(losses, LOSSES)


def epoch_loss(losses: DataFrame, hard_weight: float = 0.0) -> DataFrame:
    """Means over the batches of an epoch: loss, hard_loss and their weighted sum."""
    both = (F.col("loss") + F.col("loss_products")) / 2
    return losses.agg(F.avg(both).alias("loss"), F.avg("hard_loss").alias("hard_loss"), F.avg(both + F.lit(hard_weight) * F.col("hard_loss")).alias("total"))
