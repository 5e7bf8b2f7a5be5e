"""Retrieval metrics in long form ``(metric, k, value)`` (M1-M5).

Everything is counted per bundle with partial aggregates and then averaged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stitchrank.operators.catalog import mark_hits, positives_histogram
from stitchrank.operators.embeddings import mean_regions
from stitchrank.operators.retrieve import topk


def _ks(ks: Sequence[int]) -> list[int]:
    usable = sorted({int(k) for k in ks if int(k) > 0})
    if not usable:
        raise ValueError("give at least one positive k")
    return usable


def _long(row: DataFrame, values: Sequence[tuple[str, int, Column]]) -> DataFrame:
    """One aggregate row turned into ``(metric, k, value)`` rows."""
    items = [
        F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k"), v.cast("double").alias("value")) for m, k, v in values
    ]
    return row.select(F.explode(F.array(*items)).alias("_m")).select("_m.*")


def bundle_hits(
    ranked: DataFrame, truth: DataFrame, ks: Sequence[int], scope: str = "all", bundles: DataFrame | None = None
) -> DataFrame:
    """Hits within each k and the first hit's rank, per bundle that has a truth.

    ``scope="all"`` keeps bundles without any prediction (their hits are 0), ``"predicted"``
    leaves them out, which flatters the means (M2). ``bundles`` restricts the evaluation.
    """
    if scope not in ("all", "predicted"):
        raise ValueError(f"unknown scope {scope!r}")
    pairs = truth.select("bundle_id", "product_id").distinct()
    if bundles is not None:
        pairs = pairs.join(bundles.select("bundle_id"), "bundle_id", "left_semi")
    sizes = pairs.groupBy("bundle_id").agg(F.count("*").alias("n_truth"))
    hits = mark_hits(ranked, pairs).groupBy("bundle_id").agg(
        *[F.count_if(F.col("hit") & (F.col("rank") <= k)).alias(f"hits_{k}") for k in ks],
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_hit"),
    )
    joined = sizes.join(hits, "bundle_id", "left" if scope == "all" else "inner")
    return joined.fillna(0, [f"hits_{k}" for k in ks])


def hit_recall(
    ranked: DataFrame, truth: DataFrame, ks: Sequence[int] = (5, 10, 15), scope: str = "all",
    bundles: DataFrame | None = None,
) -> DataFrame:
    """M1, M2: mean Hit@k and Recall@k, and the number of bundles they are means of."""
    ks = _ks(ks)
    per = bundle_hits(ranked, truth, ks, scope, bundles)
    row = per.agg(
        F.count("*").alias("n"),
        *[F.avg((F.col(f"hits_{k}") > 0).cast("double")).alias(f"hit_{k}") for k in ks],
        *[F.avg(F.col(f"hits_{k}") / F.col("n_truth")).alias(f"recall_{k}") for k in ks],
    )
    values = [("num_bundles_evaluated", 0, F.col("n"))]
    values += [(m, k, F.col(f"{m}_{k}")) for k in ks for m in ("hit", "recall")]
    return _long(row, values)


def _indexed(truth: DataFrame, index: DataFrame) -> DataFrame:
    return truth.join(index.select("product_id"), "product_id", "left_semi")


def ranking_metrics(
    ranked: DataFrame, truth: DataFrame, index: DataFrame, ks: Sequence[int] = (5, 10, 15),
    bundles: DataFrame | None = None,
) -> DataFrame:
    """M3: Recall@k, Hit@k and MRR at the largest k, the truth limited to indexed products."""
    ks = _ks(ks)
    per = bundle_hits(ranked, _indexed(truth, index), ks, "all", bundles)
    reciprocal = F.when(F.col("first_hit") <= ks[-1], F.lit(1.0) / F.col("first_hit")).otherwise(0.0)
    row = per.agg(
        F.count("*").alias("n"),
        *[F.avg((F.col(f"hits_{k}") > 0).cast("double")).alias(f"hit_{k}") for k in ks],
        *[F.avg(F.col(f"hits_{k}") / F.col("n_truth")).alias(f"recall_{k}") for k in ks],
        F.avg(reciprocal).alias("mrr"),
    )
    zero = F.lit(0.0)
    values = [("queries", 0, F.col("n")), ("mrr", ks[-1], F.coalesce("mrr", zero))]
    values += [(m, k, F.coalesce(F.col(f"{m}_{k}"), zero)) for k in ks for m in ("hit", "recall")]
    return _long(row, values)


def coverage(
    ranked: DataFrame, truth: DataFrame, ks: Sequence[int], max_k: int, bundles: DataFrame | None = None
) -> DataFrame:
    """M4: share of queries with a positive in the top k, and mean positives there.

    ``max_k`` is the pool size; every k is clamped to ``[1, max_k]``.
    """
    ks = sorted({min(max(1, int(k)), max_k) for k in ks})
    per = bundle_hits(ranked, truth, ks, "all", bundles)
    row = per.agg(
        F.count("*").alias("n"),
        *[F.avg((F.col(f"hits_{k}") > 0).cast("double")).alias(f"coverage_{k}") for k in ks],
        *[F.avg(f"hits_{k}").alias(f"pos_{k}") for k in ks],
    )
    values = [("queries", 0, F.col("n"))]
    for k in ks:
        values.append(("coverage", k, F.coalesce(F.col(f"coverage_{k}"), F.lit(0.0))))
        values.append(("avg_pos_in_top", k, F.coalesce(F.col(f"pos_{k}"), F.lit(0.0))))
    return _long(row, values)


def validate_regions(crops: DataFrame, index: DataFrame, truth: DataFrame, k: int = 15) -> tuple[DataFrame, DataFrame]:
    """M5: Recall@k of the mean region vector, and the histogram of positives per bundle."""
    queries = mean_regions(crops)
    known = _indexed(truth, index)
    ranked = topk(queries.select("bundle_id", "v"), index.select("product_id", "v"), k)
    metrics = hit_recall(ranked, known, [k], scope="predicted").filter(F.col("metric") != "hit")
    seen = known.join(queries.select("bundle_id"), "bundle_id", "left_semi")
    return metrics, positives_histogram(seen)
