"""Vector tables: fusion of modalities, means over views and crops, standardising.

Means use the JVM-side ``Summarizer`` aggregate. It combines on the map side, so one key with
very many vectors shuffles one partial mean per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stitchrank.functions.vectors import NORM_FLOOR, add, as_double, l2_normalize, norm

VIEW_MIN_WEIGHT = 0.1


def fuse(img: DataFrame, txt: DataFrame, mode: str = "sum", alpha: float = 0.5) -> DataFrame:
    """Image and text vectors of an id as one unit vector; without text the image alone.

    ``sum`` adds, ``alpha`` weighs ``alpha`` to ``1 - alpha``, ``norm_sum`` normalises each first.
    """
    text = txt.select("id", F.col("v").alias("_t"))
    both = img.join(text, "id", "left")
    v, t = F.col("v"), F.col("_t")
    if mode == "sum":
        mixed = add(v, t)
    elif mode == "alpha":
        mixed = add(v, t, alpha, 1.0 - alpha)
    elif mode == "norm_sum":
        mixed = add(l2_normalize(v), l2_normalize(t))
    else:
        raise ValueError(f"unknown fusion mode {mode!r}")
    return both.withColumn("v", l2_normalize(F.coalesce(mixed, as_double(v)))).drop("_t")


def _mean(weight: Column | None = None) -> Column:
    vector = array_to_vector(as_double(F.col("v")))
    mean = Summarizer.mean(vector) if weight is None else Summarizer.mean(vector, weight)
    return vector_to_array(mean)


def mean_views(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean vector per key over its views, renormalised."""
    means = df.groupBy(*keys).agg(_mean().alias("v"), F.count("*").alias("n_views"))
    return means.withColumn("v", l2_normalize(F.col("v")))


def weighted_bundle_vector(crops: DataFrame, floor: float = VIEW_MIN_WEIGHT) -> DataFrame:
    """Confidence-weighted mean of a bundle's crops, renormalised; vanishing ones dropped."""
    weight = F.greatest(F.col("conf").cast("double"), F.lit(floor))
    means = crops.groupBy("bundle_id").agg(_mean(weight).alias("v"), F.count("*").alias("n_crops"))
    return means.filter(norm(F.col("v")) > NORM_FLOOR).withColumn("v", l2_normalize(F.col("v")))


def mean_regions(crops: DataFrame) -> DataFrame:
    """E5: plain mean of a bundle's region vectors, renormalised."""
    return mean_views(crops, ["bundle_id"]).withColumnRenamed("n_views", "n_regions")


def standardize(df: DataFrame, cols: Sequence[str], train: DataFrame) -> DataFrame:
    """Columns standardised by mean and population std of ``train``; a flat one keeps std 1."""
    moments = train.agg(
        F.struct(
            *[F.avg(c).alias(f"{c}_mean") for c in cols],
            *[F.stddev_pop(c).alias(f"{c}_std") for c in cols],
        )
    ).scalar()

    def scaled(c: str) -> Column:
        std = moments[f"{c}_std"]
        return (F.col(c) - moments[f"{c}_mean"]) / F.when(std < 1e-6, 1.0).otherwise(std)

    return df.withColumns({c: scaled(c) for c in cols})


def fit_width(features: Column, dim: int) -> Column:
    """A feature array cut or zero-padded to ``dim`` entries; zeros when missing."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    return F.slice(F.concat(F.coalesce(as_double(features), F.array().cast("array<double>")), zeros), 1, dim)
