"""Writers: submissions, manifests, metrics, boxes, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stitchrank.operators.catalog import distinct_first


def write_submission(ranked: DataFrame, path: str, order: DataFrame | None = None, keep_rank: bool = False) -> None:
    """Two-column CSV, bundle by bundle in rank order.

    ``order`` (``bundle_id, pos``) gives the bundle order of the test template; without it
    bundles are sorted by id. The sort is distributed: the part files follow each other.
    """
    rows, by = ranked, ["bundle_id", "rank"]
    if order is not None:
        rows = ranked.join(distinct_first(order, "bundle_id", "pos"), "bundle_id")
        by = ["first_pos", "bundle_id", "rank"]
    columns = [F.col("bundle_id").alias("bundle_asset_id"), F.col("product_id").alias("product_asset_id")]
    if keep_rank:
        columns.append(F.col("rank"))
    rows.orderBy(*by).select(*columns).write.mode("overwrite").csv(path, header=True)


def manifest_rows(records: DataFrame, image_dir: str) -> DataFrame:
    """Records in manifest layout; ``records`` has labels and label indices."""
    return records.select(
        F.col("bundle_id").alias("bundle_asset_id"),
        F.coalesce(F.col("section").cast("string"), F.lit("")).alias("section_id"),
        F.concat_ws("/", F.lit(image_dir.rstrip("/")), F.concat("bundle_id", F.lit(".jpg"))).alias("image_path"),
        "labels",
        "label_indices",
    )


def write_manifest(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("overwrite").json(path)


def write_metrics(df: DataFrame, path: str, mode: str = "append") -> None:
    """Long-form metric, statistic or vocabulary rows as JSON lines."""
    df.write.mode(mode).json(path)


def write_boxes(df: DataFrame, path: str, mode: str = "append") -> None:
    """Newly detected boxes added to the cache folder."""
    df.write.mode(mode).parquet(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """Product or bundle vectors, with crop counts and features where the frame has them."""
    df.withColumn("v", F.col("v").cast("array<float>")).write.mode("overwrite").parquet(path)
