"""Filters and rerankers over ranked lists.

A ranked frame has ``(bundle_id, product_id, score)`` and, after a cut, ``rank`` from 1.
Order is always ``score DESC, product_id ASC``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stitchrank.functions.text import category_key
from stitchrank.functions.urltime import calendar_keys, delta_hours
from stitchrank.functions.vectors import l2_normalize
from stitchrank.operators.scale import stable


def _best(*partition: str | Column):
    return Window.partitionBy(*partition).orderBy(F.desc("score"), F.asc("product_id"))


def score_threshold(ranked: DataFrame, threshold: float) -> DataFrame:
    """F1: keep scores at or above ``threshold``; off when it is not positive."""
    return ranked.filter(F.col("score") >= threshold) if threshold > 0 else ranked


def section_filter(ranked: DataFrame, bundles: DataFrame | None = None, products: DataFrame | None = None) -> DataFrame:
    """drop products whose known section differs from the known section of the bundle.

    Without ``bundles`` / ``products``, ``section`` / ``gender`` are columns of ``ranked``.
    """
    if bundles is not None:
        ranked = ranked.join(bundles.select("bundle_id", "section"), "bundle_id", "left")
    if products is not None:
        ranked = ranked.join(products.select("product_id", "gender"), "product_id", "left")
    section, gender = F.coalesce("section", F.lit(0)), F.coalesce("gender", F.lit(0))
    return ranked.filter((section == 0) | (gender == 0) | (gender == section))


def _with_category(ranked: DataFrame, products: DataFrame | None) -> DataFrame:
    if products is not None:
        keyed = products.select("product_id", category_key(F.col("description")).alias("category"))
        ranked = ranked.join(keyed, "product_id", "left")
    return ranked.withColumn("category", F.coalesce("category", F.lit("")))


def _category_place() -> Column:
    # Products without a category each form a group of their own, so they are never capped.
    alone = F.when(F.col("category") == "", F.col("product_id"))
    return F.row_number().over(_best("bundle_id", "category", alone))


def category_cap(ranked: DataFrame, n: int = 2, products: DataFrame | None = None) -> DataFrame:
    """at most ``n`` products per bundle and category; empty category uncapped."""
    if n <= 0:
        return ranked
    ranked = _with_category(ranked, products)
    return ranked.withColumn("_place", _category_place()).filter(F.col("_place") <= n).drop("_place")


def category_cap_backfill(
    ranked: DataFrame, n: int = 2, max_products: int = 60, products: DataFrame | None = None
) -> DataFrame:
    """F3, then short lists filled up with the skipped products, behind the capped ones.

    Nothing beyond place ``n + max_products`` of its category can be reached, which lets the
    first window drop rows before its shuffle.
    """
    ranked = _with_category(ranked, products)
    placed = ranked.withColumn("_place", _category_place()).filter(F.col("_place") <= n + max_products)
    order = Window.partitionBy("bundle_id").orderBy(
        (F.col("_place") > n).asc(), F.desc("score"), F.asc("product_id")
    )
    return placed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max_products).drop("_place")


def ts_adjustment(
    bundle_ts: Column,
    product_ts: Column,
    weight: float = 0.0,
    decay_hours: float = 720.0,
    date: float = 0.0,
    month: float = 0.0,
    quarter: float = 0.0,
    penalty: float = 0.0,
) -> Column:
    """Score change for a pair of epoch values: smooth proximity plus one calendar bonus."""
    proximity = F.exp(-delta_hours(bundle_ts, product_ts) / F.lit(max(decay_hours, 1e-6)))
    b, p = calendar_keys(bundle_ts), calendar_keys(product_ts)
    bonus = (
        F.when(b["date"] == p["date"], date)
        .when(b["month"] == p["month"], month)
        .when(b["quarter"] == p["quarter"], quarter)
        .otherwise(penalty)
    )
    known = bundle_ts.isNotNull() & product_ts.isNotNull()
    return F.when(known, F.lit(float(weight)) * (F.lit(2.0) * proximity - F.lit(1.0)) + bonus).otherwise(0.0)


def ts_rerank(
    ranked: DataFrame,
    bundle_ts: DataFrame | None = None,
    product_ts: DataFrame | None = None,
    **parameters: float,
) -> DataFrame:
    """add the time adjustment to every score; callers re-sort by cutting with F10.

    ``bundle_ts`` has ``bundle_id, bundle_ts`` and ``product_ts`` has ``product_id, product_ts``;
    without them the two columns are those of ``ranked``.
    """
    if bundle_ts is not None:
        ranked = ranked.join(bundle_ts.select("bundle_id", "bundle_ts"), "bundle_id", "left")
    if product_ts is not None:
        ranked = ranked.join(product_ts.select("product_id", "product_ts"), "product_id", "left")
    change = ts_adjustment(F.col("bundle_ts"), F.col("product_ts"), **parameters)
    return ranked.withColumn("score", stable(F.col("score") + change))


def hubness(ranked: DataFrame, max_ratio: float = 0.015, penalty: float = 0.1) -> DataFrame:
    """lower the score of products present in too large a share of the bundles.

    Counts come from a pre-aggregated group-by. Only hubs are joined back, and there are at most
    (mean length of a list / ``max_ratio``) of them, so they are broadcast and the lists are not shuffled.
    ``ranked`` is read three times; checkpoint one that is costly to compute.
    """
    bundles = ranked.agg(F.count_distinct("bundle_id")).scalar()
    uses = ranked.groupBy("product_id").agg(F.count("*").alias("_uses"))
    hubs = uses.select("product_id", (F.col("_uses") / bundles - F.lit(max_ratio)).alias("_excess")).filter("_excess > 0")
    hubs = F.broadcast(hubs) if max_ratio > 0 else hubs
    return (
        ranked.join(hubs, "product_id", "left")
        .withColumn("score", stable(F.col("score") - F.coalesce(F.lit(penalty) * F.col("_excess"), F.lit(0.0))))
        .drop("_excess")
    )


CROP_BLOCK = 4_096  # crops of one bundle scored in one group
CANDIDATE_BLOCK = 4_096  # candidates of one bundle scored in one group


def late_interaction(ranked: DataFrame, crops2: DataFrame, index2: DataFrame, weight: float = 0.4) -> DataFrame:
    """blend in the best cosine of any crop under a second embedding.

    A bundle with many crops or candidates is cut into blocks of both, each pair of blocks is one bounded
    group, and it returns one maximum per candidate instead of all pairs. Crops and products without a
    vector count as missing. ``ranked`` is read three times.
    """
    crops2, index2 = crops2.filter(F.col("v").isNotNull()), index2.filter(F.col("v").isNotNull())
    pools = ranked.groupBy("bundle_id").agg(F.ceil(F.count("*") / F.lit(CANDIDATE_BLOCK)).cast("int").alias("_pools"))
    blocks = crops2.groupBy("bundle_id").agg(
        F.ceil(F.count("*") / F.lit(CROP_BLOCK)).cast("int").alias("_blocks")
    ).join(pools, "bundle_id")
    left = (
        crops2.select("bundle_id", "crop_id", l2_normalize(F.col("v")).alias("v"))
        .join(blocks, "bundle_id")
        .withColumn("_block", F.pmod(F.xxhash64("crop_id"), F.col("_blocks")).cast("int"))
        .withColumn("_pool", F.explode(F.sequence(F.lit(0), F.col("_pools") - 1)))
        .select("bundle_id", "_block", "_pool", "v")
    )
    right = (
        ranked.select("bundle_id", "product_id")
        .join(index2.select("product_id", l2_normalize(F.col("v")).alias("v")), "product_id")
        .join(blocks, "bundle_id")
        .withColumn("_pool", F.pmod(F.xxhash64("product_id"), F.col("_pools")).cast("int"))
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select("bundle_id", "product_id", "_block", "_pool", "v")
    )

    def best_of_block(crops, candidates):
        import pyarrow as pa

        def matrix(table):
            flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return flat.reshape(table.num_rows, -1)

        if not crops.num_rows or not candidates.num_rows:
            best = pa.array([], pa.float64())
            candidates = candidates.slice(0, 0)
        else:
            best = pa.array((matrix(crops) @ matrix(candidates).T).max(axis=0))
        return pa.table(
            {
                "bundle_id": candidates.column("bundle_id"),
                "product_id": candidates.column("product_id"),
                "heavy": best,
            }
        )

    schema = f"bundle_id {ranked.schema['bundle_id'].dataType.simpleString()}, " + (
        f"product_id {ranked.schema['product_id'].dataType.simpleString()}, heavy double"
    )
    pair = ["bundle_id", "_block", "_pool"]
    heavy = (
        left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInArrow(best_of_block, schema)
        .groupBy("bundle_id", "product_id").agg(F.max("heavy").alias("_heavy"))
    )
    blended = F.lit(1.0 - weight) * F.col("score") + F.lit(weight) * F.col("_heavy")
    return (
        ranked.join(heavy, ["bundle_id", "product_id"], "left")
        .withColumn("score", stable(F.coalesce(blended, F.col("score"))))
        .drop("_heavy")
    )


def zscore(ranked: DataFrame, name: str = "z") -> DataFrame:
    """score standardised within its bundle (population std), 0 when all scores agree."""
    moments = ranked.groupBy("bundle_id").agg(
        F.avg("score").alias("_mean"), F.stddev_pop("score").alias("_std")
    )
    z = F.when(F.col("_std") > 1e-6, (F.col("score") - F.col("_mean")) / F.col("_std")).otherwise(0.0)
    return ranked.join(moments, "bundle_id").withColumn(name, z).drop("_mean", "_std")


def top_n(ranked: DataFrame, n: int = 15) -> DataFrame:
    """the best ``n`` per bundle with a fresh ``rank``."""
    return ranked.withColumn("rank", F.row_number().over(_best("bundle_id"))).filter(F.col("rank") <= n)


def pad(ranked: DataFrame, bundles: DataFrame, fallback: DataFrame, n: int = 15) -> DataFrame:
    """exactly ``n`` products per bundle, filled from ``fallback`` (``product_id, position``).

    At most ``n`` products are present, so the first ``2 n`` fallback ids always suffice; they
    travel as one short array and no bundle is joined with the catalogue.
    """
    spare = fallback.orderBy("position").limit(2 * n)
    spare_ids = F.transform(
        F.array_sort(F.collect_list(F.struct("position", "product_id"))), lambda x: x["product_id"]
    )
    have = ranked.filter(F.col("rank") <= n).groupBy("bundle_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "product_id"))), lambda x: x["product_id"]).alias("_have")
    )
    listed = bundles.select("bundle_id").distinct().join(have, "bundle_id", "left")
    have_ids = F.coalesce("_have", F.array().cast("array<string>"))
    spare_col = spare.agg(spare_ids).scalar()
    full = F.slice(F.concat(have_ids, F.array_except(spare_col, have_ids)), 1, n)
    rows = listed.select("bundle_id", F.size(have_ids).alias("_n"), F.posexplode(full).alias("_pos", "product_id"))
    return rows.select(
        "bundle_id", "product_id", (F.col("_pos") + 1).alias("rank"), (F.col("_pos") >= F.col("_n")).alias("padded")
    )


def rank_by(rows: DataFrame, order: Sequence[str | Column], partition: Sequence[str] = ("bundle_id",)) -> DataFrame:
    """``rank`` from the source order of each list."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def blend(ranked: DataFrame, base: Column, alpha: float = 0.2, n: int | None = None) -> DataFrame:
    """learned score plus ``alpha`` times the raw base score, re-ranked."""
    mixed = ranked.withColumn("score", stable(F.col("score") + F.lit(alpha) * base))
    if n is not None:
        return top_n(mixed, n)
    return mixed.withColumn("rank", F.row_number().over(_best("bundle_id")))
