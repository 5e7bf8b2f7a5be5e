"""Do linked bundle and product images come from the same time?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stitchrank.functions.urltime import calendar_keys, delta_hours, url_ts

PERIODS = ("date", "month", "quarter")


def link_times(links: DataFrame, bundles: DataFrame, products: DataFrame, tz: str = "UTC") -> DataFrame:
    """Distinct links with both timestamps, three independent ``same_*`` flags and the delta."""
    left = bundles.select("bundle_id", url_ts(F.col("image_url")).alias("bundle_ts"))
    left = left.withColumn("_b", calendar_keys(F.col("bundle_ts"), tz))
    right = products.select("product_id", url_ts(F.col("image_url")).alias("product_ts"))
    right = right.withColumn("_p", calendar_keys(F.col("product_ts"), tz))
    pairs = links.select("bundle_id", "product_id").distinct()
    merged = pairs.join(left, "bundle_id", "left").join(right, "product_id", "left")
    same = {
        f"same_{p}": F.coalesce(F.col("_b")[p] == F.col("_p")[p], F.lit(False)) for p in PERIODS
    }
    both = F.col("bundle_ts").isNotNull() & F.col("product_ts").isNotNull()
    return merged.withColumns(
        {**same, "both_ts": both, "delta_hours": delta_hours(F.col("bundle_ts"), F.col("product_ts"))}
    ).drop("_b", "_p")


def ts_alignment(links: DataFrame, bundles: DataFrame, products: DataFrame, tz: str = "UTC") -> DataFrame:
    """A5: one row per bundle with counts, shares, flags and deltas.

    All aggregates are partial, so a bundle with very many links costs no more than others.
    The id lists of the report come from :func:`ts_alignment_ids`.
    """
    rows = link_times(links, bundles, products, tz)
    with_ts = F.count_if("both_ts")
    aggregates: list[Column] = [
        F.any_value("bundle_ts").alias("bundle_ts"),
        F.count("*").alias("n_products"),
        with_ts.alias("n_products_with_ts"),
        *[F.count_if(F.col("both_ts") & F.col(f"same_{p}")).alias(f"n_products_same_{p}") for p in PERIODS],
        F.avg(F.when(F.col("both_ts"), F.col("delta_hours"))).alias("avg_delta_hours_abs"),
        F.max(F.when(F.col("both_ts"), F.col("delta_hours"))).alias("max_delta_hours_abs"),
    ]
    # The calendar fields are derived again from the timestamp: text in an aggregate buffer would
    # turn the hash aggregate into a sort.
    report = rows.groupBy("bundle_id").agg(*aggregates).withColumn("_keys", calendar_keys(F.col("bundle_ts"), tz))
    n = F.col("n_products_with_ts")
    out = [
        F.col("bundle_id"), F.col("bundle_ts"),
        *[F.col(f"_keys.{k}").alias(f"bundle_{k}") for k in ("datetime", *PERIODS)],
        F.col("n_products"), n, (F.col("n_products") - n).alias("n_products_missing_ts"),
    ]
    for p in PERIODS:
        hits = F.col(f"n_products_same_{p}")
        noun = f"products_same_{p}"
        out += [
            hits, (n - hits).alias(f"n_products_diff_{p}"),
            F.when(n > 0, hits / n).alias(f"pct_{noun}"),
            ((n > 0) & (hits == n)).alias(f"all_{noun}"),
            (hits > 0).alias(f"any_product_same_{p}"),
        ]
    return report.select(*out, "avg_delta_hours_abs", "max_delta_hours_abs")


def ts_alignment_ids(links: DataFrame, bundles: DataFrame, products: DataFrame, tz: str = "UTC") -> DataFrame:
    """A5: the members of the seven id lists of a bundle, one row ``(bundle_id, list_name, product_id)`` each.

    A bundle with any number of products has the same shape. Lists are ordered by ``product_id`` where they are
    written; :func:`joined_ids` makes texts of lists that are known to be short.
    """
    lists = F.when(~F.col("both_ts"), F.array(F.lit("missing_ts"))).otherwise(
        F.array(*[F.when(F.col(f"same_{p}"), f"same_{p}").otherwise(f"diff_{p}") for p in PERIODS])
    )
    rows = link_times(links, bundles, products, tz)
    return rows.select("bundle_id", F.explode(lists).alias("list_name"), "product_id")


def joined_ids(members: DataFrame) -> DataFrame:
    """A5: a list of :func:`ts_alignment_ids` as one pipe-joined, sorted text; for lists of bounded length."""
    ids = F.array_join(F.array_sort(F.collect_list("product_id")), "|").alias("product_ids")
    return members.groupBy("bundle_id", "list_name").agg(ids)


def ts_alignment_totals(report: DataFrame) -> DataFrame:
    """The report summed over all bundles."""
    sums = [
        F.count("*").alias("bundles"),
        F.sum("n_products").alias("products"),
        F.sum("n_products_with_ts").alias("products_with_ts"),
    ]
    for p in PERIODS:
        sums += [
            F.sum(f"n_products_same_{p}").alias(f"products_same_{p}"),
            F.count_if(f"all_products_same_{p}").alias(f"bundles_all_same_{p}"),
            F.count_if(f"any_product_same_{p}").alias(f"bundles_any_same_{p}"),
            F.count_if(~F.col(f"any_product_same_{p}")).alias(f"bundles_none_same_{p}"),
        ]
    return report.agg(*sums)
