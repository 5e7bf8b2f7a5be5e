"""Fusion of several ranked lists and repair by article match (H1-H6).

Submissions have ``(submission, bundle_id, product_id, rank)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stitchrank.operators.catalog import with_article
from stitchrank.operators.scale import global_position, stable

RRF_K = 60


def submission_weights(quality: DataFrame) -> DataFrame:
    """H1: ``exp((quality - min) / 2)``, normalised to sum 1."""
    lowest = quality.agg(F.min("quality")).scalar()
    raw = quality.withColumn("_w", F.exp((F.col("quality") - lowest) / 2))
    return raw.withColumn("weight", F.col("_w") / raw.agg(F.sum("_w")).scalar()).drop("_w")


def rrf(subs: DataFrame, k: int = RRF_K, top: int = 15) -> DataFrame:
    """H2: reciprocal rank fusion for the bundles of the first submission.

    Submissions are numbered by their order. A product repeated in a list counts again; equal
    scores keep the order of first sight.
    """
    first = subs.agg(F.min("submission")).scalar()
    fused = (
        subs.groupBy("bundle_id", "product_id")
        .agg(
            stable(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank")))).alias("score"),
            # (submission, rank) as one number, which a hash aggregate can hold in its buffer
            F.min(F.col("submission").cast("bigint") * F.lit(1 << 32) + F.col("rank")).alias("_seen"),
            F.max(F.col("submission") == first).alias("_first"),
        )
    )
    bundle = Window.partitionBy("bundle_id")
    listed = fused.withColumn("_first", F.max("_first").over(bundle)).filter("_first")
    ranked = listed.withColumn("rank", F.row_number().over(bundle.orderBy(F.desc("score"), F.asc("_seen"))))
    return ranked.filter(F.col("rank") <= top).drop("_seen", "_first")


def incomplete_bundles(ranked: DataFrame, k: int = 15) -> DataFrame:
    """H2: bundles that do not hold exactly ``k`` products."""
    return ranked.groupBy("bundle_id").agg(F.count("*").alias("n")).filter(F.col("n") != k)


def weighted_rrf(subs: DataFrame, weights: DataFrame, k: int = RRF_K) -> DataFrame:
    """H3: reciprocal rank scores weighted by submission, unranked."""
    weighted = subs.join(weights.select("submission", "weight"), "submission")
    return weighted.groupBy("bundle_id", "product_id").agg(
        stable(F.sum(F.col("weight") / (F.lit(k) + F.col("rank")))).alias("score")
    )


def weighted_entries(subs: DataFrame, weights: DataFrame, chosen: Column, top: int = 15, k: int = RRF_K) -> DataFrame:
    """H3, H5: every product of a bundle with its weighted score, once for each place among the first ``top`` of the ``chosen`` submission.

    ``rank`` is NULL for a product that has no such place. One aggregate gives both; the places are bits of a number.
    """
    if not 0 < top < 63:
        raise ValueError("top must be from 1 to 62")
    place = (F.col("submission") == chosen) & F.col("rank").between(1, top)
    weighted = subs.join(weights.select("submission", "weight"), "submission")
    fused = weighted.groupBy("bundle_id", "product_id").agg(
        stable(F.sum(F.col("weight") / (F.lit(k) + F.col("rank")))).alias("score"),
        F.bit_or(F.when(place, F.expr("shiftleft(1L, cast(rank as int))")).otherwise(F.lit(0).cast("bigint"))).alias("_places"),
    )
    ranks = F.filter(F.sequence(F.lit(1), F.lit(top)), lambda r: F.col("_places").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), r)) != 0)
    several = F.when(F.col("_places") != 0, ranks)
    return fused.select("bundle_id", "product_id", "score", F.explode_outer(several).alias("rank"))


def _entries(base: DataFrame, scores: DataFrame) -> DataFrame:
    """Products of the lists and of the scores: the rank is NULL without a place in the list, the score without one."""
    return scores.select("bundle_id", "product_id", "score").join(
        base.select("bundle_id", "product_id", "rank"), ["bundle_id", "product_id"], "full"
    )


def _replacements(entries: DataFrame, bundles: DataFrame, products: DataFrame, max_score: float | None) -> DataFrame:
    """Slots of every base list after the sequential article repair.

    The rule walks the bundle's matched products in order and puts each missing one in place
    of the weakest entry. An article can have any number of products, so the pairs are never
    built: a product without a score always lands in the slot the previous one took, hence of
    every run of unscored products only the last matters. What is left per bundle are its
    scored matches, the product just before each of them, and the last of the article.
    """
    coded = with_article(products.select("product_id", "image_url")).filter(F.col("article").isNotNull())
    places = global_position(coded.select("article", "product_id").distinct(), ["article", "product_id"], name="place")
    previous = places.select(
        (F.col("place") + 1).alias("place"), F.col("article").alias("_a"), F.col("product_id").alias("_p")
    )
    # The neighbour before a product belongs to its article or does not count.
    placed = places.join(previous, "place", "left").withColumn("before", F.when(F.col("_a") == F.col("article"), F.col("_p")))
    last = places.groupBy("article").agg(F.max(F.struct("place", "product_id")).alias("_last"))
    wanted = with_article(bundles).select("bundle_id", "article").join(last, "article")

    # Only list entries and scored matches of the bundle's article are gathered: one short array per bundle.
    known = (
        entries.select("bundle_id", "product_id", "score", "rank")
        .join(placed.select("product_id", "place", "article", "before"), "product_id", "left")
        .join(wanted.select("bundle_id", F.col("article").alias("_wanted")), "bundle_id", "left")
        .filter(F.col("rank").isNotNull() | (F.col("article") == F.col("_wanted")))
        .groupBy("bundle_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "rank", "product_id", F.coalesce("score", F.lit(0.0)).alias("score"), "place", "article", "before"
                    )
                )
            ).alias("_known")
        )
        .filter(F.exists("_known", lambda e: e["rank"].isNotNull()))
        .join(wanted.select("bundle_id", F.col("article").alias("_article"), "_last"), "bundle_id", "left")
    )

    def step(place: Column, product: Column, score: Column) -> Column:
        return F.struct(place.alias("place"), product.alias("product_id"), score.alias("score"))

    zero = F.lit(0.0)
    known = known.select(
        "bundle_id",
        "_article",
        "_last",
        F.filter("_known", lambda e: e["rank"].isNotNull()).alias("_slots"),
        F.filter("_known", lambda e: e["article"] == F.col("_article")).alias("_scored"),
    ).withColumn("_taken", F.transform("_scored", lambda e: e["place"]))
    unscored = F.concat(
        F.transform(
            F.filter("_scored", lambda e: e["before"].isNotNull()), lambda e: step(e["place"] - 1, e["before"], zero)
        ),
        F.when(F.col("_last").isNull(), F.array().cast("array<struct<place:bigint,product_id:string,score:double>>"))
        .otherwise(F.array(step(F.col("_last.place"), F.col("_last.product_id"), zero))),
    )
    lists = known.select(
        "bundle_id",
        F.transform(
            "_slots",
            lambda e: F.struct(
                e["product_id"].alias("product_id"),
                e["score"].alias("score"),
                F.coalesce(e["article"] == F.col("_article"), F.lit(False)).alias("is_match"),
            ),
        ).alias("_start"),
        F.array_sort(
            F.array_distinct(
                F.concat(
                    F.transform("_scored", lambda e: step(e["place"], e["product_id"], e["score"])),
                    F.filter(unscored, lambda s: ~F.array_contains("_taken", s["place"])),
                )
            )
        ).alias("_steps"),
    )

    def entry(x: Column, is_match: Column) -> Column:
        return F.struct(
            x["product_id"].alias("product_id"), x["score"].alias("score"), is_match.alias("is_match")
        )

    def place_one(now: Column, step: Column) -> Column:
        present = F.exists(now, lambda e: e["product_id"] == step["product_id"])
        weakest = F.array_min(F.transform(now, lambda e, i: F.struct(e["score"].alias("score"), i.alias("i"))))

        def swapped(w: Column) -> Column:
            new = F.transform(now, lambda e, i: F.when(i == w["i"], entry(step, F.lit(True))).otherwise(e))
            return new if max_score is None else F.when(w["score"] <= max_score, new).otherwise(now)

        # An array of one, so that the weakest entry is looked for once.
        return F.when(present, now).otherwise(F.transform(F.array(weakest), swapped)[0])

    folded = F.aggregate("_steps", F.col("_start"), place_one)
    rows = lists.select("bundle_id", F.posexplode(folded).alias("_pos", "_slot"))
    return rows.select("bundle_id", "_slot.*", (F.col("_pos") + 1).alias("rank"))


def article_repair_votes(
    base: DataFrame, bundles: DataFrame, products: DataFrame, votes: DataFrame, max_votes: int = 4, top: int = 15
) -> DataFrame:
    """H4: put missing article matches in place of the entry with fewest votes, if ``max_votes`` or less."""
    listed = base.filter(F.col("rank") <= top)
    scores = votes.select("bundle_id", "product_id", F.col("votes").cast("double").alias("score"))
    repaired = _replacements(_entries(listed, scores), bundles, products, float(max_votes))
    return repaired.select("bundle_id", "product_id", "rank", F.col("score").cast("bigint").alias("votes"), "is_match")


def article_repair_rrf(
    base: DataFrame, bundles: DataFrame, products: DataFrame, scores: DataFrame, top: int = 15
) -> DataFrame:
    """H5: repair by weighted RRF score without a guard, then article matches first."""
    return _matches_first(_replacements(_entries(base.filter(F.col("rank") <= top), scores), bundles, products, None))


def article_repair_entries(entries: DataFrame, bundles: DataFrame, products: DataFrame) -> DataFrame:
    """H5 over the lists and scores of :func:`weighted_entries`."""
    return _matches_first(_replacements(entries, bundles, products, None))


def _matches_first(repaired: DataFrame) -> DataFrame:
    order = Window.partitionBy("bundle_id").orderBy(
        F.desc("is_match"), F.desc(F.when(~F.col("is_match"), F.col("score"))), F.asc("rank")
    )
    return repaired.withColumn("rank", F.row_number().over(order))


def article_precision(bundles: DataFrame, products: DataFrame, links: DataFrame) -> DataFrame:
    """H6: article matches of the linked bundles that are true links, and those that are not.

    The number of matched pairs comes from counts per article; only true pairs are joined.
    """
    pairs = links.select("bundle_id", "product_id").distinct()
    b = with_article(bundles).filter(F.col("article").isNotNull()).select("bundle_id", "article").distinct()
    b = b.join(pairs.select("bundle_id"), "bundle_id", "left_semi")
    p = with_article(products).filter(F.col("article").isNotNull()).select("product_id", "article").distinct()
    n_pairs = (
        b.groupBy("article").agg(F.count("*").alias("_nb"))
        .join(p.groupBy("article").agg(F.count("*").alias("_np")), "article")
        .agg(F.coalesce(F.sum(F.col("_nb") * F.col("_np")), F.lit(0))).scalar()
    )
    true = (
        pairs.join(b, "bundle_id")
        .join(p.withColumnRenamed("article", "_article"), "product_id")
        .filter(F.col("article") == F.col("_article"))
        .agg(F.count("*").alias("tp"))
    )
    counted = true.withColumn("pairs", n_pairs)
    return counted.select(
        "tp", (F.col("pairs") - F.col("tp")).alias("fp"), F.try_divide("tp", "pairs").alias("precision")
    )
