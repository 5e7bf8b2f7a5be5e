"""From crop vectors to ranked lists: the four retrieval entry points and the ensembles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stitchrank.operators.catalog import most_popular, votes
from stitchrank.operators.ensemble import article_repair_entries, article_repair_rrf, article_repair_votes, submission_weights, weighted_entries, weighted_rrf
from stitchrank.operators.listwise import learned_rerank
from stitchrank.operators.rank import hubness, late_interaction, pad, top_n
from stitchrank.operators.retrieve import retrieve_boosted, retrieve_max, retrieve_sum, retrieve_top1
from stitchrank.operators.scale import checkpointed


def sectioned(
    crops: DataFrame,
    index: DataFrame,
    sections: DataFrame,
    categories: DataFrame,
    taxonomy: DataFrame | None = None,
    bundles: DataFrame | None = None,
    fallback: DataFrame | None = None,
    model: dict | None = None,
    model_pool: int = 200,
    features: DataFrame | None = None,
    hub: dict | None = None,
    second: tuple[DataFrame, DataFrame] | None = None,
    n: int = 15,
    **retrieval: object,
) -> DataFrame:
    """Section-wise retrieval, optional learned, hubness and late-interaction reranks, cut, padding.

    ``features`` are the raw query features of a model that has some. ``second`` is a pair of crop and index vectors under another encoder. The reranks read their
    list more than once, with different columns, so the pooled list is checkpointed before them:
    it is short, and the search behind it must not run again.
    """
    pool = max(4 * n, model_pool if model is not None else 0)
    ranked = retrieve_boosted(crops, index, sections, categories, taxonomy, pool=pool, **retrieval)
    if model is not None or hub is not None or second is not None:
        ranked = checkpointed(ranked)
    if model is not None:
        ranked = checkpointed(learned_rerank(ranked, crops, index, model, features=features))
    if hub is not None:
        ranked = hubness(ranked, **hub)
    if second is not None:
        ranked = late_interaction(ranked, *second)
    ranked = top_n(ranked, n)
    if bundles is None or fallback is None:
        return ranked
    return pad(ranked, bundles, fallback, n)


def per_crop(crops: DataFrame, index: DataFrame, **options: object) -> DataFrame:
    """Per-crop retrieval with summed scores."""
    return retrieve_sum(crops, index, **options)


def top1(crops: DataFrame, index: DataFrame, **options: object) -> DataFrame:
    """One product per crop."""
    return retrieve_top1(crops, index, **options)


def boxed(crops: DataFrame, index: DataFrame, bundles: DataFrame, links: DataFrame, n: int = 15, **options: object) -> DataFrame:
    """Per-box retrieval by maximum, popular products for bundles without an image."""
    return retrieve_max(crops, index, final_k=n, bundles=bundles, fallback=most_popular(links, n), **options)


def padded(ranked: DataFrame, bundles: DataFrame, links: DataFrame, n: int = 15) -> DataFrame:
    """Lists of exactly ``n``, filled with popular products."""
    return pad(ranked, bundles, most_popular(links, 2 * n), n)


def ensemble_votes(subs: DataFrame, bundles: DataFrame, products: DataFrame, top: int = 15) -> DataFrame:
    """Best submission repaired by article match where the replaced entry has few votes.

    ``subs`` has ``submission, quality, bundle_id, product_id, rank``.
    """
    return article_repair_votes(best_submission(subs), bundles, products, votes(subs), top=top)


def ensemble_rrf(subs: DataFrame, bundles: DataFrame, products: DataFrame, top: int = 15) -> DataFrame:
    """Best submission repaired by article match and reordered by weighted reciprocal rank."""
    weights = submission_weights(subs.select("submission", "quality").distinct())
    if top > 62:  # more places than a number has bits
        return article_repair_rrf(best_submission(subs), bundles, products, weighted_rrf(subs, weights), top=top)
    best = subs.agg(F.max_by("submission", "quality")).scalar()
    # Lists and scores come from one reading of the submissions.
    return article_repair_entries(weighted_entries(subs, weights, best, top), bundles, products)


def best_submission(subs: DataFrame) -> DataFrame:
    """Rows of the submission with the highest quality."""
    best = subs.agg(F.max_by("submission", "quality")).scalar()
    return subs.filter(F.col("submission") == best).select("bundle_id", "product_id", "rank")
