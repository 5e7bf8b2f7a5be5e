"""From raw tables to training data: manifests, section inference, reranker training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stitchrank.operators import catalog, evaluate, listwise, mlp, retrieve, splits
from stitchrank.operators.embeddings import standardize
from stitchrank.operators.scale import checkpointed
from stitchrank.sources.sinks import manifest_rows, write_manifest, write_metrics


def corpus(
    links: DataFrame, bundles: DataFrame, products: DataFrame, images: DataFrame, out: str,
    ratio: float = 0.1, seed: int = 42, strict: bool = False, limit: int | None = None,
) -> dict[str, DataFrame]:
    """Clean, label, split and write the training manifests, the vocabulary and the statistics.

    ``images`` (S3) stands in for downloads: it says which bundle images exist.
    """
    bundles, _ = catalog.keep_first(bundles, ["bundle_id"], ["image_url"])
    products, _ = catalog.keep_first(products, ["product_id"], ["image_url", "description"])
    catalog.check_links(links, bundles, products, strict=strict)
    records, counts = catalog.bundle_labels(links, bundles, products, limit=limit)
    records = checkpointed(records)
    vocab = catalog.label_vocab(records)
    indexed = catalog.index_labels(records, vocab)
    split = checkpointed(splits.stratified_split(records, ratio, seed))
    marked = indexed.join(split.select("bundle_id", "split"), "bundle_id")
    train, val = (marked.filter(F.col("split") == s) for s in ("train", "val"))
    available = images.select(F.col("asset_id").alias("bundle_id"))
    stats = catalog.corpus_stats(records, train, val, available)
    write_manifest(manifest_rows(train, f"{out}/bundle_images"), f"{out}/train_manifest")
    write_manifest(manifest_rows(val, f"{out}/bundle_images"), f"{out}/val_manifest")
    write_metrics(vocab, f"{out}/labels", mode="overwrite")
    write_metrics(stats, f"{out}/stats", mode="overwrite")
    write_metrics(counts, f"{out}/integrity", mode="overwrite")
    return {"records": indexed, "vocab": vocab, "split": split, "stats": stats, "counts": counts}


def sections(links: DataFrame, bundles: DataFrame, products: DataFrame, min_share: float = 0.9) -> DataFrame:
    """Products with their inferred section."""
    direct = catalog.direct_sections(links, bundles)
    exclusive = catalog.exclusive_sections(links, bundles, products, min_share)
    return catalog.assign_sections(products, direct, exclusive)


def candidates(
    queries: DataFrame, index: DataFrame, links: DataFrame, pool: int, ratio: float = 0.1, seed: int = 42
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training and validation rows with ``positive`` and ``split``, the truth inside the index,
    and all candidates found. The candidates are checkpointed: the search runs once."""
    truth = catalog.truth(links).join(index.select("product_id"), "product_id", "left_semi")
    eligible = catalog.eligible_queries(queries, links, index)
    split = splits.split_ids(eligible.select("bundle_id"), ratio, seed)
    found = retrieve.topk(eligible.select("bundle_id", "v"), index.select("product_id", "v"), pool)
    found = checkpointed(found.join(split, "bundle_id"))
    usable, _ = splits.listwise_records(found.filter(F.col("split") == "train"), truth)
    val = catalog.mark_hits(found.filter(F.col("split") == "val"), truth).withColumnRenamed("hit", "positive")
    return usable.unionByName(val), truth, found


def train_reranker(
    queries: DataFrame, index: DataFrame, links: DataFrame, dim: int, pool: int = 500, ratio: float = 0.1,
    seed: int = 42, **fit: object,
) -> tuple[dict, list[dict], DataFrame]:
    """Candidates, split, coverage and the fitted scorer; no query is on both sides.

    The scorer is linear, or has the layers that ``hidden`` names.
    """
    rows, truth, found = candidates(queries, index, links, pool, ratio, seed)
    ceiling = evaluate.coverage(found, truth, [pool], pool, bundles=found)
    fitted = mlp.fit_mlp if fit.get("hidden") else listwise.fit_linear
    model, history = fitted(rows, queries, index, truth, dim, **fit)
    return model, history, ceiling


def standardized_features(features: DataFrame, columns: list[str], train_ids: DataFrame) -> DataFrame:
    """Query features standardised by the training queries only."""
    train = features.join(train_ids.select("bundle_id"), "bundle_id", "left_semi")
    return standardize(features, columns, train)
