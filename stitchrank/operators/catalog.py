"""Joins, set operations and counts over the catalogue tables (J*, U*, A1-A4, A7-A18, P14-P22)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stitchrank import fixed_values
from stitchrank.functions.text import (
    category_key,
    clean_labels,
    drop_excluded,
    first_non_empty,
    is_baby,
    parse_id_list,
    stable_seed,
    strip,
)
from stitchrank.functions.urltime import article_code
from stitchrank.operators.scale import global_position

# ----------------------------------------------------------------------------- joins


def links_enriched(links: DataFrame, bundles: DataFrame, products: DataFrame, how: str = "inner") -> DataFrame:
    """J1 (``inner``) and J2 (``left``): links with the attributes of both ends."""
    return links.join(bundles, "bundle_id", how).join(products, "product_id", how)


def _marked(links: DataFrame, bundles: DataFrame, products: DataFrame) -> DataFrame:
    known_bundles = bundles.select("bundle_id").distinct().withColumn("_has_bundle", F.lit(True))
    known_products = products.select("product_id").distinct().withColumn("_has_product", F.lit(True))
    return links.join(known_bundles, "bundle_id", "left").join(known_products, "product_id", "left")


def check_links(
    links: DataFrame, bundles: DataFrame, products: DataFrame, strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Links whose two ends exist, and one row of orphan counters.

    ``strict`` evaluates the counters and raises when an orphan is found.
    """
    marked = _marked(links, bundles, products)
    counts = marked.agg(
        F.count("*").alias("relations_total"),
        F.count_if(F.col("_has_bundle").isNull()).alias("relations_missing_bundle"),
        F.count_if(F.col("_has_product").isNull()).alias("relations_missing_product"),
        F.count_if(F.col("_has_bundle") & F.col("_has_product")).alias("relations_valid"),
    )
    if strict:
        row = counts.first()
        if row["relations_missing_bundle"] or row["relations_missing_product"]:
            raise ValueError(
                f"links with unknown bundles: {row['relations_missing_bundle']}, "
                f"with unknown products: {row['relations_missing_product']}"
            )
    valid = marked.filter(F.col("_has_bundle") & F.col("_has_product")).select(*links.columns)
    return valid, counts


def check_test_ids(test: DataFrame, bundles: DataFrame, strict: bool = False) -> DataFrame:
    """J3 for a test template: rows in total and rows whose bundle is unknown."""
    known = bundles.select("bundle_id").distinct().withColumn("_known", F.lit(True))
    counts = test.join(known, "bundle_id", "left").agg(
        F.count("*").alias("test_rows_total"),
        F.count_if(F.col("_known").isNull()).alias("test_rows_missing_bundle"),
    )
    if strict and (missing := counts.first()["test_rows_missing_bundle"]):
        raise ValueError(f"test rows with unknown bundles: {missing}")
    return counts


def lookup(df: DataFrame, dim: DataFrame, on: str, cols: Sequence[str], defaults: Mapping[str, object]) -> DataFrame:
    """Attributes of ``dim`` by key, a default where the key or the value is missing.

    ``dim`` has one row per key. Whether it is broadcast is left to the size statistics.
    """
    joined = df.join(dim.select(on, *cols), on, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(defaults[c])) for c in cols if c in defaults})


def with_article(df: DataFrame, url: str = "image_url") -> DataFrame:
    """Add the article code of a URL; NULL for none or an empty one."""
    code = article_code(F.col(url))
    return df.withColumn("article", F.when(code != "", code))


ARTICLE_BLOCK = 10_000  # bundles of one article joined in one part


def article_matches(bundles: DataFrame, products: DataFrame) -> DataFrame:
    """Bundles and products showing the same article.

    An article with more than ``ARTICLE_BLOCK`` bundles is joined in as many salted parts, its products
    going to each. ``bundles`` is read twice.
    """
    left = with_article(bundles).select("bundle_id", "article").filter(F.col("article").isNotNull())
    right = with_article(products).select("product_id", "article").filter(F.col("article").isNotNull())
    parts = left.groupBy("article").agg(F.ceil(F.count("*") / F.lit(ARTICLE_BLOCK)).cast("int").alias("_parts"))
    left = left.join(parts, "article").withColumn("_part", F.pmod(F.xxhash64("bundle_id"), F.col("_parts")).cast("int"))
    right = right.join(parts, "article").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return left.join(right, ["article", "_part"]).select("bundle_id", "product_id", "article")


def manifest_links(manifest: DataFrame) -> DataFrame:
    """Distinct (bundle, product) pairs of direct id columns and list columns."""
    bundle = first_non_empty(manifest, fixed_values.BUNDLE_ID_KEYS)
    direct = first_non_empty(manifest, fixed_values.LINK_PRODUCT_KEYS)
    lists = [
        parse_id_list(F.col(key), is_array=manifest.schema[key].dataType.typeName() == "array")
        for key in fixed_values.LINK_LIST_KEYS
        if key in manifest.columns
    ]
    ids = F.concat(F.when(direct.isNotNull(), F.array(direct)).otherwise(F.array().cast("array<string>")), *lists)
    pairs = manifest.select(bundle.alias("bundle_id"), F.explode(F.array_distinct(ids)).alias("product_id"))
    return pairs.filter(F.col("bundle_id").isNotNull()).distinct()


def restrict_links(manifest: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifest links to catalogue products, and the number of links dropped."""
    pairs = manifest_links(manifest)
    known = products.select("product_id").distinct().withColumn("_known", F.lit(True))
    marked = pairs.join(known, "product_id", "left")
    counts = marked.agg(
        F.count("*").alias("links_total"), F.count_if(F.col("_known").isNull()).alias("links_dropped")
    )
    return marked.filter("_known").select("bundle_id", "product_id"), counts


def eligible_queries(queries: DataFrame, links: DataFrame, index: DataFrame) -> DataFrame:
    """Queries with at least one positive inside the index."""
    positives = links.join(index.select("product_id"), "product_id", "left_semi")
    return queries.join(positives.select("bundle_id"), "bundle_id", "left_semi")


def mark_hits(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """``hit`` says whether a candidate is a true product of its bundle."""
    pairs = truth.select("bundle_id", "product_id").distinct().withColumn("_hit", F.lit(True))
    marked = ranked.join(pairs, ["bundle_id", "product_id"], "left")
    return marked.withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def training_pairs(boxes: DataFrame, links: DataFrame, max_positives: int = 8) -> DataFrame:
    """Every box of a bundle (or one NULL box for the full image) with its first positives.

    ``max_positives`` bounds the fan-out per box; 0 takes all positives of a bundle.
    """
    positives = links.select("bundle_id", "product_id").distinct()
    if max_positives > 0:
        place = F.row_number().over(Window.partitionBy("bundle_id").orderBy("product_id"))
        positives = positives.withColumn("_place", place).filter(F.col("_place") <= max_positives).drop("_place")
    return positives.join(boxes.select("bundle_id", "box_id"), "bundle_id", "left")


def override_description(products: DataFrame, enriched: DataFrame) -> DataFrame:
    """Category key of the enriched catalogue where it has one, else the product's own."""
    better = enriched.select("product_id", category_key(F.col("description")).alias("_better"))
    own = category_key(F.col("description"))
    return products.join(better, "product_id", "left").withColumn(
        "category", F.coalesce(F.nullif(F.col("_better"), F.lit("")), own)
    ).drop("_better")


# ------------------------------------------------------------------------ set operations


def union_ids(*frames: DataFrame) -> DataFrame:
    """Distinct ids of the first columns of all frames."""
    parts = [f.select(F.col(f.columns[0]).alias("id")) for f in frames]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def distinct_first(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Distinct ids with the position of their first appearance."""
    return df.groupBy(key).agg(F.min(pos).alias("first_pos"))


def unknown_ids(df: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct ids of the first column of ``df`` that ``known`` lacks."""
    key = df.columns[0]
    return df.select(key).distinct().join(known.select(F.col(known.columns[0]).alias(key)), key, "left_anti")


def union_links(*frames: DataFrame) -> DataFrame:
    """U4: distinct links of several sources."""
    out = frames[0].select("bundle_id", "product_id")
    for frame in frames[1:]:
        out = out.unionByName(frame.select("bundle_id", "product_id"))
    return out.distinct()


# ---------------------------------------------------------------- cleaning and label sets


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> tuple[DataFrame, DataFrame]:
    """A1: first row per key in ``order``, and the number of duplicates dropped.

    The rank-one filter is applied before the shuffle as well, so a hot key is thinned early.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    kept = df.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_total"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"),
    )
    return kept, counts


def link_labels(
    links: DataFrame, bundles: DataFrame, products: DataFrame, excluded: Iterable[str] = fixed_values.EXCLUDED_LABELS
) -> DataFrame:
    """Links with the cleaned labels of their product: ``labels.kept`` and ``labels.removed``."""
    labelled = products.select(
        "product_id",
        F.lit(True).alias("_has_product"),
        F.col("description").isNull().alias("no_description"),
        drop_excluded(clean_labels(F.col("description")), excluded).alias("labels"),
    )
    known = bundles.select("bundle_id").distinct().withColumn("_has_bundle", F.lit(True))
    return links.join(known, "bundle_id", "left").join(labelled, "product_id", "left")


def bundle_labels(
    links: DataFrame,
    bundles: DataFrame,
    products: DataFrame,
    excluded: Iterable[str] = fixed_values.EXCLUDED_LABELS,
    limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """A2: label set of every bundle with its section and URL, and the integrity counters.

    Labels are collected as sets, before the shuffle too, so an array never exceeds the label
    vocabulary. ``bundles`` and ``products`` have unique ids (A1).
    """
    if limit is not None and limit <= 0:
        raise ValueError("limit must be > 0")
    rows = link_labels(links, bundles, products, excluded)
    valid = F.coalesce(F.col("_has_bundle") & F.col("_has_product"), F.lit(False))
    used = valid & ~F.col("no_description")
    labels = rows.filter(used).select("bundle_id", F.explode("labels.kept").alias("label"))
    sets = labels.groupBy("bundle_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    records = sets.join(
        bundles.select("bundle_id", "section", strip(F.coalesce("image_url", F.lit(""))).alias("image_url")), "bundle_id"
    )
    if limit is not None:
        records = first_n(records, "bundle_id", limit)
    with_labels = labels.agg(F.count_distinct("bundle_id")).scalar()
    counts = rows.agg(
        F.count("*").alias("relations_total"),
        F.count_if(F.col("_has_bundle").isNull()).alias("relations_missing_bundle"),
        F.count_if(F.col("_has_product").isNull()).alias("relations_missing_product"),
        F.count_if(valid).alias("relations_valid"),
        F.count_if(valid & F.col("no_description")).alias("products_missing_description"),
        F.count_if(used & (F.size("labels.kept") == 0)).alias("products_empty_labels_after_clean"),
        F.coalesce(F.sum(F.when(used, F.col("labels.removed"))), F.lit(0)).alias("labels_removed_excluded_categories"),
    )
    # A bundle whose labels are all excluded never enters the label map, so this stays 0.
    counts = counts.withColumn("bundles_without_labels", F.lit(0).cast("bigint"))
    counts = counts.withColumn("bundles_with_labels", with_labels)
    if limit is not None:
        counts = counts.withColumn("bundles_after_limit", F.least(F.col("bundles_with_labels"), F.lit(limit)))
    return records, counts


def label_vocab(records: DataFrame) -> DataFrame:
    """A3: sorted distinct labels with a 0-based index."""
    labels = records.select(F.explode("labels").alias("label")).distinct()
    return global_position(labels, ["label"], name="label_index")


def index_labels(records: DataFrame, vocab: DataFrame) -> DataFrame:
    """A3: ``label_indices`` in the order of the sorted labels."""
    rows = records.select("bundle_id", F.explode("labels").alias("label")).join(vocab, "label")
    indexed = rows.groupBy("bundle_id").agg(F.array_sort(F.collect_list("label_index")).alias("label_indices"))
    return records.join(indexed, "bundle_id", "left")


def corpus_stats(records: DataFrame, train: DataFrame, val: DataFrame, available: DataFrame) -> DataFrame:
    """A4: totals, label frequency, labels-per-bundle histogram, percent of images present.

    Long form ``(metric, key, value)``; ``available`` lists the ids whose image exists.
    """
    have = available.select("bundle_id").distinct().withColumn("_ok", F.lit(1.0))
    flagged = records.select("bundle_id").join(have, "bundle_id", "left")
    rate = F.coalesce(F.round(F.lit(100.0) * F.avg(F.coalesce("_ok", F.lit(0.0))), 4), F.lit(0.0))
    labels = records.select(F.explode("labels").alias("label"))

    def row(df: DataFrame, metric: str, key: Column, value: Column) -> DataFrame:
        return df.select(F.lit(metric).alias("metric"), key.cast("string").alias("key"), value.cast("double").alias("value"))

    none = F.lit("")
    parts = [
        row(flagged.agg(F.count("*").alias("n"), rate.alias("r")), "num_bundles_total", none, F.col("n")),
        row(flagged.agg(rate.alias("r")), "pct_bundles_image_available", none, F.col("r")),
        row(train.agg(F.count("*").alias("n")), "num_bundles_train", none, F.col("n")),
        row(val.agg(F.count("*").alias("n")), "num_bundles_val", none, F.col("n")),
        row(labels.agg(F.count_distinct("label").alias("n")), "num_labels", none, F.col("n")),
        row(labels.groupBy("label").count(), "label_frequency", F.col("label"), F.col("count")),
        row(
            records.groupBy(F.size("labels").alias("n")).count(),
            "labels_per_bundle", F.col("n"), F.col("count"),
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ------------------------------------------------------------------------------ sections


def _section_counts(links: DataFrame, bundles: DataFrame) -> DataFrame:
    known = bundles.filter(F.col("section").isNotNull()).select("bundle_id", "section")
    return links.join(known, "bundle_id").groupBy("product_id", "section").agg(F.count("*").alias("n"))


def direct_sections(links: DataFrame, bundles: DataFrame) -> DataFrame:
    """Section of every linked product by majority of links; a tie goes to the lower one.

    ``n_sections > 1`` marks a conflict.
    """
    best = F.max(F.struct(F.col("n"), (-F.col("section")).alias("neg")))
    return (
        _section_counts(links, bundles)
        .groupBy("product_id")
        .agg((-best["neg"]).alias("section"), F.count("*").alias("n_sections"), F.sum("n").alias("n_links"))
    )


def exclusive_sections(links: DataFrame, bundles: DataFrame, products: DataFrame, min_share: float = 0.9) -> DataFrame:
    """Descriptions of which at least ``min_share`` of the links fall in one section."""
    keyed = products.select("product_id", category_key(F.col("description")).alias("category"))
    counts = (
        _section_counts(links, bundles)
        .join(keyed.filter(F.col("category") != ""), "product_id")
        .groupBy("category", "section")
        .agg(F.sum("n").alias("n"))
    )
    best = F.max(F.struct(F.col("n"), (-F.col("section")).alias("neg")))
    shares = counts.groupBy("category").agg(
        (-best["neg"]).alias("section"), (best["n"] / F.sum("n")).alias("share"), F.sum("n").alias("n_links")
    )
    return shares.filter(F.col("share") >= min_share)


def assign_sections(products: DataFrame, direct: DataFrame, exclusive: DataFrame) -> DataFrame:
    """``gender`` by direct link, then BABY prefix, then description, then 0; with ``method``."""
    rows = (
        products.withColumn("category", category_key(F.col("description")))
        .join(direct.select("product_id", F.col("section").alias("_direct")), "product_id", "left")
        .join(exclusive.select("category", F.col("section").alias("_typical")), "category", "left")
    )
    baby = is_baby(F.col("description"))
    gender = F.when(F.col("_direct").isNotNull(), F.col("_direct")).when(baby, 3)
    method = F.when(F.col("_direct").isNotNull(), "direct_link").when(baby, "baby_prefix")
    return rows.select(
        *products.columns,
        gender.when(F.col("_typical").isNotNull(), F.col("_typical")).otherwise(0).cast("int").alias("gender"),
        method.when(F.col("_typical").isNotNull(), "desc_heuristic").otherwise("fallback_unknown").alias("method"),
    )


def section_distribution(assigned: DataFrame) -> DataFrame:
    """Counts and percent by method and by section."""
    total = assigned.agg(F.count("*")).scalar()

    def part(kind: str, key: str) -> DataFrame:
        return assigned.groupBy(F.col(key).cast("string").alias("value")).agg(F.count("*").alias("n")).select(
            F.lit(kind).alias("kind"), "value", "n"
        )

    both = part("method", "method").unionByName(part("gender", "gender"))
    return both.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / total, 1))


def product_sections(
    links: DataFrame, bundles: DataFrame, products: DataFrame, all_sections: Sequence[int] = (1, 2, 3)
) -> DataFrame:
    """(product, section) rows: sections seen with its description, else all of them."""
    keyed = products.select("product_id", category_key(F.col("description")).alias("category"))
    seen = (
        _section_counts(links, bundles)
        .join(keyed.filter(F.col("category") != ""), "product_id")
        .groupBy("category")
        .agg(F.array_sort(F.collect_set(F.col("section").cast("int"))).alias("_sections"))
    )
    every = F.array(*[F.lit(s) for s in all_sections])
    return keyed.join(seen, "category", "left").select(
        "product_id", F.explode(F.coalesce("_sections", every)).alias("section")
    )


# -------------------------------------------------------------------- counts and reports


def popularity(links: DataFrame, products: DataFrame) -> DataFrame:
    """A10: the catalogue by number of links, unlinked products last; ``position`` from 0."""
    uses = links.groupBy("product_id").agg(F.count("*").alias("n_links"))
    rows = products.select("product_id").distinct().join(uses, "product_id", "full").select(
        "product_id", F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    return global_position(rows, [F.desc("n_links"), F.asc("product_id")])


def most_popular(links: DataFrame, n: int) -> DataFrame:
    """A10: only the first ``n``, by a distributed top-n instead of a full order."""
    uses = links.groupBy("product_id").agg(F.count("*").alias("n_links"))
    first = uses.orderBy(F.desc("n_links"), F.asc("product_id")).limit(n)
    order = Window.orderBy(F.desc("n_links"), F.asc("product_id"))  # n rows are left here
    return first.withColumn("position", F.row_number().over(order) - 1)


def truth(links: DataFrame) -> DataFrame:
    """Distinct true pairs."""
    return links.select("bundle_id", "product_id").distinct()


def votes(submissions: DataFrame) -> DataFrame:
    """How often the submissions hold a (bundle, product); a repeat in a list counts again."""
    return submissions.groupBy("bundle_id", "product_id").agg(F.count("*").alias("votes"))


def detection_stats(bundles: DataFrame, boxes: DataFrame) -> DataFrame:
    """Bundles in total, with boxes, and mean boxes per bundle."""
    per_image = boxes.groupBy("bundle_id").agg(F.count("*").alias("_n"))
    return bundles.select("bundle_id").distinct().join(per_image, "bundle_id", "left").agg(
        F.count("*").alias("total"),
        F.count("_n").alias("with_detections"),
        F.avg(F.coalesce("_n", F.lit(0))).alias("avg_boxes"),
    )


def size_stats(ranked: DataFrame, bundles: DataFrame | None = None) -> DataFrame:
    """Mean, min, max and median list length; ``bundles`` adds those with none."""
    sizes = ranked.groupBy("bundle_id").agg(F.count("*").alias("_n"))
    if bundles is not None:
        sizes = bundles.select("bundle_id").distinct().join(sizes, "bundle_id", "left")
    # Histogram first: the exact median then sees distinct lengths, not bundles.
    lengths = sizes.groupBy(F.coalesce("_n", F.lit(0)).alias("_n")).agg(F.count("*").alias("_w"))
    return lengths.agg(
        F.sum("_w").alias("bundles"),
        (F.sum(F.col("_n") * F.col("_w")) / F.sum("_w")).alias("mean_size"),
        F.min("_n").alias("min_size"),
        F.max("_n").alias("max_size"),
        F.percentile("_n", F.lit(0.5), F.col("_w")).alias("median_size"),
    )


def positives_histogram(pairs: DataFrame) -> DataFrame:
    """How many bundles have n positives."""
    return (
        pairs.groupBy("bundle_id").agg(F.count_distinct("product_id").alias("n_positives"))
        .groupBy("n_positives").agg(F.count("*").alias("n_bundles"))
    )


def submission_view(submission: DataFrame, products: DataFrame) -> DataFrame:
    """Distinct products of each bundle with description and the bundle's total.

    One row per product; a bundle's rows are never gathered in one array.
    """
    pairs = submission.select("bundle_id", "product_id").distinct()
    totals = pairs.groupBy("bundle_id").agg(F.count("*").alias("n_products"))
    described = pairs.join(first_description(products), "product_id", "left")
    return described.join(totals, "bundle_id").select(
        "bundle_id", "product_id", F.coalesce("description", F.lit("")).alias("description"), "n_products"
    )


def first_description(products: DataFrame, order: str | None = None) -> DataFrame:
    """First non-empty trimmed description per product, in ``order`` where given."""
    named = products.withColumn("description", strip(F.col("description"))).filter(F.col("description") != "")
    first = F.min_by("description", order) if order else F.min("description")
    return named.groupBy("product_id").agg(first.alias("description"))


# ----------------------------------------------------- dimension, prompts, plans, limits


def taxonomy(spark: SparkSession, table: Mapping[str, Sequence[str]], name: str = "cls") -> DataFrame:
    """A fixed lookup table as ``(category, <name>)`` rows."""
    rows = [(word, group) for group, words in table.items() for word in words]
    return spark.createDataFrame(rows, f"category string, {name} string")


def with_taxonomy(df: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Class or group of a description; NULL when the table lacks it."""
    return df.withColumn("category", category_key(F.col(on))).join(table, "category", "left")


def augment_plan(assets: DataFrame, split: str, n: int, seed: int = 42, out_dir: str = "") -> DataFrame:
    """``n`` planned variants per asset with their seed and output path."""
    planned = assets.withColumn("aug_index", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    name = F.concat_ws("", F.col("asset_id"), F.lit("_aug"), F.col("aug_index"), F.lit(".jpg"))
    return planned.select(
        "asset_id",
        F.col("path").alias("original_path"),
        F.concat_ws("/", F.lit(out_dir or f"{split}s_aug"), name).alias("aug_path"),
        "aug_index",
        stable_seed(F.lit(seed), F.lit(split), F.col("asset_id"), F.col("aug_index")).alias("seed"),
    )


def category_prompts(products: DataFrame) -> DataFrame:
    """Distinct descriptions with the text prompt that names them."""
    category = category_key(F.col("description"))
    return (
        products.select(category.alias("category")).filter(F.col("category") != "").distinct()
        .withColumn("prompt", F.concat(F.lit("a photo of "), F.lower("category")))
    )


def select_assets(
    manifest: DataFrame,
    id_keys: Sequence[str],
    path_keys: Sequence[str],
    listing: DataFrame | None = None,
    order: Sequence[str] = ("asset_id",),
) -> tuple[DataFrame, DataFrame]:
    """P20: one usable local path per asset id, and the number of rows skipped.

    URL paths do not count; ``listing`` (``asset_id, path``, from S3) then supplies the file,
    jpg before jpeg before png before webp. The first row of an id in ``order`` wins.
    """
    path = first_non_empty(manifest, path_keys)
    path = F.when(~F.lower(path).rlike("^https?://"), path)
    rows = manifest.withColumns({"asset_id": first_non_empty(manifest, id_keys), "path": path})
    if listing is not None:
        extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
        preference = F.array_position(F.array(*[F.lit(e) for e in ("jpg", "jpeg", "png", "webp")]), extension)
        files = listing.withColumn("_order", preference).filter(F.col("_order") > 0).groupBy("asset_id").agg(
            F.min_by("path", F.struct("_order", "path")).alias("_file")
        )
        rows = rows.join(files, "asset_id", "left").withColumn("path", F.coalesce("path", "_file"))
    usable = F.col("asset_id").isNotNull() & F.col("path").isNotNull()
    kept, _ = keep_first(rows.filter(usable), ["asset_id"], [*order, "path"])
    counts = rows.agg(F.count("*").alias("rows_total"), F.count_if(~usable).alias("rows_skipped"))
    return kept.select("asset_id", "path"), counts


def with_images(df: DataFrame, listing: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows for which an image file exists under every id column in ``on``."""
    for column in [on] if isinstance(on, str) else on:
        df = df.join(listing.select(F.col("asset_id").alias(column)), column, "left_semi")
    return df


def first_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows by id."""
    if n <= 0:
        raise ValueError("n must be > 0")
    return df.orderBy(key).limit(n)
