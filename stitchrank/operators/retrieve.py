"""Exact nearest products and the fusions of per-crop hits.

Query frames carry ``(bundle_id, crop_id, v, conf, ...)``; index frames carry
``(product_id, v, ...)``. Every other column of either side travels with the hit, so the
fusions need no join back to a catalogue.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stitchrank.functions.text import score_text
from stitchrank.operators.cells import CellIndex, pruned_topk
from stitchrank.operators.nearest import BLOCK_BYTES, blocks, lists_of, paired
from stitchrank.operators.rank import (
    category_cap,
    category_cap_backfill,
    score_threshold,
    section_filter,
    top_n,
    ts_rerank,
)
from stitchrank.operators.scale import SIM_DECIMALS, checkpointed, stable

BROADCAST_BYTES = 128 << 20  # an index with its attributes up to this size goes to every executor
SPREAD_ROWS = 20_000  # queries of an index of so many rows are dealt to all tasks, however few files they come from
MIN_CONF = 0.1  # crop confidences count as at least this
FULL_IMAGE_CONF = 0.6  # confidence given to the extra full-image crop


def _scorer(k: int, by: str | None, query_cols: list[str], index_cols: list[str], schema: pa.Schema, dim: int | None):
    """Build ``(prepare(index), score(queries, prepared) -> batches of top-k rows)`` for Arrow tables.

    Self-contained on purpose: workers need numpy and pyarrow only.
    """
    Lists = lists_of(k, SIM_DECIMALS)
    at_once, tile, out_rows = 4096, 4096, 16_384  # queries, vectors of the index, rows of a batch

    def matrix(table):
        import pyarrow.compute as pc

        lists = table.column("v").combine_chunks()
        lengths = pc.unique(pc.list_value_length(lists)).to_pylist()
        if lengths != [dim]:
            raise ValueError(f"vectors of length {sorted(lengths)} against an index of length {dim}")
        flat = lists.flatten()
        if flat.null_count:
            raise ValueError("a vector has NULL elements")
        return flat.to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)

    def sections(table):
        """Rows of each value of ``by``, in the order of the table."""
        import numpy as np

        if by is None:
            return {None: np.arange(table.num_rows)}
        coded = table.column(by).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        edges = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
        return {v: order[edges[i] : edges[i + 1]] for i, v in enumerate(coded.dictionary.to_pylist())}

    def prepare(index, in_order=False):
        """The index by section and id with its matrix and the place of each section: once per task."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not index.num_rows:
            return None
        if not in_order:
            index = index.take(pc.sort_indices(index, sort_keys=[("product_id", "ascending")]))
        members = sections(index)
        places = np.concatenate(list(members.values()))
        if not np.array_equal(places, np.arange(len(places))):  # else it is section by section, and no copy is made
            index = index.take(pa.array(places))
        ends = np.cumsum([len(rows) for rows in members.values()])
        return index, matrix(index), {v: (int(e) - len(rows), int(e)) for (v, rows), e in zip(members.items(), ends)}

    def score(queries, prepared):
        import numpy as np
        import pyarrow as pa

        if not queries.num_rows or prepared is None:
            return
        index, p, members = prepared
        right_side = index.select(index_cols)
        for start in range(0, queries.num_rows, at_once):
            some = queries.slice(start, at_once)
            q, left_side = matrix(some).astype(np.float64), some.select(query_cols)
            for section, rows in sections(some).items():
                low, high = members.get(section, (0, 0))
                lists = Lists(q[rows])
                for a in range(low, high, tile):
                    b = min(high, a + tile)
                    lists.add(p[a:b], np.arange(a, b))
                found = lists.best()
                for a in range(0, len(found[0]), out_rows):
                    row, number, value, rank = (x[a : a + out_rows] for x in found)
                    columns = [*left_side.take(pa.array(rows[row])).columns, *right_side.take(pa.array(number)).columns, pa.array(value), pa.array(rank)]
                    yield from pa.table(columns, names=schema.names).cast(schema).combine_chunks().to_batches()

    return prepare, score


@dataclass(frozen=True)
class MeasuredIndex:
    """An index with its size, and on the executors if it is small enough."""

    rows: int
    dim: int | None
    row_bytes: int
    shared: Broadcast | None

    def release(self) -> None:
        """Take the index off the executors, once no query reads it any more."""
        if self.shared is not None:
            self.shared.destroy()


def measured(index: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, by: str | None = None) -> MeasuredIndex:
    """One aggregate over the rows with a vector; their bytes are those of the vectors and of all attributes.

    An index searched by sections is broadcast section by section, so that the executors need no second copy.
    """
    index = index.filter(F.col("v").isNotNull())
    rest = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 8 for c in index.columns if c != "v"]
    size = index.agg(
        F.count("*").alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high"),
        F.coalesce(F.sum(F.size("v") * F.lit(8) + sum(rest, F.lit(0))), F.lit(0)).alias("bytes"),
    ).first()
    if size["n"] and size["low"] != size["high"]:
        raise ValueError(f"vectors of different length in the index: {size['low']} to {size['high']}")
    shared = None
    if size["bytes"] <= broadcast_bytes:
        table = index.toArrow()
        # In the order of the ids, which settles ties; the executors need no second copy for it.
        keys = [(c, "ascending") for c in (by, "product_id") if c]
        shared = index.sparkSession.sparkContext.broadcast(table.take(pc.sort_indices(table, sort_keys=keys)))
    return MeasuredIndex(size["n"], size["high"], -(-size["bytes"] // max(1, size["n"])), shared)


def topk(
    queries: DataFrame,
    index: DataFrame | CellIndex,
    k: int,
    by: str | None = None,
    keep_vector: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    index_block: int | None = None,
    query_block: int | None = None,
    size: MeasuredIndex | None = None,
) -> DataFrame:
    """The ``k`` products of highest inner product for every query row, ties by ``product_id``.

    Two rows get two lists, also if their ids are equal or NULL. ``by`` restricts a query to the
    index rows with the same value of that column (NULL is a value). Rows without a vector have no list.

    One aggregate measures the index (or ``size`` holds it from :func:`measured`). Up to ``broadcast_bytes``
    it is broadcast and the queries stream past it, without a shuffle if it has less than ``SPREAD_ROWS`` rows. Beyond that the query rows are numbered
    and checkpointed, and both sides are cut into blocks by hash, of about ``BLOCK_BYTES`` (of ``index_block`` and
    ``query_block`` rows, as far as :func:`blocks` allows); each (query block,
    index block) pair is one bounded task that returns its own top ``k``, and a ranking window
    (pre-limited before its shuffle) merges them per row. A streaming frame needs the first plan;
    larger indexes are served by :func:`stitchrank.streaming.lookup.start_lookup`.

    A :class:`~stitchrank.operators.cells.CellIndex`, built once, is searched by visiting the blocks that can hold hits.
    """
    if isinstance(index, CellIndex):
        if by != index.by:
            raise ValueError(f"the index has cells by {index.by}, not by {by}")
        return pruned_topk(queries, index, k, keep_vector)[0]
    if k <= 0:
        raise ValueError("k must be > 0")
    queries = queries.filter(F.col("v").isNotNull())
    index = index.filter(F.col("v").isNotNull())
    query_cols = [c for c in queries.columns if c != "v" or keep_vector]
    index_cols = [c for c in index.columns if c not in ("v", by)]
    clash = sorted(set(query_cols) & set(index_cols))
    if clash:
        raise ValueError(f"columns on both sides of topk: {clash}")
    size = size or measured(index, broadcast_bytes, by)

    def schema(numbered: list[T.StructField]) -> T.StructType:
        return T.StructType(
            [queries.schema[c] for c in query_cols] + numbered + [index.schema[c] for c in index_cols]
            + [T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]
        )

    if size.shared is not None:
        shared, out = size.shared, schema([])
        prepare, score = _scorer(k, by, query_cols, index_cols, to_arrow_schema(out), size.dim)

        def stream(batches):
            import pyarrow as pa

            prepared = prepare(shared.value, in_order=True)
            for batch in batches:
                yield from score(pa.Table.from_batches([batch]), prepared)

        if not queries.isStreaming and size.rows >= SPREAD_ROWS:
            # Meeting so many vectors costs far more than moving the query.
            queries = queries.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return queries.mapInArrow(stream, out)

    if queries.isStreaming:
        raise ValueError("the index is too large to stream past; start_lookup serves it by micro-batch")
    # The number of a row is written down, so that all blocks and a task that is run again see the same.
    queries = checkpointed(queries.withColumn("_row", F.monotonically_increasing_id()))
    index_block = index_block or max(1, BLOCK_BYTES // max(1, size.row_bytes))
    query_bytes = 8 * (size.dim or 1) + 256
    query_block = query_block or max(1, BLOCK_BYTES // query_bytes)
    query_blocks = blocks(queries.count(), query_block, query_bytes)
    index_blocks = blocks(size.rows, index_block, size.row_bytes)
    pair = [*([by] if by else []), "_qb", "_ib"]
    left = queries.withColumn("_qb", _block(["_row"], query_blocks)).withColumn(
        "_ib", F.explode(F.sequence(F.lit(0), F.lit(index_blocks - 1)))
    )
    right = index.withColumn("_ib", _block(["product_id"], index_blocks)).withColumn(
        "_qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    )
    out = schema([T.StructField("_row", T.LongType())])
    prepare, score = _scorer(k, by, [*query_cols, "_row"], index_cols, to_arrow_schema(out), size.dim)

    def one_pair(left_table, right_table):
        yield from score(left_table, prepare(right_table))

    partial = paired(left, queries.columns, right, index.columns, pair, one_pair, out)
    best_first = Window.partitionBy("_row").orderBy(F.desc("score"), F.asc("product_id"))
    return partial.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k).drop("_row")


def _block(cols: Sequence[str], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(blocks)).cast("int")


def weight(conf: Column) -> Column:
    """Weight of a crop: its confidence, floored."""
    return F.greatest(conf.cast("double"), F.lit(MIN_CONF))


def _fuse(hits: DataFrame, score: Column) -> DataFrame:
    """One row per (bundle, product).

    Attributes of either side depend on the two ids. They are group keys, not aggregates: a
    text column in an aggregate buffer would force a sort before the map-side combine.
    """
    keep = [c for c in ("section", "gender", "category", "bundle_ts", "product_ts") if c in hits.columns]
    return hits.groupBy("bundle_id", "product_id", *keep).agg(stable(score).alias("score"))


def _post(
    fused: DataFrame, threshold: float, gender_filter: bool, max_per_category: int, final_k: int,
    ts: dict | None = None,
) -> DataFrame:
    ranked = score_threshold(fused, threshold)
    if gender_filter and {"section", "gender"} <= set(ranked.columns):
        ranked = section_filter(ranked)
    if "category" in ranked.columns:
        ranked = category_cap(ranked, max_per_category)
    if ts is not None:
        ranked = ts_rerank(ranked, **ts)
    return top_n(ranked, final_k).select("bundle_id", "product_id", "score", "rank")


def retrieve_max(
    crops: DataFrame,
    index: DataFrame,
    per_box: int = 5,
    final_k: int = 15,
    threshold: float = 0.0,
    gender_filter: bool = True,
    max_per_category: int = 2,
    bundles: DataFrame | None = None,
    fallback: DataFrame | None = None,
) -> DataFrame:
    """R2: best ``per_box`` products of each box, fused by MAX of the raw cosine.

    With ``bundles`` and ``fallback`` (``product_id, position``), bundles without any crop get
    the first ``final_k`` fallback products, their score NULL.
    """
    fused = _fuse(topk(crops, index, per_box), F.max("score"))
    ranked = _post(fused, threshold, gender_filter, max_per_category, final_k)
    if bundles is None or fallback is None:
        return ranked
    # final_k ids at most: safe as one scalar value.
    first = fallback.orderBy("position").limit(final_k)
    ids = F.transform(
        F.array_sort(F.collect_list(F.struct("position", "product_id"))), lambda x: x["product_id"]
    )
    blind = bundles.select("bundle_id").distinct().join(crops.select("bundle_id"), "bundle_id", "left_anti")
    filled = blind.select("bundle_id", F.posexplode(first.agg(ids).scalar()).alias("pos", "product_id"))
    return ranked.unionByName(
        filled.select(
            "bundle_id", "product_id", F.lit(None).cast("double").alias("score"), (F.col("pos") + 1).alias("rank")
        )
    )


def retrieve_sum(
    crops: DataFrame,
    index: DataFrame,
    per_crop: int = 50,
    final_k: int = 15,
    threshold: float = 0.0,
    gender_filter: bool = True,
    max_per_category: int = 2,
    ts: dict | None = None,
) -> DataFrame:
    """``per_crop`` products of each crop, fused by SUM of ``sim * max(conf, 0.1)``.

    ``ts`` holds the keyword arguments of :func:`ts_rerank` when time reranking is wanted.
    """
    hits = topk(crops, index, per_crop)
    fused = _fuse(hits, F.sum(F.col("score") * weight(F.col("conf"))))
    return _post(fused, threshold, gender_filter, max_per_category, final_k, ts)


def retrieve_top1(
    crops: DataFrame, index: DataFrame, threshold: float = 0.0, cap: int = 6, skip_full_image: bool = True
) -> DataFrame:
    """One product per crop; a product keeps the score of the first crop that hit it."""
    if skip_full_image:
        crops = crops.filter(F.col("conf") != FULL_IMAGE_CONF)
    hits = topk(crops, index, 1).withColumn("score", F.col("score") * weight(F.col("conf")))
    fused = _fuse(score_threshold(hits, threshold), F.min_by("score", "crop_id"))
    return _post(fused, 0.0, True, 0, cap)


def section_index(index: DataFrame, sections: DataFrame) -> DataFrame:
    """Index rows once per allowed section; ``sections`` has ``product_id, section``."""
    return index.join(sections.select("product_id", "section").distinct(), "product_id")


def search_section(section: Column, known: Sequence[int] = (1, 2, 3), default: int = 1) -> Column:
    """The section a query searches; missing or unknown ones go to ``default``."""
    return F.when(section.isin(*known), section.cast("int")).otherwise(F.lit(default))


def classify_crops(crops: DataFrame, categories: DataFrame, k: int = 3, keep_vector: bool = False) -> DataFrame:
    """The ``k`` nearest categories of each crop; ``categories`` has ``category, v``."""
    named = categories.select(F.col("category").alias("product_id"), "v")
    hits = topk(crops, named, k, keep_vector=keep_vector)
    return hits.withColumnsRenamed({"product_id": "top_category", "score": "category_score"})


def overfetch_filter(candidates: DataFrame, allowed: Column, filtered: Column, k: int, factor: int = 3) -> DataFrame:
    """The first ``k`` candidates per crop, after a class filter where one applies.

    ``candidates`` holds ``factor * k`` per crop. ``filtered`` says whether the crop has a
    class filter; if not, only its first ``k`` are looked at.
    """
    seen = F.col("rank") <= F.when(filtered, F.lit(k * factor)).otherwise(F.lit(k))
    kept = candidates.filter(seen & (~filtered | allowed))
    in_order = Window.partitionBy("crop_id").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(in_order)).filter(F.col("rank") <= k)


def retrieve_boosted(
    crops: DataFrame,
    index: DataFrame,
    sections: DataFrame,
    categories: DataFrame,
    taxonomy: DataFrame | None = None,
    per_crop: int = 20,
    category_boost: float = 1.4,
    article_boost: float = 1000.0,
    pool: int = 60,
    max_per_category: int = 2,
) -> DataFrame:
    """Section-wise retrieval with class filter, boosts and MAX fusion floored at 0.

    ``taxonomy`` maps ``category`` to ``cls``; ``bundle_article`` on the crops and
    ``article`` on the index switch the article boost on.
    """
    searched = crops.withColumn("_search", search_section(F.col("section")))
    classified = classify_crops(searched, categories, 1, keep_vector=True).drop("category_score", "rank")
    products = index
    if taxonomy is not None:
        classes = taxonomy.select("category", F.col("cls").alias("category_cls"))
        products = products.join(classes, "category", "left")
    products = section_index(products, sections).withColumnRenamed("section", "_search")

    if taxonomy is None:
        hits = topk(classified, products, per_crop, by="_search")
    else:
        known = taxonomy.select(F.col("cls").alias("_known")).distinct()
        classified = classified.join(known, F.col("cls") == F.col("_known"), "left")
        hits = topk(classified, products, 3 * per_crop, by="_search")
        allowed = (F.col("category") == "") | F.coalesce(F.col("category_cls") == F.col("cls"), F.lit(False))
        hits = overfetch_filter(hits, allowed, F.col("_known").isNotNull(), per_crop)

    score = F.col("score") * weight(F.col("conf"))
    score = score * F.when(
        (F.col("top_category") != "") & (F.col("category") == F.col("top_category")), category_boost
    ).otherwise(1.0)
    if "bundle_article" in hits.columns and "article" in hits.columns:
        same = (F.col("bundle_article") == F.col("article")) & (F.col("article") != "")
        score = score * F.when(same, article_boost).otherwise(1.0)
    fused = _fuse(hits.withColumn("score", score), F.greatest(F.lit(0.0), F.max("score")))
    fused = section_filter(fused) if "gender" in fused.columns else fused
    return category_cap_backfill(fused, max_per_category, pool).select(
        "bundle_id", "product_id", "score", "rank"
    )


def lookup_products(
    queries: DataFrame, index: DataFrame, products: DataFrame, k: int = 8, size: MeasuredIndex | None = None
) -> DataFrame:
    """The ``k`` nearest products with description and printed score."""
    hits = topk(queries, index.select("product_id", "v"), k, size=size)
    return (
        hits.join(products.select("product_id", "description"), "product_id", "left")
        .withColumn("description", F.coalesce("description", F.lit("")))
        .withColumn("score_text", score_text(F.col("score")))
    )


def hard_negatives(queries: DataFrame, index: DataFrame, truth: DataFrame, top_k: int = 16, max_neg: int = 4) -> DataFrame:
    """The closest products of a bundle, among its nearest ``top_k``, that are no positives."""
    hits = topk(queries, index.select("product_id", "v"), top_k)
    wrong = hits.join(truth.select("bundle_id", "product_id"), ["bundle_id", "product_id"], "left_anti")
    return top_n(wrong, max_neg)
