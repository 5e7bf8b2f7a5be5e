"""An index in cells around pivots, and exact search that leaves out cells that cannot hold a hit."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stitchrank.operators.nearest import BLOCK_BYTES, blocks, lists_of, paired
from stitchrank.operators.nearest import BLOCKS as PACK_GROUPS
from stitchrank.operators.scale import SIM_DECIMALS, checkpointed, shared_dir

PIVOTS = 1024  # at most; fewer for a small index (the square root of its rows)
SAMPLE = 65_536  # vectors that the pivots are taken from
CELL_ROWS = 4096  # a block of a cell holds about so many rows
QUERY_ROWS = 4096  # queries that meet a block in one task
BLOCKS = 2048  # about as many at most: every query has a bound for each, so that this work grows with the queries alone
# Bounds and scores are sums of the same numbers in another order; a block is left out only beyond this.
SLACK = 1e-7
AHEAD = 8  # blocks of the second round


@dataclass(frozen=True)
class CellIndex:
    """A written index: ``rows`` with ``_block``, and the bounds of every block."""

    rows: DataFrame
    blocks: DataFrame
    pivots: np.ndarray
    by: str | None
    path: str

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rows.columns if c != "_block"]

    def select(self, *columns: str) -> CellIndex:
        """The same index with these columns only; ``v`` has to be one of them."""
        return replace(self, rows=self.rows.select(*columns, "_block"))


def _pivots(vectors: DataFrame, n: int, seed: int, most: int) -> np.ndarray:
    """Pivots by three rounds of spherical means over the vectors with the lowest seeded hashes, ``SAMPLE`` at most."""
    draw = F.xxhash64(F.lit(seed), F.col("product_id").cast("string"))
    sample = vectors.select(draw.alias("_h"), F.col("v").cast("array<double>").alias("v")).orderBy("_h").limit(SAMPLE)
    x = _vectors(sample.select("v").toArrow().column("v").combine_chunks())
    k = min(most, max(1, int(np.sqrt(n))), len(x))
    centers = x[np.linspace(0, len(x) - 1, k).astype(int)] if len(x) else np.zeros((0, 0))
    for _ in range(3):
        near = np.argmin(-2 * x @ centers.T + (centers**2).sum(axis=1), axis=1) if k else []
        for c in np.unique(near):
            centers[c] = x[near == c].mean(axis=0)
    return centers


def _vectors(column) -> np.ndarray:
    rows = len(column)
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("a vector has NULL elements")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1 if rows else 0)


def build_cells(
    index: DataFrame, path: str | None = None, by: str | None = None, seed: int = 7, cell_rows: int = CELL_ROWS, pivots: int = PIVOTS
) -> CellIndex:
    """``index`` (product_id, v, ...) written in blocks of neighbouring vectors; rows without a vector are left out.

    A row belongs to its nearest pivot; a cell is cut into rings by the distance from it, and a ring that is still
    too large (copies of one vector, say) by a hash, so that no block grows with a hot cell. A block's bounds are the
    smallest and largest distance and the largest norm. With ``by``, blocks hold one value of that column each.
    """
    spark = index.sparkSession
    index = index.filter(F.col("v").isNotNull())
    size = index.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    if size["low"] != size["high"]:
        raise ValueError(f"vectors of different length in the index: {size['low']} to {size['high']}")
    path = path or f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}"
    cell_rows = max(cell_rows, 2 * size["n"] // BLOCKS)
    centers = _pivots(index, size["n"], seed, pivots)
    schema = T.StructType([*index.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_far", T.DoubleType()), T.StructField("_norm", T.DoubleType())])

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column("v"))
                cell = np.argmin(-2 * x @ centers.T + (centers**2).sum(axis=1), axis=1)
                far, norm = np.linalg.norm(x - centers[cell], axis=1), np.linalg.norm(x, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far), pa.array(norm)], names=schema.names)

    index.mapInArrow(assign, schema).write.parquet(f"{path}/assigned")
    rows = spark.read.schema(schema).parquet(f"{path}/assigned")
    section = [F.col(by).alias("_by")] if by else [F.lit(None).cast("string").alias("_by")]
    keyed = rows.withColumn("_by", section[0])
    # At most pivots x values of ``by`` rows, and as many rings as blocks.
    cells = keyed.groupBy("_by", "_cell").agg(F.count("*").alias("_n"), F.min("_far").alias("_low"), F.max("_far").alias("_high"))
    cells = cells.select(F.col("_by").alias("_b"), F.col("_cell").alias("_c"), F.ceil(F.col("_n") / cell_rows).alias("_rings"), "_low", "_high")
    width = (F.col("_high") - F.col("_low")) / F.col("_rings")
    ring = F.when(width > 0, F.least(F.floor((F.col("_far") - F.col("_low")) / width), F.col("_rings") - 1)).otherwise(0).cast("int")
    ringed = keyed.join(cells, F.col("_by").eqNullSafe(F.col("_b")) & (F.col("_cell") == F.col("_c"))).withColumn("_ring", ring)
    ringed = ringed.drop("_b", "_c", "_rings", "_low", "_high")
    rings = ringed.groupBy("_by", "_cell", "_ring").agg(F.ceil(F.count("*") / cell_rows).alias("_parts"))
    rings = rings.select(F.col("_by").alias("_b"), F.col("_cell").alias("_c"), F.col("_ring").alias("_r"), "_parts")
    part = F.pmod(F.xxhash64(F.col("product_id").cast("string")), F.col("_parts"))
    same = F.col("_by").eqNullSafe(F.col("_b")) & (F.col("_cell") == F.col("_c")) & (F.col("_ring") == F.col("_r"))
    # A block's name: by its own keys, so that it is the same whatever the order of tasks.
    name = F.xxhash64(F.coalesce(F.col("_by").cast("string"), F.lit("")), F.col("_by").isNull(), "_cell", "_ring", part)
    blocked = ringed.join(rings, same).withColumn("_block", name)
    out = [*index.columns, "_block"]
    blocked.select(*out, "_by", "_cell", "_far", "_norm").repartition("_block").sortWithinPartitions("_block").write.parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    blocks = stored.groupBy("_block", "_by", "_cell").agg(
        F.count("*").alias("rows"), F.min("_far").alias("low"), F.max("_far").alias("high"), F.max("_norm").alias("norm")
    )
    blocks.write.parquet(f"{path}/blocks")
    return CellIndex(stored.select(*out), spark.read.parquet(f"{path}/blocks"), centers, by, path)


class Bounds:
    """Upper bounds of the inner products of queries with the vectors of each block."""

    def __init__(self, blocks: dict[str, np.ndarray], pivots: np.ndarray) -> None:
        self.blocks, self.pivots = blocks, pivots
        self.lengths = np.linalg.norm(pivots, axis=1) if len(pivots) else np.zeros(0)
        # Blocks lie by the values of ``by``: one range each.
        self.of: dict = {}
        for i, by in enumerate(blocks["_by"]):
            self.of[by] = (self.of.get(by, (i, i))[0], i + 1)

    def above(self, q: np.ndarray, first: int, last: int) -> np.ndarray:
        """(query, block) bounds for a range of blocks.

        With d the distance of query and pivot, a vector at distance r from the pivot is at least |d - r| from the query
        (triangle inequality), which bounds the product from above; so do the norms, and the pivot's product with r.
        """
        cell, low, high, norm = (self.blocks[c][first:last] for c in ("_cell", "low", "high", "norm"))
        length, product = np.linalg.norm(q, axis=1)[:, None], q @ self.pivots.T
        d = np.sqrt(np.maximum(0.0, length**2 + self.lengths**2 - 2 * product))
        # The distance comes from squares, and is as exact as their root.
        d, lax = d[:, cell], 1e-7 * (length + self.lengths[cell])
        gap = np.maximum(0.0, np.maximum(d - high, low - d) - lax)
        reach = length * norm
        bound = np.minimum((length**2 + norm**2 - gap**2) / 2, np.minimum(reach, product[:, cell] + length * high))
        return bound + SLACK * (1 + reach)


def first_blocks(above: np.ndarray, rows: np.ndarray, k: int, more: int) -> np.ndarray:
    """Mask of the blocks of highest bound that hold ``k`` rows, and of ``more`` after them."""
    most = min(above.shape[1], k + more)  # no block is empty
    some = np.argpartition(-above, most - 1, axis=1)[:, :most]
    some = np.take_along_axis(some, np.argsort(-np.take_along_axis(above, some, axis=1), axis=1, kind="stable"), axis=1)
    held = np.cumsum(rows[some], axis=1) - rows[some]
    done = (held < k).sum(axis=1, keepdims=True)
    mask = np.zeros(above.shape, bool)
    np.put_along_axis(mask, some, np.arange(most) < done + more, axis=1)
    return mask


def _packs(rows: np.ndarray, sections: np.ndarray, row_bytes: int) -> np.ndarray:
    """Pack of each block: neighbours of one section, of about ``BLOCK_BYTES`` or a share of the rows."""
    if not len(rows):
        return np.zeros(0, np.int32)
    total = int(rows.sum())
    size = -(-total // blocks(total, 1, row_bytes))
    other = np.array([True] + [a != b for a, b in zip(sections[1:], sections[:-1])])
    before = np.cumsum(rows) - rows
    share = (before - before[other][np.cumsum(other) - 1]) // size
    return (np.cumsum(other | (np.diff(share, prepend=0) != 0)) - 1).astype(np.int32)


def pruned_topk(queries: DataFrame, index: CellIndex, k: int, keep_vector: bool = False, query_rows: int = QUERY_ROWS) -> tuple[DataFrame, DataFrame]:
    """What :func:`stitchrank.operators.retrieve.topk` returns, and what it took: (round, visits, pairs, all_pairs).

    Every query first visits the blocks of highest bound until they hold ``k`` rows; the k-th score found is a floor. It
    then visits those and the next eight, as far as they reach the floor, and with the better floor all blocks that do. A block whose
    bound is below the floor can hold neither a hit nor a tie, so the lists of the last round are exact.

    Neighbouring blocks make packs, and a visit is a bit: one row per query and pack with a visit names the blocks visited.
    Queries of a pack meet it in groups of about ``query_rows``, in fewer where :func:`blocks` allows no more; what is shuffled are those rows and a copy of the pack per group.
    Where bounds are of no use (vectors without any clusters), nearly all blocks are visited, as the second frame tells.
    """
    if k <= 0:
        raise ValueError("k must be > 0")
    spark = queries.sparkSession
    queries = queries.filter(F.col("v").isNotNull())
    query_cols = [c for c in queries.columns if c != "v" or keep_vector]
    index_cols = [c for c in index.columns if c not in ("v", index.by)]
    clash = sorted(set(query_cols) & set(index_cols))
    if clash:
        raise ValueError(f"columns on both sides of topk: {clash}")
    queries = checkpointed(queries.withColumn("_row", F.monotonically_increasing_id()))
    # The bounds of all blocks: at most BLOCKS rows of numbers, by section and cell.
    table = index.blocks.orderBy("_by", "_cell", "_block").toArrow()
    kinds = {"_by": object, "low": float, "high": float, "norm": float}
    columns = {c: np.array(table.column(c).to_pylist(), dtype=kinds.get(c, np.int64)) for c in table.column_names}
    dim = index.pivots.shape[1] if len(index.pivots) else 0
    pack = _packs(columns["rows"], columns["_by"], 8 * dim + 256)
    edges = np.searchsorted(pack, np.arange(int(pack[-1]) + 2 if len(pack) else 1))
    shared = spark.sparkContext.broadcast((columns, index.pivots, edges))
    slot = np.arange(len(pack)) - edges[pack] if len(pack) else pack
    places = spark.createDataFrame(pa.table({"_block": pa.array(columns["_block"], pa.int64()), "_pack": pa.array(pack, pa.int32()), "_slot": pa.array(slot, pa.int32())}))
    by = F.col(index.by) if index.by else F.lit(None).cast("string")
    plain = queries.select("_row", "v", by.alias("_by"))

    def visits(rows: DataFrame, stage: int) -> DataFrame:
        """(_row, _pack, _mask, visits, pairs) of a round; ``rows`` has the ``floor`` of the queries."""

        def choose(batches):
            import pyarrow as pa

            blocks, pivots, edges = shared.value
            bounds = Bounds(blocks, pivots)
            step = max(1, (1 << 20) // max(1, len(blocks["rows"])))
            for batch in (b.slice(a, step) for b in batches for a in range(0, b.num_rows, step)):
                q, sections = _vectors(batch.column("v")), np.array(batch.column("_by").to_pylist(), dtype=object)
                if len(edges) < 2:
                    continue
                if q.shape[1] != dim:
                    raise ValueError(f"vectors of length {q.shape[1]} against an index of length {dim}")
                names, floor = batch.column("_row").to_numpy(), batch.column("floor").to_numpy()
                for section, (first, last) in bounds.of.items():
                    mine = np.flatnonzero([s == section for s in sections])
                    if not len(mine):
                        continue
                    mask = np.empty((len(mine), last - first), bool)
                    few = max(1, (1 << 16) // (last - first))  # so many stay in the processor's cache
                    for a in range(0, len(mine), few):
                        above = bounds.above(q[mine[a : a + few]], first, last)
                        mask[a : a + few] = above >= floor[mine[a : a + few]][:, None]
                        if stage < 2:
                            mask[a : a + few] &= first_blocks(above, blocks["rows"][first:last], k, AHEAD if stage else 0)
                    for number in range(*np.searchsorted(edges, [first, last])):
                        part = mask[:, edges[number] - first : edges[number + 1] - first]
                        here = np.flatnonzero(part.any(axis=1))
                        if len(here):
                            part = part[here]
                            bits = np.packbits(part, axis=1)
                            yield pa.RecordBatch.from_arrays([
                                pa.array(names[mine[here]]), pa.array(np.full(len(here), number, np.int32)), pa.array([x.tobytes() for x in bits], pa.binary()),
                                pa.array(part.sum(axis=1)), pa.array(part @ blocks["rows"][edges[number] : edges[number + 1]]),
                            ], ["_row", "_pack", "_mask", "visits", "pairs"])

        spread = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_row")
        return checkpointed(spread.mapInArrow(choose, "_row bigint, _pack int, _mask binary, visits bigint, pairs bigint"))

    stored = index.rows.join(F.broadcast(places), "_block").drop("_block")

    def scored(pairs: DataFrame, floors: DataFrame, query_cols: list[str], index_cols: list[str]) -> DataFrame:
        """The best ``k`` of each query in each pack that it visits. A pack that many queries visit is met by several groups of them."""
        out = T.StructType(
            [queries.schema[c] for c in query_cols] + [T.StructField("_row", T.LongType())] + [index.rows.schema[c] for c in index_cols]
            + [T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]
        )
        schema, left_cols = to_arrow_schema(out), [*query_cols, "_row"]
        Lists = lists_of(k, SIM_DECIMALS)

        def meet(left: pa.Table, right: pa.Table):
            import pyarrow as pa
            import pyarrow.compute as pc

            right = right.take(pc.sort_indices(right, sort_keys=[("product_id", "ascending")]))
            q, p = (_vectors(t.column("v").combine_chunks()) for t in (left, right))
            slots = right.column("_slot").to_numpy()
            bits = np.ascontiguousarray(np.frombuffer(b"".join(left.column("_mask").to_pylist()), np.uint8).reshape(left.num_rows, -1).T)
            lists = Lists(q, left.column("floor").to_numpy())
            if np.bitwise_count(bits).sum() * 2 > len(q) * (int(slots.max()) + 1):
                # Most blocks are visited: the pack is scored as it lies, which is faster than block by block.
                for a in range(0, len(p), CELL_ROWS):
                    lists.add(p[a : a + CELL_ROWS], np.arange(a, min(len(p), a + CELL_ROWS)))
            else:
                number = np.argsort(slots, kind="stable")
                starts = np.flatnonzero(np.diff(slots[number], prepend=-1))
                for a, b in zip(starts, [*starts[1:], len(slots)]):
                    at = int(slots[number[a]])
                    rows = np.flatnonzero(bits[at >> 3] & (128 >> (at & 7)))
                    if len(rows):
                        lists.add(p[number[a:b]], number[a:b], None if len(rows) == len(q) else rows)
            found, left, right = lists.best(), left.select(left_cols), right.select(index_cols)
            for a in range(0, len(found[0]), 16_384):
                row, place, value, rank = (x[a : a + 16_384] for x in found)
                columns = [*left.take(pa.array(row)).columns, *right.take(pa.array(place)).columns, pa.array(value), pa.array(rank)]
                yield from pa.table(columns, names=schema.names).cast(schema).combine_chunks().to_batches()

        count = F.count("*")
        most = F.greatest(F.lit(PACK_GROUPS), F.ceil(count * (8 * dim + 256) / BLOCK_BYTES))
        groups = pairs.groupBy("_pack").agg(F.least(F.ceil(count / query_rows), most).cast("int").alias("_groups"))
        asked = queries.select("_row", "v", *[c for c in query_cols if c != "v"]).join(floors, "_row")
        left = pairs.join(F.broadcast(groups), "_pack").withColumn("_group", F.pmod(F.xxhash64("_row"), F.col("_groups")).cast("int")).join(asked, "_row")
        right = stored.join(F.broadcast(groups), "_pack").withColumn("_group", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)))
        return paired(
            left, ["_row", "v", "_mask", "floor", *[c for c in query_cols if c != "v"]], right, [*index_cols, "v", "_slot"], ["_pack", "_group"], meet, out
        )

    best_first = Window.partitionBy("_row").orderBy(F.desc("score"), F.asc("product_id"))
    made, floors = [], plain.select("_row", F.lit(float("-inf")).alias("floor"))
    for stage in range(3):
        pairs = visits(plain.join(floors, "_row"), stage)
        made.append(pairs.agg(F.lit(stage).alias("round"), F.coalesce(F.sum("visits"), F.lit(0)).alias("visits"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")))
        if stage < 2:
            part = scored(pairs, floors, [], ["product_id"]).withColumn("rank", F.row_number().over(best_first))
            kth = part.filter(F.col("rank") == k).select("_row", F.col("score").alias("kth"))
            floors = checkpointed(floors.join(kth, "_row", "left").select("_row", F.greatest("floor", "kth").alias("floor")))
    found = scored(pairs, floors, query_cols, index_cols)
    ranked = found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
    # Every query with every row of its value of ``by``.
    per = index.blocks.groupBy("_by").agg(F.sum("rows").alias("rows")).withColumnRenamed("_by", "_of")
    pool = plain.groupBy("_by").agg(F.count("*").alias("n")).join(per, F.col("_by").eqNullSafe(F.col("_of")))
    whole = pool.agg(F.coalesce(F.sum(F.col("n") * F.col("rows")), F.lit(0)))
    report = made[0].unionByName(made[1]).unionByName(made[2]).withColumn("all_pairs", F.lit(whole.first()[0]))
    return ranked.drop("_row"), report
