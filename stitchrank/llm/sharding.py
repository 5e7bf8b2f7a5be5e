"""Operator 8: contiguous shards of equal bytes, by DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stitchrank.llm.common import partitions, table, written

SHARDS = 40
OVERHEAD = 16


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text plus the bytes a row costs besides; a null text has none of its own."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def byte_shards(docs: DataFrame, shards: int, order: Sequence[Column], size: Column, keep: Sequence[Column]) -> DataFrame:
    """``keep``, ``size``, ``shard`` and ``slot`` of every row of ``docs``.

    Rows are put in the total order ``order`` by a range shuffle of the narrow columns, each partition
    is totalled, and the totals of the partitions before shift the running sums inside it; no window
    sees more than one partition. A row goes to the shard in which the middle of its bytes falls, so
    shards are contiguous and each differs from the target by less than a row at either cut. ``slot`` is the
    row's place in its shard. The sorted rows are written once, so that totals and sums see the same
    partitions; a place in the scan splits the ranges of a hot id. An empty table gives no rows.
    """
    narrow = docs.select(*keep, size.alias("size"), *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    narrow = narrow.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col(f"_o{i}").asc_nulls_last() for i in range(len(order))] + [F.col("_tie")]
    names = [c for c in narrow.columns if not c.startswith("_o") and c != "_tie"]
    lined = narrow.repartitionByRange(partitions(docs.sparkSession), *keys).sortWithinPartitions(*keys).select(*names, F.monotonically_increasing_id().alias("_at"))
    lined = written(lined).withColumn("_part", F.shiftright("_at", 33))
    totals = lined.groupBy("_part").agg(F.sum("size").alias("_bytes"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sort: its number bounds the window, the join and the broadcast.
    offsets = totals.select("_part", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_offset"), F.sum("_bytes").over(Window.partitionBy()).alias("_total"))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    # By twice the middle of the row, in exact integers.
    cut = F.expr(f"(2 * _start + size) * {int(shards)} div (2 * _total)")
    cutted = (
        lined.join(F.broadcast(offsets), "_part").withColumn("_start", start)
        .withColumn("shard", F.least(cut, F.lit(shards - 1)).cast("int"))
    )
    placed = cutted.withColumn("_place", F.row_number().over(Window.partitionBy("_part", "shard").orderBy("_at")))
    # A shard spans partitions: shift by its rows in the partitions before (at most parts + shards rows in all).
    counts = cutted.groupBy("shard", "_part").agg(F.count("*").alias("_rows"))
    ahead = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "_part", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_ahead"))
    return (
        placed.join(F.broadcast(counts), ["shard", "_part"])
        .withColumn("slot", F.col("_ahead") + F.col("_place") - 1)
        .select(*names, "shard", "slot")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    Shards follow doc_id (nulls last); rows of one id stay together but for a cut. A null text counts
    as empty: size 16, crc32 0. grown_shard is null: the law is ``bytes``, all cuts move when shards are added.
    """
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    placed = byte_shards(docs, shards, [F.col("doc_id"), crc], text_bytes(), [F.col("doc_id"), crc.alias("text_crc32")])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_sharding(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"))


# CRC-32 over the hexadecimal digits of the text; its table is built by its rule.
OP8_SQL = r"""
with crc_table as (
  select list(v order by n) as t from (
    select n, list_reduce(list_concat([n::bigint], [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
                          lambda a, b: case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v
    from range(256) r(n))),
digits as (
  select doc_id, (coalesce(strlen(text), 0) + 16)::bigint as size, hex(encode(coalesce(text, ''))) as h from documents),
sized as (
  select doc_id, size,
         xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::bigint, 2))::bigint)),
                         lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)::bigint as text_crc32
  from digits, crc_table),
placed as (
  select *, sum(size) over () as total,
         coalesce(sum(size) over (order by doc_id nulls last, text_crc32 rows between unbounded preceding and 1 preceding), 0) as start
  from sized),
cut as (select *, least(39, (2 * start + size) * 40 // (2 * total))::int as shard from placed)
select doc_id, size, text_crc32, 'bytes' as law, shard,
       row_number() over (partition by shard order by doc_id nulls last, text_crc32) - 1 as slot, null::int as grown_shard
from cut
"""
