"""Product lookup over a stream of query vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from stitchrank.operators.retrieve import lookup_products, measured, topk


def lookup_stream(stream: DataFrame, index: DataFrame, k: int = 8) -> DataFrame:
    """Streaming frame of the ``k`` nearest products of every query.

    Stateless: the whole top-k of a query is found in its own micro-batch row. The static
    index is broadcast, so it must fit the size bound of :func:`topk`; :func:`start_lookup`
    serves larger ones.
    """
    return topk(stream, index.select("product_id", "v"), k)


def start_lookup(
    stream: DataFrame,
    index: DataFrame,
    products: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    k: int = 8,
    **trigger: object,
) -> StreamingQuery:
    """Run R9 on every micro-batch and hand the result to ``write(batch, batch_id)``.

    Works for an index of any size; it is measured, and broadcast if small, once for all batches.
    ``write`` should be idempotent per ``batch_id``.
    """
    size = measured(index.select("product_id", "v"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        write(lookup_products(batch, index, products, k, size), batch_id)

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
