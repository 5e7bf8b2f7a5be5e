"""The best inner products of one task's queries and vectors, and tasks that meet two groups of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 64 << 20  # size of one block of the index, or of the queries
BLOCKS = 16  # blocks a side is cut into, at most, while they are no larger than that


def blocks(rows: int, block_rows: int, row_bytes: int) -> int:
    """Blocks of ``block_rows`` rows; larger ones where that would make more than ``BLOCKS`` of less than ``BLOCK_BYTES``.

    Every block of one side meets a copy of the other side, so small blocks of many rows would be copies without end.
    """
    return max(1, min(-(-rows // max(1, block_rows)), max(BLOCKS, -(-rows * row_bytes // BLOCK_BYTES))))


def lists_of(k: int, decimals: int):
    """The class of lists of the ``k`` best products per query.

    Self-contained on purpose: workers need numpy only.
    """
    cells = 1 << 20  # scores held at once
    pending_rows = 1 << 14

    def pairs(mask):
        import numpy as np

        return np.divmod(np.flatnonzero(mask), mask.shape[1])

    def places(rows):
        """Place of each entry in its run of equal rows."""
        import numpy as np

        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        return np.arange(len(rows)) - np.repeat(starts, np.diff(starts, append=len(rows)))

    class Lists:
        """Best vectors per query, added block by block; ties go to the lower number.

        Products are computed in single precision first, whose error is bounded; pairs that may reach the k-th score known
        for their query are computed in double precision, rounded and ranked. ``floor`` is a score below which nothing counts.
        """

        def __init__(self, q, floor=None) -> None:
            import numpy as np

            self.q, self.single = q, q.astype(np.float32)
            self.norm = np.sqrt((q * q).sum(axis=1))
            self.cut = np.full(len(q), -np.inf) if floor is None else np.array(floor, dtype=float)
            self.kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            self.pending, self.waiting = [], 0

        def add(self, p, numbers, rows=None) -> None:
            """Meet the vectors ``p``, whose ``numbers`` ascend, with all queries or with those in ``rows``."""
            import numpy as np

            if not len(p) or not len(self.q):
                return
            longest = float(np.sqrt((p.astype(float) ** 2).sum(axis=1).max()))
            reach = self.norm * longest
            # Beyond single precision: the same steps in double.
            wide = not reach.max() < 1e30 or not longest < 1e30 or not self.norm.max() < 1e30
            q, right = (self.q, p.astype(float)) if wide else (self.single, p.astype(np.float32, copy=False))
            error = (p.shape[1] + 8) * 2.0**-23 * reach + 2 * 10.0**-decimals
            n = len(self.q) if rows is None else len(rows)
            step = max(1, cells // len(p))
            for start in range(0, n, step):
                chosen = np.arange(start, min(n, start + step)) if rows is None else rows[start : start + step]
                part = slice(start, start + step) if rows is None else chosen
                low = (self.cut[part] - error[part]).astype(right.dtype)
                fresh = low.max() == -np.inf  # no list is full yet
                if not fresh:
                    near = q[part] @ right.T
                    r, c = pairs(~(near < low[:, None]) if wide else near >= low[:, None])
                if fresh or len(r) * 8 > len(chosen) * len(p):
                    r, c, score = self._dense(part, p)
                    self._put(chosen[r], numbers[c], score)
                    continue
                for a in range(0, len(r), 16_384):
                    i, j = chosen[r[a : a + 16_384]], c[a : a + 16_384]
                    self._put(i, numbers[j], np.round(np.einsum("ij,ij->i", self.q[i], p[j].astype(float)), decimals))

        def add_seen(self, p, numbers, rows, seen) -> None:
            """Meet the vectors ``p`` with the queries ``rows`` where ``seen``, all in double precision: for few pairs."""
            import numpy as np

            score = np.round(self.q[rows] @ p.astype(float).T, decimals)
            r, c = pairs(seen & ~(score < self.cut[rows][:, None]))
            self._put(rows[r], numbers[c], score[r, c])

        def _dense(self, part, p):
            """Pairs that reach the k-th score within the block."""
            import numpy as np

            score = np.round(self.q[part] @ p.astype(float).T, decimals)
            if k < score.shape[1]:
                kth = -np.partition(-score, k - 1, axis=1)[:, k - 1]
                r, c = pairs(~(score < np.maximum(kth, self.cut[part])[:, None]))
            else:
                r, c = pairs(~(score < self.cut[part][:, None]))
            return r, c, score[r, c]

        def _put(self, rows, numbers, scores) -> None:
            self.pending.append((rows, numbers, scores))
            self.waiting += len(rows)
            if self.waiting >= max(pending_rows, len(self.q) * k):
                self._merge()

        def _merge(self) -> None:
            import numpy as np

            rows, numbers, scores = (np.concatenate(a) for a in zip(self.kept, *self.pending))
            self.pending, self.waiting = [], 0
            order = np.lexsort((numbers, -scores, rows))
            rows, numbers, scores = rows[order], numbers[order], scores[order]
            place = places(rows)
            keep, last = place < k, place == k - 1
            self.kept = rows[keep], numbers[keep], scores[keep]
            self.cut[rows[last]] = np.fmax(self.cut[rows[last]], scores[last])

        def best(self):
            """(row, number, score, rank) of all entries, list by list."""
            import numpy as np

            if self.pending:
                self._merge()
            rows, numbers, scores = self.kept
            return rows, numbers, scores + 0.0, (places(rows) + 1).astype(np.int32)

    return Lists


def paired(
    left: DataFrame, left_cols: Sequence[str], right: DataFrame, right_cols: Sequence[str], keys: Sequence[str],
    work: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: T.StructType,
) -> DataFrame:
    """Rows of both frames that are equal in ``keys`` meet in one task; what ``work`` yields leaves it batch by batch."""
    one, two = F.struct(*left_cols), F.struct(*right_cols)
    types = [df.select(s.alias("s")).schema["s"].dataType for df, s in ((left, one), (right, two))]
    rows = left.select(*keys, one.alias("_left"), F.lit(None).cast(types[1]).alias("_right")).union(
        right.select(*keys, F.lit(None).cast(types[0]).alias("_left"), two.alias("_right"))
    )

    def one_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = {"_left": [], "_right": []}
        for batch in batches:
            for name, parts in sides.items():
                column = batch.column(name)
                parts.append(pa.RecordBatch.from_struct_array(column.filter(column.is_valid())))
        tables = [pa.Table.from_batches(parts) for parts in sides.values()]
        if all(t.num_rows for t in tables):
            yield from work(*tables)

    return rows.groupBy(*keys).applyInArrow(one_group, schema)
