"""Operator 3: exact dedup over a cuckoo-filter index of live digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stitchrank.llm.common import NULL_ID, SPACES, partitions, table, written

SLOTS = 4
KICKS = 200
# Digests a task keeps before it passes its groups on.
MOST_LIVE = 200_000


class CuckooIndex:
    """Set of live digests: a cuckoo filter whose buckets hold the content beside the fingerprints.

    A digest lies in one of two buckets of ``SLOTS`` slots; a slot has a 16-bit fingerprint, and beside it the
    stored key and value. A lookup that finds the fingerprint in neither bucket is a certain miss; a hit is
    verified against the keys stored in those slots, and nowhere else. When an insertion finds no
    free slot after ``KICKS`` moves, the table doubles and is filled anew from the stored keys. Deletion clears one slot.
    """

    def __init__(self, buckets: int = 1024):
        self._reset(buckets)

    def _reset(self, buckets: int) -> None:
        self.buckets = buckets
        self.live = 0
        self.slots = [0] * (buckets * SLOTS)
        self.entries: list[tuple[bytes, object] | None] = [None] * (buckets * SLOTS)

    def __len__(self) -> int:
        return self.live

    def items(self) -> Iterator[tuple[bytes, object]]:
        """The live digests and what is stored for them."""
        return (entry for entry in self.entries if entry is not None)

    def clear(self) -> None:
        self._reset(1024)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:8], "little") & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        # An involution, so that either bucket leads to the other without the key.
        return bucket ^ (mark * 0x5BD1E995 & (self.buckets - 1))

    def _free(self, bucket: int) -> int:
        at = bucket * SLOTS
        for i in range(at, at + SLOTS):
            if not self.slots[i]:
                return i
        return -1

    def _find(self, digest: bytes) -> int:
        """The slot of a live digest, else -1."""
        mark, first, second = self._places(digest)
        slots = self.slots
        for bucket in (first, second):
            at = bucket * SLOTS
            for i in range(at, at + SLOTS):
                if slots[i] == mark and self.entries[i][0] == digest:
                    return i
        return -1

    def get(self, digest: bytes):
        """What is stored for a live digest, else None."""
        at = self._find(digest)
        return None if at < 0 else self.entries[at][1]

    def insert(self, digest: bytes, value) -> None:
        """Store ``value`` for a digest, live or not."""
        at = self._find(digest)
        if at >= 0:
            self.entries[at] = digest, value
            return
        homeless = self._place((digest, value))
        if homeless is not None:
            self.resize(homeless)

    def delete(self, digest: bytes) -> bool:
        """Take a digest out; False if it was not live."""
        at = self._find(digest)
        if at < 0:
            return False
        self.slots[at], self.entries[at] = 0, None
        self.live -= 1
        return True

    def resize(self, homeless: tuple[bytes, object]) -> None:
        """Double the table until every stored entry, and the one that found no slot, has one."""
        stored = [*self.items(), homeless]
        while True:
            self._reset(self.buckets * 2)
            if all(self._place(entry) is None for entry in stored):
                return

    def _place(self, entry: tuple[bytes, object]) -> tuple[bytes, object] | None:
        """Give an entry a slot, moving others; returns the entry left without one, if any."""
        mark, first, second = self._places(entry[0])
        at = self._free(first)
        if at < 0:
            at = self._free(second)
        bucket, kick = second, 0
        while at < 0 and kick < KICKS:
            moved = bucket * SLOTS + kick % SLOTS
            mark, self.slots[moved] = self.slots[moved], mark
            entry, self.entries[moved] = self.entries[moved], entry
            bucket, kick = self._other(bucket, mark), kick + 1
            at = self._free(bucket)
        if at < 0:
            return entry
        self.slots[at], self.entries[at] = mark, entry
        self.live += 1
        return None


GROUP = "digest binary, n_chars long, keep_id long, group_size long, added long"
_GROUP = pa.schema([("digest", pa.binary()), ("n_chars", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("added", pa.int64())])


def _absorb(rows: Iterator[tuple], index: CuckooIndex, most: int) -> Iterator[pa.RecordBatch]:
    """Fold (digest, n_chars, doc_id, change) into the index, passing its groups on when a further digest meets ``most`` of them.

    ``change`` above 0 inserts that many rows, below 0 deletes; a digest with no rows left is deleted.
    The row that stays has the most characters, then the smallest id.
    """
    for digest, n_chars, doc_id, size, added in rows:
        held = index.get(digest)
        if held is None:
            if len(index) >= most:
                yield _groups(index)
            index.insert(digest, [n_chars, doc_id, size, added])
        else:
            held[2] += size
            held[3] += added
            if size > 0 and (-n_chars, doc_id) < (-held[0], held[1]):
                held[0], held[1] = n_chars, doc_id
            if held[2] == 0:
                index.delete(digest)


def _groups(index: CuckooIndex) -> pa.RecordBatch:
    held = list(index.items())
    columns = list(zip(*[value for _, value in held], strict=True)) or [()] * 4
    batch = pa.RecordBatch.from_arrays(
        [pa.array([digest for digest, _ in held], pa.binary()), *[pa.array(c, pa.int64()) for c in columns]], schema=_GROUP
    )
    index.clear()
    return batch


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [
            hashlib.sha256((text or "").encode("utf-8", "surrogatepass").translate(None, SPACES.encode())).digest()
            for text in batch.column("text").to_pylist()
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(found, pa.binary()), batch.column("n_chars")], names=["doc_id", "digest", "n_chars"]
        )


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_chars): SHA-256 of the text without white space, and its code points."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    return rows.mapInArrow(_digests, "doc_id long, digest binary, n_chars long")


def _fold(most: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            yield from _absorb(zip(*[c.to_pylist() for c in batch.columns], strict=True), index, most)
        yield _groups(index)

    return fold


def groups(changes: DataFrame) -> DataFrame:
    """One row per live digest from (digest, n_chars, keep_id, group_size, added).

    Every partition first folds its own rows, so that of a digest held by a third of all rows each
    task passes on one row; then digests meet by hash and the folds are folded, in order, so that a full index passes
    on digests that are complete.
    """
    spark = changes.sparkSession
    local = changes.select("digest", "n_chars", "keep_id", "group_size", "added").mapInArrow(_fold(MOST_LIVE), GROUP)
    return local.repartition(partitions(spark), "digest").sortWithinPartitions("digest").mapInArrow(_fold(MOST_LIVE), GROUP)


def insert(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The index (rows of :func:`groups`) after the rows (doc_id, digest, n_chars) came in."""
    return groups(index.unionByName(_changes(rows, 1)))


def delete(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The index after the rows went out; a digest without rows is no longer live.

    Rows other than the one that stays may go; a digest whose kept row goes must go as a whole.
    """
    return groups(index.unionByName(_changes(rows, -1)))


def _changes(rows: DataFrame, sign: int) -> DataFrame:
    return rows.select(
        "digest", "n_chars", F.coalesce("doc_id", F.lit(NULL_ID)).alias("keep_id"),
        F.lit(sign).cast("long").alias("group_size"), F.lit(0 if sign < 0 else 1).cast("long").alias("added"),
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs``.

    Null and empty texts and texts of white space alone are one group. A null id counts as larger than
    all others (keep_id is null only in a group of null ids). Rows equal in id and characters tie: each of them is
    kept. An empty table gives no rows.
    """
    rows = digests(docs)
    held = groups(_changes(rows, 1))
    own = F.coalesce("doc_id", F.lit(NULL_ID))
    # The rows of one digest are spread over the join by Spark's skew handling; both sides are narrow.
    return rows.withColumnRenamed("n_chars", "_own").join(held, "digest").select(
        "doc_id",
        F.when(F.col("keep_id") != NULL_ID, F.col("keep_id")).alias("keep_id"),
        "group_size",
        ((own == F.col("keep_id")) & (F.col("_own") == F.col("n_chars"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts; its columns unchanged.

    The row that :func:`exact_groups` keeps stays; of several with its id and length that with the smallest hash of the whole row,
    and of rows equal in everything one. Ids may be null, repeat, or have several texts. An empty table stays empty.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]", "").cast("binary"), 256)
    place = F.struct((-F.length(text)).alias("size"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(F.to_json(whole)).alias("of_row"))
    keyed = docs.select(whole.alias("row"), digest.alias("_digest"), place.alias("_place"))
    held = written(keyed.groupBy("_digest").agg(F.min("_place").alias("_best"), F.count("*").alias("n")).where("n > 1").drop("n"))
    judged = keyed.join(held, "_digest", "left")
    return judged.where("_best is null").select("row.*").unionByName(judged.where("_place = _best").dropDuplicates(["_digest", "_place"]).select("row.*"))


def op3_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
with digests as (
  select doc_id, coalesce(length(text), 0) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents),
best as (
  select *, first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id nulls last) as keep_id,
         first_value(n) over (partition by text_sha256 order by n desc, doc_id nulls last) as keep_n,
         count(*) over (partition by text_sha256) as group_size
  from digests)
select doc_id, keep_id, group_size, (doc_id is not distinct from keep_id and n = keep_n) as kept, text_sha256 from best
"""
