"""Helpers shared by the operators of this subpackage: tables, words, digests, written frames."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stitchrank.operators.scale import shared_dir

# A word is a longest run of bytes other than these; ``bytes.split()`` cuts at exactly the same set.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
# Sorts after every other id: a null id counts as larger than all others.
NULL_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    Smaller than a checkpoint, since Parquet encodes and compresses columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Tasks of a shuffle, as the session sets them in proportion to its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A 64-bit key of a row. Rows equal in id and text share it, and share their result."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text))


def remainder(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod ``modulus``; a null id gives null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` hinted for a broadcast if it has at most ``rows`` rows; else as it is, for a shuffled join.

    Counting stops one row beyond the bound. ``df`` should be a written or small derived table.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class WordHashes(dict):
    """64-bit hash of a word, remembered for the words seen lately; the memory is bounded."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def word_hashes(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (multiply and shift, twice)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


BASE = 0x9E3779B97F4A7C15


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive symbols; ``len(h) - k + 1`` values, not yet mixed.

    Runs are joined by doubling, so the cost grows with log k.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    done, have, power, size, step, rest = None, 0, h, 1, BASE, k
    while rest:
        if rest & 1:
            if done is None:
                done, have = power, size
            else:
                m = len(h) - have - size + 1
                done = done[:m] * np.uint64(pow(BASE, size, 1 << 64)) + power[have : have + m]
                have += size
        rest >>= 1
        if rest:
            m = len(power) - size
            power = power[:m] * np.uint64(step) + power[size : size + m]
            size *= 2
            step = step * step % (1 << 64)
    return done[:n]


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Smallest of every ``w`` consecutive values."""
    size = 1
    while size * 2 <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return h if size == w else np.minimum(h[: len(h) - (w - size)], h[w - size :])
