"""Operator 9: dedup of repeated byte strings by merging Burrows-Wheeler transforms of shards."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from stitchrank.llm import repeats
from stitchrank.llm.common import table

LENGTH = 50
ANCHOR = 20
SHARDS = 8
# Bytes of contents whose shards are merged at once.
LOT_BYTES = 1_000_000


@dataclass
class Shard:
    """The transform of a list of strings, each closed by an end symbol 0 of its own, in suffix order.

    Symbols are taken one and two at a time: ``ones`` and ``twos`` hold what stands before each suffix, and the
    ``back`` arrays the row of the suffix that begins there, or -1 where the string begins.
    """

    ones: np.ndarray
    twos: np.ndarray
    back_one: np.ndarray
    back_two: np.ndarray
    places: np.ndarray  # the place of each row's suffix in the text


def transform(text: np.ndarray, ends: np.ndarray) -> Shard:
    """Of symbols above 0 with a 0 at each of ``ends``. Suffixes are sorted once, by doubling from eight symbols."""
    n, strings = len(text), len(ends)
    sizes = np.diff(ends, prepend=-1)
    close = np.repeat(ends, sizes)
    at = np.arange(n)
    wide = text.dtype.itemsize > 1
    key = text.astype(np.uint64)
    for step in range(1, 4 if wide else 8):
        key = (key << np.uint64(16 if wide else 8)) | text[np.minimum(at + step, close)]
    have, first = (4 if wide else 8), True
    while True:
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        if first:
            # Ends are apart from the start, in the order of their strings, and before all else.
            rank += strings
            rank[ends] = np.arange(strings)
        elif rank[order[-1]] == n - 1:
            break
        key = rank * (int(rank.max()) + 1) + rank[np.minimum(at + have, close)]
        have, first = have if first else 2 * have, False
    begins = np.repeat(ends - sizes + 1, sizes)
    before = text[at - 1].astype(np.uint32 if wide else np.uint16)
    back = [np.where(order - step >= begins[order], rank[order - step], -1).astype(np.int32) for step in (1, 2)]
    twos = (text[at - 2].astype(before.dtype) << (16 if wide else 8)) | before
    return Shard(text[order - 1], twos[order], back[0], back[1], order)


def interleave(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge transforms: (rows of all suffixes of at least ``depth`` symbols, block of each), equal in the first ``depth``.

    The interleave starts as one shard after the other. Each round sorts it stably by the symbols before
    each row, which puts it in the order of so many symbols more; rows of one shard keep their order
    throughout. Neighbours stay in a block while their symbols and the blocks they came from are
    equal, so the blocks are the intervals of the common prefix. No suffix is compared again. Rows at
    the beginning of a string lead no further and leave, so that those left have ``depth`` symbols.
    """
    at = np.cumsum([0, *[len(s.ones) for s in shards]])

    def joined(name):
        return np.concatenate([np.where(getattr(s, name) < 0, -1, getattr(s, name) + o) for s, o in zip(shards, at, strict=False)]).astype(np.int32)

    rows, block = np.arange(at[-1], dtype=np.int32), np.zeros(at[-1], np.int32)
    for name, back, rounds in (("twos", joined("back_two"), depth // 2), ("ones", joined("back_one"), depth % 2)):
        symbols = np.concatenate([getattr(s, name) for s in shards])
        for _ in range(rounds):
            to, last = back[rows], symbols[rows]
            on = to >= 0
            to, last, block = to[on], last[on], block[on]
            order = np.argsort(last, kind="stable")
            last, block, rows = last[order], block[order], to[order]
            edge = (last[1:] != last[:-1]) | (block[1:] != block[:-1])
            block = np.concatenate(([0], np.cumsum(edge, dtype=np.int32))).astype(np.int32)[: len(rows)]
    return rows, block


def first_strings(contents: list[bytes], names: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Resolver: of every window, the first content that has it, by the intervals of the merged transforms.

    A content that is alone under its name shares no window with another, and needs no merging.
    """
    sizes = np.array([len(c) for c in contents])
    count = sizes - length + 1
    src = np.repeat(np.arange(len(contents)), count)
    _, inverse, held = np.unique(names, return_inverse=True, return_counts=True)
    some = np.flatnonzero(held[inverse] > 1)
    if len(some):
        src[(held[inverse] > 1)[src]] = some[_merged([contents[i] for i in some], length)]
    return count, src, np.zeros(len(src), np.int64)


def _merged(contents: list[bytes], length: int) -> np.ndarray:
    """Index of the first content with each window of ``contents``."""
    sizes = np.array([len(c) for c in contents])
    flat = np.frombuffer(b"\0".join([*contents, b""]), np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    inner = np.ones(len(flat), bool)
    inner[ends] = False
    used = np.flatnonzero(np.bincount(flat[inner], minlength=256))
    dense = np.zeros(256, np.uint8 if len(used) < 256 else np.uint16)
    dense[used] = np.arange(1, len(used) + 1)
    text = dense[flat]
    text[ends] = 0
    cuts = np.searchsorted(ends, np.linspace(0, len(flat), min(SHARDS, len(contents)) + 1)[1:-1])
    shards, place, done = [], [], 0
    for part in np.split(np.arange(len(contents)), np.unique(cuts)):
        if len(part):
            stop = ends[part[-1]] + 1
            shards.append(transform(text[done:stop], ends[part] - done))
            place.append(shards[-1].places + done)
            done = stop
    rows, block = interleave(shards, length)
    places = np.concatenate(place)[rows]
    owner = np.repeat(np.arange(len(contents)), sizes + 1)
    starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    least = np.minimum.reduceat(owner[places], starts)
    first = np.empty(len(flat), np.int64)
    first[places] = np.repeat(least, np.diff(np.append(starts, len(block))))
    count = sizes - length + 1
    window = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(ends - sizes, count)
    return first[window]


def byte_dedup(docs: DataFrame, length: int = LENGTH, text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; with ``text``, the bytes left.

    A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller doc_id.
    Null ids come after all others and are no smaller than each other, like rows of one id. Null,
    empty and shorter texts lose nothing. No string spans two texts.
    """
    windows = repeats.Windows(length, min(ANCHOR, length), words=False, within=False)
    rows = repeats.keyed(docs)
    spans = repeats.repeated_spans(rows, windows, first_strings, LOT_BYTES)
    return repeats.finished(rows, spans, words=False, text=text).withColumnRenamed("n", "n_bytes")


def op9_byte_dedup(spark, sf_dir):
    return byte_dedup(table(spark, sf_dir, "documents"))
