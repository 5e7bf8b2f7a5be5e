"""What the two substring operators share: finding and routing the windows that may repeat.

A window is ``length`` consecutive symbols (bytes or words). Each window is named by its smallest
``anchor``-symbol hash, so equal windows have equal names, and consecutive windows of one name form a run.

1. :func:`shared_names`: which names occur in more than one place (all windows of all texts count).
2. :func:`repeated_spans`: texts with such names send the runs to the task of the name, where the
   operator's own resolver decides, per window, where its content occurs first.
3. :func:`finished`: the covered symbols are taken out of the texts.

Tasks combine before each shuffle: within a block of rows a name, or a run's content, is sent once,
however many rows hold it. Names that a noticeable part of all rows hold are split further, by the
whole window. All results are exact; names only route.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stitchrank.llm.common import NULL_ID, WordHashes, mix, partitions, rolling, row_key, sliding_min, word_hashes, written

LOW = np.uint64((1 << 40) - 1)
BLOCK_NAMES = 1_500_000
BLOCK_BYTES = 12_000_000
# Windows of a very long text that are looked at in one go.
STRETCH = 1 << 20
# A name held by more rows than a part has on average, and by this many, is split by whole windows.
# At most (parts) times (mean names of a row) names can be that frequent.
HOT_LEAST = 1000
FILTER_BITS = 1 << 26


@dataclass(frozen=True)
class Windows:
    length: int
    anchor: int
    words: bool
    # True: an equal window earlier in the same text counts; False: only one in a text with a smaller id.
    within: bool

    def symbols(self, text: str | None, known: WordHashes):
        """(hashable symbols, raw): raw is the bytes of the text, or its words."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not self.words:
            return np.frombuffer(raw, np.uint8), raw
        raw = raw.split()
        return word_hashes(raw, known), raw

    def names(self, symbols: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first window, hash of each anchor, smallest hash in each window) per stretch of windows."""
        count = len(symbols) - self.length + 1
        for at in range(0, count, STRETCH):
            part = symbols[at : min(at + STRETCH, count) + self.length - 1].astype(np.uint64)
            hashes = mix(rolling(part, self.anchor))
            yield at, hashes, sliding_min(hashes, self.length - self.anchor + 1)

    def occurrences(self, symbols: np.ndarray) -> np.ndarray:
        """Names of a text: one per run, or one per chosen place if places in one text count."""
        found = [np.empty(0, np.uint64)]
        width = self.length - self.anchor
        for _, hashes, least in self.names(symbols):
            if self.within:
                pad = np.full(width, ~np.uint64(0))
                largest = ~sliding_min(np.concatenate((pad, ~least, pad)), width + 1)
                found.append(hashes[hashes == largest])
            else:
                found.append(least[np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))])
        return mix(np.concatenate(found))

    def cut(self, raw, start: int, end: int) -> bytes:
        return b" ".join(raw[start:end]) if self.words else raw[start:end]


def _part(hashes: np.ndarray, n: int) -> np.ndarray:
    """Ascending in the hash, so sorted hashes fall into contiguous parts."""
    return ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _grouped(keys: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """(key, values ...) for each distinct key."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    ends = np.append(starts[1:], len(keys))
    values = [v[order] for v in values]
    for a, b in zip(starts, ends, strict=True):
        yield (int(keys[a]), *[v[a:b] for v in values])


_NAMES = pa.schema([("part", pa.int32()), ("rids", pa.binary()), ("counts", pa.binary()), ("names", pa.binary()), ("facts", pa.binary()), ("known", pa.bool_())])
_NAMES_SQL = "part int, rids binary, counts binary, names binary, facts binary, known boolean"


def _narrow(names: np.ndarray) -> bytes:
    """40 bits of each name, as a plane of 32 and one of 8."""
    return (names & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + ((names >> np.uint64(32)) & np.uint64(255)).astype(np.uint8).tobytes()


def _wide(data: bytes) -> np.ndarray:
    n = len(data) // 5
    return np.frombuffer(data, "<u4", n).astype(np.uint64) | (np.frombuffer(data, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32))


def _send_names(n: int, make: Callable[[str | None], tuple[np.ndarray, int | None]], within: bool):
    """Task that sends the names of its rows, each once per block, to the parts of the names."""

    def flush(names: list, rids: list, facts: list, block: int) -> Iterator[dict]:
        # Rows of one rid are one row.
        ids, number = np.unique(np.array(rids, np.int64), return_inverse=True)
        h, r = np.concatenate(names), np.repeat(number.astype(np.int32), [len(x) for x in names])
        order = np.argsort(h)
        h, r = h[order], r[order]
        if facts and facts[0] is not None:
            of = np.empty(len(ids), np.int64)
            of[number] = facts
            yield {"part": block % n, "rids": ids.tobytes(), "facts": of.tobytes()}
        if not len(h):
            return
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        counts = np.diff(np.append(starts, len(h)))
        shared = counts > 1 if within else np.minimum.reduceat(r, starts) != np.maximum.reduceat(r, starts)
        # Names that the block itself shares: its rows know already.
        mine = np.repeat(shared, counts)
        if mine.any():
            rows, found = r[mine], h[mine]
            order = np.argsort(rows, kind="stable")
            rows, found = rows[order], found[order]
            unique, sizes = np.unique(rows, return_counts=True)
            yield {"part": block % n, "rids": ids[unique].tobytes(), "counts": sizes.astype("<u4").tobytes(), "names": _narrow(found), "known": True}
        head, owner = h[starts], np.where(shared, -1, r[starts])
        edges = np.searchsorted(_part(head, n), np.arange(n + 1))
        for p in np.flatnonzero(np.diff(edges)):
            at = slice(edges[p], edges[p + 1])
            rows, found, held = owner[at], head[at], counts[at]
            order = np.argsort(rows, kind="stable")
            rows, found, held = rows[order], found[order], held[order]
            unique, sizes = np.unique(rows, return_counts=True)
            several = rows < 0
            # Row -1 stands for "several rows of the block"; the counts of its names follow the sizes.
            owners = np.where(unique < 0, np.int64(0), ids[unique])
            tail = np.concatenate(([np.uint32(several.sum())], sizes.astype(np.uint32), held[several].astype(np.uint32)))
            yield {"part": int(p), "rids": owners.tobytes(), "counts": tail.astype("<u4").tobytes(), "names": _narrow(found), "known": False}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rids, facts, held, block = [], [], [], 0, TaskContext.get().partitionId() % n
        for batch in batches:
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found, fact = make(text)
                names.append(found)
                rids.append(rid)
                facts.append(fact)
                held += len(found)
                if held >= BLOCK_NAMES:
                    yield pa.RecordBatch.from_pylist(list(flush(names, rids, facts, block)), schema=_NAMES)
                    names, rids, facts, held, block = [], [], [], 0, block + 1
        if names:
            yield pa.RecordBatch.from_pylist(list(flush(names, rids, facts, block)), schema=_NAMES)

    return send


def _meet_names(n: int, hot: int, within: bool):
    """Task that finds the shared among the names of its part and sends them to the parts of their rids, one row for each part."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, owners, held, known = [], [], [], []
        for batch in batches:
            for _, rids, counts, data, facts, local in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rids = np.frombuffer(rids, "<i8")
                if facts is not None:
                    for part, own, mine in _grouped(_part(mix(rids.view(np.uint64)), n), rids, np.frombuffer(facts, "<i8")):
                        yield pa.RecordBatch.from_pylist([{"part": part, "rids": own.tobytes(), "facts": mine.tobytes()}], schema=_FOUND)
                    continue
                counts, found = np.frombuffer(counts, "<u4").astype(np.int64), _wide(data)
                if local:
                    known.append((np.repeat(rids, counts), found))
                    continue
                several, sizes, more = int(counts[0]), counts[1 : 1 + len(rids)], counts[1 + len(rids) :]
                names.append(found)
                owners.append(np.repeat(rids, sizes))
                mine = np.ones(len(found), np.int32)
                mine[:several] = more
                held.append(mine)
        if names:
            h = np.concatenate(names)
            names.clear()
            order = np.argsort(h)
            h, r, c = h[order], np.concatenate(owners)[order], np.concatenate(held)[order]
            owners.clear()
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            total = np.add.reduceat(c, starts)
            size = np.diff(np.append(starts, len(h)))
            several = np.maximum.reduceat(c, starts) > 1
            shared = several | (size > 1 if within else np.minimum.reduceat(r, starts) != np.maximum.reduceat(r, starts))
            if (total >= hot).any():
                yield pa.RecordBatch.from_pylist([{"part": 0, "names": _narrow(h[starts[total >= hot]])}], schema=_FOUND)
            # Rows known to their block have no owner here; a name of one block's several rows is theirs alone.
            shared = np.repeat(shared, size) & (c == 1)
            known.append((r[shared], h[shared]))
        if known:
            rid, found = (np.concatenate(x) for x in zip(*known, strict=True))
            for part, own, mine in _grouped(_part(mix(rid.view(np.uint64)), n), rid, found):
                yield pa.RecordBatch.from_pylist([{"part": part, "rids": own.tobytes(), "names": _narrow(mine)}], schema=_FOUND)

    return meet


_FOUND = pa.schema([("part", pa.int32()), ("rids", pa.binary()), ("names", pa.binary()), ("facts", pa.binary())])


def _gather_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (rid, names, fact) for each text that shares names or has a fact; hot names come under no rid."""
    rids, names, out, facts = [], [], [], {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["rids"] is None:
                out.append((None, row["names"], None))
            elif row["facts"] is not None:
                facts.update(zip(np.frombuffer(row["rids"], "<i8").tolist(), np.frombuffer(row["facts"], "<i8").tolist(), strict=True))
            else:
                rids.append(np.frombuffer(row["rids"], "<i8"))
                names.append(_wide(row["names"]))

    def lines():
        yield from out
        if rids:
            for rid, found in _grouped(np.concatenate(rids), np.concatenate(names)):
                yield rid, _narrow(found), facts.pop(rid, None)
        for rid, fact in facts.items():
            yield rid, None, fact

    grouped = lines()
    while rows := list(itertools.islice(grouped, 5000)):
        columns = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["rid", "names", "fact"])


def shared_names(rows: DataFrame, make: Callable[[str | None], tuple[np.ndarray, int | None]], within: bool, hot: int) -> DataFrame:
    """(rid, names, fact): for each row of (rid, text) a blob of those of its names that occur in several rows; hot names have no rid.

    ``make`` gives the 64-bit names of a text and a number to be kept of it, or None throughout; with
    numbers every rid has a row, its names null if it shares none. With ``within``, two places in one row count as several.
    """
    n = partitions(rows.sparkSession)
    sent = rows.select("rid", "text").mapInArrow(_send_names(n, make, within), _NAMES_SQL)
    met = sent.repartitionById(n, F.col("part")).mapInArrow(_meet_names(n, hot, within), "part int, rids binary, names binary, facts binary")
    return written(met.repartitionById(n, F.col("part")).mapInArrow(_gather_names, "rid long, names binary, fact long"))


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS bits with the bit of each ``rid`` set: at most FILTER_BITS / 64 rows reach the driver."""
    lines = keys.select(F.pmod(F.col("rid"), F.lit(FILTER_BITS)).alias("bit"))
    lines = lines.select(F.expr("shiftright(bit, 6) as word"), F.expr("shiftleft(1L, cast(bit % 64 as int)) as bits"))
    found = lines.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bitmap


def maybe(docs: DataFrame, bitmap: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a key of the filter, rows that certainly have none), so that only the first are shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def hit(rid):
        bit = rid.to_numpy() % FILTER_BITS
        return pd.Series(((held.value[bit >> 6] >> (bit & 63)) & 1).astype(bool))

    flagged = docs.withColumn("_hit", hit("rid"))
    return flagged.where("_hit").drop("_hit"), flagged.where("not _hit").drop("_hit")


_RUNS = pa.schema([("part", pa.int32()), ("rids", pa.binary()), ("docs", pa.binary()), ("rows", pa.binary()), ("starts", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary()), ("content", pa.binary()), ("known", pa.bool_())])
_RUNS_SQL = "part int, rids binary, docs binary, rows binary, starts binary, sizes binary, keys binary, content binary, known boolean"


def _send_runs(n: int, windows: Windows, hot: np.ndarray):
    """Task that sends the runs of shared names; of equal contents in a block only the first occurrence."""

    def flush(contents: list, texts: list, parts: list, block: int) -> Iterator[dict]:
        row, start, count, key = (np.concatenate([p[i] for p in parts]) for i in range(4))
        rids, docs = np.array([t[0] for t in texts], np.int64), np.array([t[1] for t in texts], np.int64)
        code = np.fromiter(map(xxhash.xxh64_intdigest, contents), np.uint64, len(contents))
        size = np.fromiter(map(len, contents), np.int64, len(contents))
        key = np.where(key == 0, code, key)  # a window by itself goes by its content
        doc = docs[row]
        order = np.lexsort((start, doc, code))
        first = np.flatnonzero(np.concatenate(([True], code[order][1:] != code[order][:-1])))
        owner = order[np.repeat(first, np.diff(np.append(first, len(order))))]
        # Rows of one rid come several times with the same places; they stay together.
        open_ = doc[order] == doc[owner]
        if windows.within:
            open_ &= start[order] == start[owner]
        closed, rest = order[~open_], order[open_]

        def line(part: int, at: np.ndarray, **more) -> dict:
            own, number = np.unique(row[at], return_inverse=True)
            return {"part": part, "rids": rids[own].tobytes(), "docs": docs[own].tobytes(), "rows": number.astype("<u4").tobytes(), "starts": start[at].astype("<u4").tobytes()} | more

        if len(closed):
            yield line(block % n, closed, sizes=(count[closed] + windows.length - 1).astype("<u4").tobytes(), known=True)
        for p, at in _grouped(_part(key[rest], n), rest):
            at = np.sort(at)
            yield line(
                p, at, sizes=size[at].astype("<u4").tobytes(), keys=(key[at] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(),
                content=b"".join([contents[i] for i in at.tolist()]), known=False,
            )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block = WordHashes(), TaskContext.get().partitionId() % n
        contents, texts, parts, held = [], [], [], 0

        def add(raw, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> int:
            found = [windows.cut(raw, s, e) for s, e in zip(starts.tolist(), (ends + windows.length - 1).tolist(), strict=True)]
            contents.extend(found)
            parts.append((np.full(len(starts), len(texts) - 1), starts, ends - starts, keys))
            return sum(map(len, found))

        for batch in batches:
            for rid, doc, text, marks in zip(*[batch.column(c).to_pylist() for c in ("rid", "doc", "text", "marks")], strict=True):
                symbols, raw = windows.symbols(text, known)
                wanted = np.unique(_wide(marks))
                texts.append((rid, doc))
                for at, _, least in windows.names(symbols):
                    starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
                    ends = np.append(starts[1:], len(least))
                    names = mix(least[starts])
                    keep = np.isin(names & LOW, wanted)
                    split = np.isin(names & LOW, hot) & keep if len(hot) else np.zeros(len(keep), bool)
                    keep &= ~split
                    held += add(raw, starts[keep] + at, ends[keep] + at, names[keep] | np.uint64(1))
                    for s, e in zip(starts[split] + at, ends[split] + at, strict=True):
                        held += add(raw, np.arange(s, e), np.arange(s, e) + 1, np.zeros(e - s, np.uint64))
                if held >= BLOCK_BYTES:
                    yield pa.RecordBatch.from_pylist(list(flush(contents, texts, parts, block)), schema=_RUNS)
                    contents, texts, parts, held, block = [], [], [], 0, block + 1
        if contents:
            yield pa.RecordBatch.from_pylist(list(flush(contents, texts, parts, block)), schema=_RUNS)

    return send


# (contents in the order of their first (doc, start), the name each was sent under, window length) -> the number of
# windows of each content; and for all windows of all contents, in order, the index of the content, and the
# offset in it, where the window occurs first. Contents under different names share no window.
Resolver = Callable[[list[bytes], np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _removed(windows: Windows, resolve: Resolver, contents: list[bytes], which: np.ndarray, key: np.ndarray, rid: np.ndarray, doc: np.ndarray, start: np.ndarray):
    """(rid, start, end) of the symbols that the given occurrences of contents lose. Occurrences are in (doc, start) order."""
    _, first = np.unique(which, return_index=True)
    count, src, offset = resolve(contents, key[first], windows.length)
    base = np.cumsum(count) - count
    size = count[which]
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)  # window of the occurrence
    flat = np.repeat(base[which], size) + at
    head = first[src[flat]]  # the first occurrence of the content where the window is first
    own_doc = np.repeat(doc, size)
    gone = doc[head] < own_doc
    if windows.within:
        gone |= (doc[head] == own_doc) & (start[head] + offset[flat] < np.repeat(start, size) + at)
    # Runs of lost windows, cut where an occurrence ends.
    owner = np.repeat(np.arange(len(which)), size)
    lost = np.flatnonzero(gone)
    if not len(lost):
        return None
    breaks = np.flatnonzero((np.diff(lost) != 1) | (np.diff(owner[lost]) != 0))
    a, b = lost[np.concatenate(([0], breaks + 1))], lost[np.concatenate((breaks, [len(lost) - 1]))]
    return rid[owner[a]], start[owner[a]] + at[a], start[owner[a]] + at[b] + windows.length


def _meet_runs(n: int, windows: Windows, resolve: Resolver, most: int):
    """Task that lets ``resolve`` decide on the contents of its part, in lots of about ``most`` bytes.

    It sends the spans that texts lose to the parts of their rids, one row for each part.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ("rid", "doc", "start", "size", "key")
        held: dict[str, list] = {c: [] for c in fields}
        blobs, spans = [], []
        for batch in batches:
            for row in batch.to_pylist():
                number = np.frombuffer(row["rows"], "<u4")
                rid, start = np.frombuffer(row["rids"], "<i8")[number], np.frombuffer(row["starts"], "<u4").astype(np.int64)
                size = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
                if row["known"]:
                    spans.append((rid, start, start + size))
                    continue
                doc, key = np.frombuffer(row["docs"], "<i8")[number], np.frombuffer(row["keys"], "<u4")
                for c, values in zip(fields, (rid, doc, start, size, key), strict=True):
                    held[c].append(values)
                blobs.append(row["content"])
        if blobs:
            rid, doc, start, size, key = (np.concatenate(held[c]) for c in fields)
            ends = np.cumsum(size)
            blob = b"".join(blobs)
            blobs.clear()
            held.clear()
            lots = len(blob) // most + 1
            lot = (mix(key.astype(np.uint64)) % np.uint64(lots)).astype(np.int64)
            for _, at in _grouped(lot, np.arange(len(lot))):
                at = at[np.lexsort((start[at], doc[at]))]
                places: dict[bytes, int] = {}
                which = [places.setdefault(blob[e - n : e], len(places)) for e, n in zip(ends[at].tolist(), size[at].tolist(), strict=True)]
                found = _removed(windows, resolve, list(places), np.array(which), key[at], rid[at], doc[at], start[at])
                if found:
                    spans.append(found)
        if spans:
            rid, start, end = (np.concatenate(x) for x in zip(*spans, strict=True))
            for part, *columns in _grouped(_part(mix(rid.view(np.uint64)), n), rid, start, end):
                data = [columns[0].tobytes(), *[c.astype("<u4").tobytes() for c in columns[1:]]]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array([d], pa.binary()) for d in data]], names=["part", "rids", "starts", "ends"])

    return meet


def _gather_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (rid, spans) for each text; its spans are joined where they overlap or touch."""
    held = [(np.frombuffer(r["rids"], "<i8"), np.frombuffer(r["starts"], "<u4").astype(np.int64), np.frombuffer(r["ends"], "<u4").astype(np.int64)) for b in batches for r in b.to_pylist()]
    if not held:
        return
    rid, start, end = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    order = np.lexsort((start, rid))
    rid, start, end = rid[order], start[order], end[order]
    grouped = _grouped(rid, start, end)
    while rows := list(itertools.islice(grouped, 5000)):
        out = []
        for _, a, b in rows:
            reach = np.maximum.accumulate(b)
            cut = np.flatnonzero(np.concatenate(([True], a[1:] > reach[:-1])))
            out.append(np.stack((a[cut], np.append(reach[cut[1:] - 1], reach[-1])), 1).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in rows], pa.int64()), pa.array(out, pa.binary())], names=["rid", "spans"])


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, doc, text) of every row; ``doc`` orders rows, a null id after all others."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select("doc_id", row_key().alias("rid"), F.coalesce(doc_id, F.lit(NULL_ID)).alias("doc"), "text")


def repeated_spans(docs: DataFrame, windows: Windows, resolve: Resolver, most: int) -> DataFrame:
    """(rid, spans): for every row of :func:`keyed` that loses symbols, a blob of (start, end) pairs.

    Spans are apart and in order. Rows equal in id and text share a rid and their spans.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    known = WordHashes()
    hot_from = max(HOT_LEAST, docs.count() // n)

    def make(text):
        symbols, _ = windows.symbols(text, known)
        return windows.occurrences(symbols), None

    marks = shared_names(docs, make, windows.within, hot_from)
    hot = [np.empty(0, np.uint64), *[_wide(r["names"]) for r in marks.where("rid is null").toLocalIterator()]]
    by_row = marks.where("rid is not null").select("rid", F.col("names").alias("marks"))
    candidates, _ = maybe(docs, key_filter(marks.where("rid is not null").select("rid")))
    # Blocks depend on the order of the rows, so a task that is run again must see the same (a sorted join has it already).
    rows = candidates.join(by_row, "rid").select("rid", "doc", "text", "marks").sortWithinPartitions("rid", "doc")
    sent = rows.mapInArrow(_send_runs(n, windows, np.concatenate(hot)), _RUNS_SQL)
    met = sent.repartitionById(n, F.col("part")).mapInArrow(_meet_runs(n, windows, resolve, most), "part int, rids binary, starts binary, ends binary")
    return written(met.repartitionById(n, F.col("part")).mapInArrow(_gather_spans, "rid long, spans binary"))


def finished(docs: DataFrame, spans: DataFrame, words: bool, text: bool = False) -> DataFrame:
    """(doc_id, n, n_removed, n_spans, kept_sha256) of every row of :func:`keyed`, and with ``text`` what is left of it.

    Words that are left are joined by one space. Bytes that are left may be no whole UTF-8; ``text`` is binary.
    """
    touched, rest = maybe(docs, key_filter(spans.select("rid")))
    rows = touched.join(spans, "rid", "left").select("doc_id", "text", "spans")
    rest = rest.select("doc_id", "text", F.lit(None).cast("binary").alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = (content or "").encode("utf-8", "surrogatepass")
                raw = raw.split() if words else raw
                n = len(raw)
                pairs = np.frombuffer(found or b"", "<i8").reshape(-1, 2).tolist()
                left, at = [], 0
                for start, end in [*pairs, (n, n)]:
                    left += raw[at:start] if words else [raw[at:start]]
                    at = end
                left = (b" " if words else b"").join(left)
                out.append((n, sum(e - s for s, e in pairs), len(pairs), hashlib.sha256(left).hexdigest(), left if text else None))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]],
                names=["doc_id", "n", "n_removed", "n_spans", "kept_sha256", "text"],
            )

    done = rows.unionByName(rest).withColumn("doc_id", F.col("doc_id").cast("long"))
    done = done.mapInArrow(finish, "doc_id long, n long, n_removed long, n_spans long, kept_sha256 string, text binary")
    return done if text else done.drop("text")
