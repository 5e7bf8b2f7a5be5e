"""Operator 2: benchmark decontamination by templates of typed placeholders."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from stitchrank.llm.common import BASE, SPACES, mix, rolling, table, written
from stitchrank.llm.repeats import FILTER_BITS, key_filter

WINDOW = 8
# Share of an item's words that consistent windows must cover.
COVER = 0.5
# Share of the covered words that must agree as they are, not as a placeholder of another value; less says too little.
LITERAL = 0.25
# Bytes of text that are cut into words at a time.
BLOCK_BYTES = 4 << 20

# Measures that count as a unit behind a number.
UNITS = [
    "%", "percent", "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "ft", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "gram", "grams", "ton", "tons", "ounce", "ounces", "pound", "pounds", "lb", "lbs", "ml", "l",
    "liter", "liters", "litre", "litres", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days",
    "week", "weeks", "month", "months", "year", "years", "cent", "cents", "dollar", "dollars", "euro", "euros",
    "degree", "degrees", "volt", "volts", "watt", "watts", "joule", "joules", "newton", "newtons", "mph", "kmh",
]

NUMBER, NAME, UNIT = (xxhash.xxh64_intdigest(x) & ~15 for x in (b"<number>", b"<name>", b"<unit>"))
IS_NUMBER, IS_CAPITAL, ENDS, IS_UNIT = 1, 2, 4, 8
_EDGES = re.compile(r"^[^\w%]+|[^\w%]+$")
_UNITS = frozenset(UNITS)


class Kinds(dict):
    """word -> hash of its bare lower-cased form, with what kind of word it is in the lowest four bits."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        text = word.decode("utf-8", "replace")
        bare = _EDGES.sub("", text)
        flags = IS_NUMBER * any(c.isdigit() for c in bare) + ENDS * (text.rstrip("\"')]")[-1:] in (".", "!", "?", ":"))
        flags += IS_CAPITAL * (len(bare) > 1 and bare[0].isupper() and bare[1:].islower()) + IS_UNIT * (bare.lower() in _UNITS)
        value = self[word] = xxhash.xxh64_intdigest(bare.lower().encode()) & ~15 | flags
        return value


def readings(codes: np.ndarray, begins: np.ndarray, follows: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The symbols and placeholders of two readings of words: with names (capitalised words within a sentence), and without.

    Numbers are placeholders in both, and units behind a number. The second has no regard for case: what is copied word
    for word agrees in it wherever it stands and however it is written. ``begins`` marks the first word of a sentence,
    ``follows`` a word that has one before it in its text.
    """
    flags = codes & np.uint64(15)
    has = lambda bit: (flags & np.uint64(bit)) > 0
    number, plain = has(IS_NUMBER), codes & ~np.uint64(15)
    behind = np.concatenate(([False], number[:-1]))[: len(codes)] & follows
    name = has(IS_CAPITAL) & ~begins & ~number
    out = []
    for named in (name, np.zeros(len(codes), bool)):
        unit = has(IS_UNIT) & behind & ~number & ~named
        symbols = np.where(number, np.uint64(NUMBER), np.where(named, np.uint64(NAME), np.where(unit, np.uint64(UNIT), plain)))
        out.append((symbols, number | named | unit))
    return out[0], out[1]


def template(words: list[bytes], kinds: Kinds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, which are placeholders, plain words): numbers, capitalised words within a sentence, and units behind a number."""
    codes = np.fromiter(map(kinds.__getitem__, words), np.uint64, len(words))
    begins = np.concatenate(([True], (codes[:-1] & np.uint64(ENDS)) > 0))[: len(words)]
    (symbols, slots), _ = readings(codes, begins, np.arange(len(words)) > 0)
    return symbols, slots, codes & ~np.uint64(15)


def windows(symbols: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` symbols."""
    if len(symbols) < size or not size:
        return np.empty(0, np.int64)
    return mix(rolling(symbols, size) + np.uint64(size * BASE & (1 << 64) - 1)).view(np.int64)


def _slot_values(words: list[bytes], slots: np.ndarray) -> str:
    """What stands in the placeholders of a window, in order."""
    return "\x1f".join(_EDGES.sub("", words[i].decode("utf-8", "replace")).lower() for i in np.flatnonzero(slots))


# Blocks of texts: words are hashed by numpy, and only distinct ones are looked at one by one.

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES.encode())] = True
_BYTE = np.random.Generator(np.random.Philox(11)).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


class Blocks:
    """Words of blocks of texts: (text number, start, end, code) of every word, for one task."""

    def __init__(self) -> None:
        self.kinds, self.known, self.powers = Kinds(), {}, np.ones(1, np.uint64)

    def _power(self, n: int) -> np.ndarray:
        if len(self.powers) < n:
            self.powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * n, BASE, np.uint64))), dtype=np.uint64)
        return self.powers

    def words(self, texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, text, start, end, code); words do not cross texts, and a null text has none."""
        texts = texts.fill_null("").cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = memoryview(texts.buffers()[2] or b"")[ends[0] : ends[-1]]
        ends, data = ends - ends[0], np.frombuffer(raw, np.uint8)
        filled = ~_IS_SPACE[data]
        first = np.zeros(len(data) + 1, bool)
        first[ends] = True  # a text begins, and the one before ends
        before, after = np.concatenate(([False], filled[:-1]))[: len(data)], np.concatenate((filled[1:], [False]))[: len(data)]
        start = np.flatnonzero(filled & (~before | first[:-1]))
        end = np.flatnonzero(filled & (~after | first[1:])) + 1
        text = np.searchsorted(ends, start, "right") - 1
        if not len(start):
            return bytes(raw), text, start, end, np.empty(0, np.uint64)
        # Polynomial hash of each word's bytes.
        size = end - start
        held = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(held, size)
        hashes = mix(np.add.reduceat(_BYTE[data[filled]] * self._power(int(size.max()))[place], held))
        number, kinds = pd.factorize(hashes)
        at = np.empty(len(kinds), np.int64)
        at[number[::-1]] = np.arange(len(number))[::-1]
        if len(self.known) > 1_000_000:
            self.known.clear()
        codes = np.empty(len(kinds), np.uint64)
        for i, h in enumerate(kinds.tolist()):
            code = self.known.get(h)
            if code is None:
                code = self.known[h] = self.kinds[bytes(raw[start[at[i]] : end[at[i]]])]
            codes[i] = code
        return bytes(raw), text, start, end, codes[number]


def cut_blocks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(number of the first text, texts) of about ``BLOCK_BYTES`` each; a longer text is a block of its own."""
    sizes = np.cumsum(np.array(pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), np.int64))
    start = 0
    while start < len(texts):
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + BLOCK_BYTES, "right")))
        yield start, texts.slice(start, stop - start)
        start = stop


Found = list[tuple[int, int, int, int, str, list[int], int]]


def found_windows(texts: pa.Array, sizes: Iterable[int] | None, blocks: Blocks, bitmap: np.ndarray | None, size: int) -> Found:
    """(text, place, words of the window, hash, slot values, places of the slots, words of the text) of the windows of a block, in every reading.

    Of a document the windows of all ``sizes`` that pass the filter ``bitmap``. Of an item (no ``sizes``) all windows of
    ``size`` words, or the item as one window if it is shorter; its first word, which begins no sentence where the item is
    quoted behind a line without a full stop, is read in both ways.
    """
    raw, text, start, end, codes = blocks.words(texts)
    n, out = len(codes), []
    if not n:
        return out
    follows = np.concatenate(([False], text[1:] == text[:-1]))
    begins = ~follows | np.concatenate(([False], (codes[:-1] & np.uint64(ENDS)) > 0))
    named, cased = readings(codes, begins, follows)
    ways = [(*named, None), (*cased, None)]
    if sizes is None:
        # Only windows that start with the first word differ.
        ways.append((*readings(codes, begins & follows, follows)[0], ~follows))
    length = np.bincount(text, minlength=len(texts))
    for wide in sorted(sizes) if sizes is not None else sorted({min(size, x) for x in length.tolist() if x}):
        if n < wide:
            continue
        inside = text[: n - wide + 1] == text[wide - 1 :]
        if sizes is None:
            inside &= np.minimum(length[text[: n - wide + 1]], size) == wide
        for way, (symbols, slots, only) in enumerate(ways):
            hashes = windows(symbols, wide)
            hit = inside if only is None else inside & only[: n - wide + 1]
            if way != 1:
                # Where no name is read, the reading without names says the same.
                differs = np.cumsum(np.concatenate(([0], symbols != cased[0])))
                hit = hit & (differs[wide:] > differs[:-wide])
            if way == 2:
                same = np.cumsum(np.concatenate(([0], symbols != named[0])))
                hit = hit & (same[wide:] > same[:-wide])
            places = np.flatnonzero(hit)
            if bitmap is not None:
                bit = hashes[places] % FILTER_BITS
                places = places[((bitmap[bit >> 6] >> (bit & 63)) & 1).astype(bool)]
            for at in places.tolist():
                words = [raw[a:b] for a, b in zip(start[at : at + wide].tolist(), end[at : at + wide].tolist())]
                held = slots[at : at + wide]
                out.append((int(text[at]), at, wide, int(hashes[at]), _slot_values(words, held), np.flatnonzero(held).tolist(), int(length[text[at]])))
    first = np.searchsorted(text, np.arange(len(texts)))
    return [(t, at - int(first[t]), *rest) for t, at, *rest in out]


def _window_rows(ids: list[str], names: list[str], sizes: list[int] | None, held, size: int):
    """Task that turns rows of ``ids`` and text into rows of ``ids`` and windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, bitmap = Blocks(), None if held is None else held.value
        for batch in batches:
            for first, texts in cut_blocks(batch.column("text")) if batch.num_rows else ():
                rows = found_windows(texts, sizes, blocks, bitmap, size)
                columns = list(zip(*rows, strict=True)) or [()] * 7
                which = pa.array([first + t for t in columns[0]], pa.int64())
                types = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(which) for c in ids] + [pa.array(c, t) for c, t in zip(columns[1:], types, strict=True)], names=ids + names
                )

    return cut


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, place, size, hash, values, slots, length): the windows of each item; a short item is one window of its own."""
    rows = items.select("item_id", "text")
    names = ["place", "size", "hash", "values", "slots", "length"]
    kinds = [IntegerType(), IntegerType(), LongType(), StringType(), ArrayType(IntegerType()), IntegerType()]
    schema = StructType([rows.schema["item_id"], *[StructField(n, k) for n, k in zip(names, kinds)]])
    return rows.mapInArrow(_window_rows(["item_id"], names, None, None, size), schema)


def _sound(lines: list[dict], length: int) -> tuple[int, int]:
    """(words covered by windows whose slots are consistent, words covered by all) of one instance of an item.

    A slot value of the item must stand for one value of the instance throughout: the one it meets most. Windows of
    nothing but placeholders count where those beside them agree: of all words so covered, ``LITERAL`` must be plain words or
    the same values, else none counts, and a table of numbers is no copy of another.
    """
    votes: dict[str, Counter] = defaultdict(Counter)
    pairs = [list(zip(x["values"].split("\x1f"), x["doc_values"].split("\x1f"), strict=False)) if x["values"] else [] for x in lines]
    for pair in pairs:
        for own, other in set(pair):
            votes[own][other] += 1
    best = {own: min(c, key=lambda v: (-c[v], v)) for own, c in votes.items()}
    every, sound, other_value = (np.zeros(length, bool) for _ in range(3))
    for x, pair in zip(lines, pairs, strict=True):
        span = slice(x["place"], x["place"] + x["size"])
        every[span] = True
        if all(best[own] == other for own, other in pair):
            sound[span] = True
            for at, (own, other) in zip(x["slots"], pair, strict=True):
                other_value[x["place"] + at] |= own != other
    covered = int(sound.sum())
    agreeing = covered - int((sound & other_value).sum())
    return (covered if agreeing >= LITERAL * covered else 0), int(every.sum())


def best_instance(lines: list[dict]) -> tuple[int, int]:
    """The better of an instance with words put in or left out (all lines), and one word for word (one diagonal)."""
    length, diagonals = lines[0]["length"], defaultdict(list)
    for x in lines:
        diagonals[x["diagonal"]].append(x)
    groups = list(diagonals.values()) + ([lines] if len(diagonals) > 1 else [])
    return max(_sound(g, length) for g in groups)


def row_digest() -> Column:
    """A 128-bit key of a row by id, of any type, and text."""
    parts = [F.coalesce(F.concat(F.lit(mark), F.col(c).cast("string")), F.lit("-")) for c, mark in (("doc_id", "i"), ("text", "t"))]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, cover: float = COVER) -> DataFrame:
    """(doc_id, rid, item_id, item_words, covered, consistent, score) of every document and item that it contains.

    Windows of templates meet by hash. Only windows that pass a filter of a fixed size leave their task; the
    join decides. A match of a document's place and an item's place lies on a diagonal (their difference); matches on
    near diagonals, within a quarter of the item, are one instance, so that several variants in one document are judged
    apart. An item is contained if the windows of its best instance whose slots are consistent cover ``cover`` of its
    words: a question asked again with other numbers, names or units is found, and a text with the same phrase about
    unlike things is not. An instance has at most length x width matches of a window, whatever the document.
    Null and empty texts and items match nothing; rows equal in id and text are reported once, ids may be of any type,
    and a null doc_id is reported as null.
    """
    spark = docs.sparkSession
    wanted = written(item_windows(items, size))
    # Lengths of short items: at most ``size`` numbers.
    sizes = sorted(r["size"] for r in wanted.select("size").distinct().collect())
    held = spark.sparkContext.broadcast(key_filter(wanted.select(F.col("hash").alias("rid"))))
    rows = docs.select("doc_id", row_digest().alias("rid"), "text")
    names = ["at", "wide", "hash", "doc_values", "doc_slots", "words"]
    kinds = [IntegerType(), IntegerType(), LongType(), StringType(), ArrayType(IntegerType()), IntegerType()]
    schema = StructType([rows.schema["doc_id"], rows.schema["rid"], *[StructField(n, k) for n, k in zip(names, kinds)]])
    hits = rows.mapInArrow(_window_rows(["doc_id", "rid"], names, sizes, held, size), schema).drop("words", "doc_slots")
    width = F.greatest(F.lit(1), F.floor(F.col("length") / 4))
    # Two sets of bands, half a width apart: near diagonals share a band of one of them.
    bands = F.array(*[F.struct(F.lit(i).alias("set"), F.floor((F.col("diagonal") + F.floor(width * i / 2)) / width).alias("band")) for i in (0, 1)])
    met = hits.join(wanted, "hash").where("size = wide").withColumn("diagonal", F.col("at") - F.col("place"))
    lines = met.withColumn("in", F.explode(bands)).groupBy("rid", "item_id", "in").agg(
        F.any_value("doc_id").alias("doc_id"), F.collect_set(F.struct("length", "size", "place", "diagonal", "values", "slots", "doc_values")).alias("lines")
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("lines").to_pylist()
            best = [best_instance(x) for x in lists]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "rid", "item_id")] + [pa.array([list(b) for b in best], pa.list_(pa.int32())), pa.array([x[0]["length"] for x in lists], pa.int32())],
                names=["doc_id", "rid", "item_id", "best", "item_words"],
            )

    kept = lines.select("doc_id", "rid", "item_id", "lines")
    schema = StructType([*kept.schema.fields[:3], StructField("best", ArrayType(IntegerType())), StructField("item_words", IntegerType())])
    judged = kept.mapInArrow(judge, schema).groupBy("rid", "item_id").agg(
        F.any_value("doc_id").alias("doc_id"), F.any_value("item_words").alias("item_words"), F.max("best").alias("best")
    )
    consistent = F.col("best")[0]
    return judged.select(
        "doc_id", "rid", "item_id", "item_words", F.col("best")[1].alias("covered"), consistent.alias("consistent"), (consistent / F.col("item_words")).alias("score")
    ).where(F.col("score") >= cover)


def clean(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """``docs`` without the rows that contain an item; the columns are unchanged."""
    gone = contaminated(docs, items, **settings).select(F.col("rid").alias("_gone")).distinct()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_digest().alias("_rid"))
    return keyed.join(gone, F.col("_rid") == F.col("_gone"), "left_anti").select("row.*")


def op2_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("rid")
