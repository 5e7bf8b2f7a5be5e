"""Operator 6: exact Jaccard join of word n-gram sets by partitions of the universe."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stitchrank.llm.common import BASE, NULL_ID, WORD, WordHashes, mix, partitions, rolling, table, word_hashes, written
from stitchrank.llm.repeats import _wide, key_filter, maybe, shared_names

# Bits of a set's sketch: bit i is the parity of its members of hash i.
SKETCH = 2048
# Members of a signature that meet in one task; larger groups meet in pairs of blocks of this size.
BLOCK = 2048


def shingles(text: str | None, size: int, known: WordHashes) -> np.ndarray:
    """Distinct hashes of runs of ``size`` lower-cased words; of all words if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    found = rolling(word_hashes(words, known), min(size, len(words)))
    # Sets of short texts of different lengths have different members.
    return np.unique(mix(found + np.uint64(min(size, len(words)) * BASE & (1 << 64) - 1)))


class Scheme:
    """How sets of a size band are signed.

    Sizes fall into bands so wide that linked sets are in one band or in neighbouring ones. For a band, ``errors`` is the
    largest symmetric difference of linked sets of which the smaller is in the band. The universe
    is hashed into segments. If two linked sets agreed in no exact segment, each would hold an error; if in a segment
    with deletions neither agreed nor differed by one, it would hold two. With
    exact + 2 * deletion segments > errors that is too many, so linked sets share a signature.

    Weak segments, of one member or none, are alike by chance. A band has ``slack`` exact segments more, and a
    set with no more weak ones than that leaves them out: of a pair's equal segments only those weak in both are
    lost, and enough others remain. A set with more weak segments signs all. Where segments are so small that
    the slack would feed on itself, only empty ones count as weak.
    """

    def __init__(self, low: int, high: int, threshold: int, sets: int):
        self.low, self.high = low, high  # sizes low <= n < high
        most = high - 1
        rest = 100 - threshold
        self.errors = rest * (most + most * 100 // threshold) // (100 + threshold)
        self.deletions = min(self._choices(), key=lambda d: self._cost(d, sets))
        self.exact = max(0, self.errors + 1 - 2 * self.deletions)
        self.weak, self.slack = self._slack(self.exact, self.deletions)
        self.exact += self.slack
        self.segments = self.exact + self.deletions
        self.salt = mix((np.arange(self.segments, dtype=np.uint64) << np.uint64(32)) + np.uint64(low))

    def _slack(self, exact: int, deletions: int) -> tuple[int, int]:
        """(members below which a segment is weak, exact segments to add)."""
        for weak in (2, 1):
            slack = 0
            for _ in range(12):
                mean = self.low / (exact + slack + deletions)
                expected = (exact + slack) * math.exp(-mean) * (1 + mean * (weak - 1))
                slack = math.ceil(expected + 2 * math.sqrt(expected))
                if slack > exact / 4 + 1:
                    break
            else:
                return weak, slack
        return 0, 0

    def _choices(self) -> list[int]:
        top = (self.errors + 2) // 2
        return sorted({round(top * i / 16) for i in range(17)})

    def _cost(self, deletions: int, sets: int) -> float:
        """Signatures to send and pairs of unlike sets that meet by chance, where both segments are (nearly) empty."""
        exact = max(0, self.errors + 1 - 2 * deletions)
        weak, slack = self._slack(exact, deletions)
        mean = self.low / (exact + slack + deletions)
        empty = math.exp(-2 * mean)
        # With slack, empty segments are signed by the few sets with very many of them only.
        chance = exact * empty * (0.001 if weak else 1) + deletions * (1 + mean) ** 2 * empty
        return sets * (exact + slack + deletions * (1 + mean)) + sets * sets / 2 * chance

    def sign(self, members: np.ndarray) -> np.ndarray:
        spread = mix(members ^ np.uint64(self.low))
        segment = (((spread >> np.uint64(32)) * np.uint64(self.segments)) >> np.uint64(32)).astype(np.uint16 if self.segments < 1 << 16 else np.int64)
        order = np.argsort(segment, kind="stable")
        # Of the other bits than those that choose the segment.
        segment, spread = segment[order], (spread * np.uint64(BASE))[order]
        starts = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        keys = self.salt.copy()
        keys[segment[starts]] += np.add.reduceat(spread, starts)
        held = np.zeros(self.segments, np.int64)
        held[segment[starts]] = np.diff(np.append(starts, len(segment)))
        weak = held < self.weak
        weak[: self.deletions] = False
        use = keys[~weak] if weak.sum() <= self.slack else keys
        if self.deletions:
            some = segment < self.deletions
            use = np.concatenate((use, keys[segment[some]] - spread[some]))
        return mix(use)


class Schemes:
    """Bands of sizes from 1 up and the scheme of each; ``sets`` gives the number of sets in a band."""

    def __init__(self, threshold: int, sets: dict[int, int]):
        self.threshold, self.sets, self.bands, self.lows = threshold, sets, [], []
        self._grow(1)

    def _grow(self, n: int) -> None:
        low = self.bands[-1].high if self.bands else 1
        while low <= n:
            high = low * 100 // self.threshold + 1
            self.bands.append(Scheme(low, high, self.threshold, self.sets.get(len(self.bands), 1)))
            self.lows.append(low)
            low = high

    def band(self, n: int) -> int:
        self._grow(n)
        return int(np.searchsorted(self.lows, n, side="right")) - 1

    def signatures(self, members: np.ndarray) -> np.ndarray:
        """Of a set under its own band and, as the larger partner, under the one below."""
        if not len(members):
            return np.empty(0, np.uint64)
        at = self.band(len(members))
        return np.concatenate([self.bands[i].sign(members) for i in range(max(0, at - 1), at + 1)])


def sketch(members: np.ndarray) -> bytes:
    counts = np.bincount((mix(members) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
    return np.packbits(counts.astype(np.uint8) & 1).tobytes()


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_wide(x) for x in batch.column("names").to_pylist()]
        owner = np.repeat(batch.column("rid").to_numpy(), [len(x) for x in found])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *found]).astype(np.int64)), pa.array(owner)], names=["sig", "tid"])


def _close(sizes_a, sizes_b, bits_a, bits_b, threshold: int) -> np.ndarray:
    """Whether sets may be linked: sizes fit, and the sketches differ in no more bits than the sets may.

    An element in one set only flips one bit, so the sketches never differ in more bits than the sets in elements.
    """
    fit = 100 * np.minimum(sizes_a, sizes_b) >= threshold * np.maximum(sizes_a, sizes_b)
    apart = np.bitwise_count(bits_a ^ bits_b).sum(axis=-1, dtype=np.int64)
    return fit & (apart * (100 + threshold) <= (100 - threshold) * (sizes_a + sizes_b))


def _bits(column) -> np.ndarray:
    """(rows, words) of a column of sketches."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH // 64)


def _plausible(threshold: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {f: batch.column(f) for f in ("na", "nb")}
            near = _close(c["na"].to_numpy(), c["nb"].to_numpy(), _bits(batch.column("ka")), _bits(batch.column("kb")), threshold)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return keep


def _across(threshold: int, closest: bool):
    """Task that pairs members (group, half, tid, comp, n, bits) of one group which are in different components and may be linked.

    In a group of two halves (0 and 1) members of one half meet those of the other; with -1 all members meet. With ``closest``, only the
    nearest pair of each component of a group. Only sketches are compared; a partition holds whole groups of about 2 * BLOCK members.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        group, half, tid, comp, n = (rows.column(c).to_numpy() for c in ("group", "half", "tid", "comp", "n"))
        bits = _bits(rows.column("bits"))
        order = np.lexsort((tid, comp, half, group))
        group, half, tid, comp, n, bits = group[order], half[order], tid[order], comp[order], n[order], bits[order]
        halved = half >= 0
        kind = np.where(halved, half, comp)
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (halved[1:] != halved[:-1])))
        starts = np.flatnonzero(new)
        ends = np.repeat(np.append(starts[1:], len(group)), np.diff(np.append(starts, len(group))))
        change = np.flatnonzero(new | np.concatenate(([True], kind[1:] != kind[:-1])))
        behind = np.repeat(np.append(change[1:], len(group)), np.diff(np.append(change, len(group))))  # first member of a later component, or half
        first, second, near_by = [], [], []
        for at in range(0, len(tid), 2 * BLOCK):
            own = np.arange(at, min(at + 2 * BLOCK, len(tid)))
            for lot in np.array_split(own, max(1, int((ends[own] - behind[own]).sum()) // 100_000)):
                count = ends[lot] - behind[lot]
                a = np.repeat(lot, count)
                b = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(behind[lot], count)
                near = _close(n[a], n[b], bits[a], bits[b], threshold) & (comp[a] != comp[b])
                first.append(a[near])
                second.append(b[near])
                if closest:
                    near_by.append(np.bitwise_count(bits[a[near]] ^ bits[b[near]]).sum(axis=1))
        a, b = np.concatenate(first), np.concatenate(second)
        if closest and len(a):
            # The nearest pair of every component of a group, seen from either side.
            apart, sides = np.concatenate(near_by), np.concatenate((a, b))
            order = np.lexsort((np.tile(apart, 2), comp[sides], group[sides]))
            head = sides[order]
            best = order[np.concatenate(([True], (group[head][1:] != group[head][:-1]) | (comp[head][1:] != comp[head][:-1])))] % len(a)
            a, b = a[np.unique(best)], b[np.unique(best)]
        found = np.unique(np.stack((np.minimum(tid[a], tid[b]), np.maximum(tid[a], tid[b])), 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return pairs


def meetings(members: DataFrame, block: int) -> DataFrame:
    """(group, half, tid, comp): the groups in which the members (sig, tid, comp, held) of signatures of several components meet.

    A signature of up to ``block`` members is one group. In a larger one only members outside its largest component need meet others:
    they are cut into blocks, and each block meets every block of the largest component and every other such block. With few
    of them, the rows sent are about the members of the signature, however many those are.
    """
    most = (
        members.where(F.col("held") > block).groupBy("sig", "comp").agg(F.count("*").alias("n"))
        .groupBy("sig").agg(F.max(F.struct("n", "comp")).alias("_most"))
    )
    rows = members.join(most, "sig", "left").withColumn("_major", F.col("comp") == F.col("_most.comp"))
    blocks = {name: F.ceil(n / F.lit(block)).cast("int") for name, n in (("_few", F.col("held") - F.col("_most.n")), ("_many", F.col("_most.n")))}
    rows = rows.withColumns(blocks).withColumn("_own", F.pmod(F.xxhash64("tid"), F.when(F.col("_major"), F.col("_many")).otherwise(F.col("_few"))).cast("int"))

    def place(half: Column, *of: Column) -> Column:
        return F.struct(F.xxhash64("sig", *of).alias("group"), half.cast("long").alias("half"))

    own, few, many = F.col("_own"), F.sequence(F.lit(0), F.col("_few") - 1), F.sequence(F.lit(0), F.col("_many") - 1)
    major = F.transform(few, lambda i: place(F.lit(0), F.lit(0), i, own))
    minor = F.concat(
        F.transform(many, lambda j: place(F.lit(1), F.lit(0), own, j)),
        F.transform(few, lambda i: place(F.when(i == own, -1).when(own < i, 0).otherwise(1), F.lit(1), F.least(i, own), F.greatest(i, own))),
    )
    places = F.when(F.col("_most").isNull(), F.array(place(F.lit(-1)))).when(F.col("_major"), major).otherwise(minor)
    return rows.select(F.explode(places).alias("_place"), "tid", "comp").select("_place.*", "tid", "comp")


def _linked(size: int, threshold: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            keep, last, text_a = [], None, None
            for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                if a != text_a:
                    text_a, last = a, shingles(a, size, known)
                other = shingles(b, size, known)
                both = len(np.intersect1d(last, other, assume_unique=True))
                keep.append(100 * both >= threshold * (len(last) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def components(links: DataFrame) -> DataFrame:
    """(v, comp) of every vertex of the links (a, b), which are written: comp is the smallest vertex reachable.

    Labels sink along links and then to the label's own label, so paths halve each round; minima
    are combined before the shuffle, and only whether anything changed reaches the driver. Links that form
    stars around their smallest vertex are done after one round.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "comp"), "b").groupBy(F.col("a").alias("v")).agg(F.min("comp").alias("near"))
        sunk = labels.join(near, "v").select("v", F.least("comp", "near").alias("to"), F.col("comp").alias("was"))
        jump = labels.select(F.col("v").alias("to"), F.col("comp").alias("next"))
        new = written(sunk.join(jump, "to").select("v", F.least("to", "next").alias("comp"), "was"))
        labels = new.select("v", "comp")
        if new.where("comp <> was").isEmpty():
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components (v, comp) after more links (a, b), which are written: only components that these join are labelled anew."""
    ends = [labels.select(F.col("v").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab"]
    placed = links.join(ends[0], "a", "left").join(ends[1], "b", "left")
    placed = placed.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    vertices = labels.unionByName(placed.select(F.col("a").alias("v"), F.col("ca").alias("comp"))).unionByName(placed.select(F.col("b").alias("v"), F.col("cb").alias("comp")))
    moved = components(placed.select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b"))
    moved = moved.select(F.col("v").alias("comp"), F.col("comp").alias("to"))
    vertices = vertices.distinct().join(moved, "comp", "left")
    return written(vertices.select("v", F.coalesce("to", "comp").alias("comp")))


def one_of_alike(shared: DataFrame) -> DataFrame:
    """(sig, smallest member) of one of the signatures with the same members, which propose the same pairs; none of a single member."""
    code = F.xxhash64("tid", F.lit(7))
    # A sum of 32-bit values cannot leave the range of 64 bits before 2^32 members.
    held = shared.groupBy("sig").agg(F.min("tid").alias("a"), F.count("*").alias("held"), F.sum(F.shiftright(code, 32)).alias("h1"), F.bit_xor(code).alias("h2"))
    return held.where("held > 1").groupBy("a", "held", "h1", "h2").agg(F.min("sig").alias("sig")).select("sig", "a")


def text_components(docs: DataFrame, size: int, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, rid, text), (rid, smallest doc), (rid, n_shingles) and the labels (v, comp) of linked texts, at ``threshold`` percent or more.

    Rows with equal texts are one vertex (``tid``). Signatures that two vertices share propose links. At first
    each vertex is compared with one smallest member of its signatures, then with those of all its signatures in
    other components, which joins families of copies without their pairs. Then signatures with members
    of several components compare these members across components, by sketch in the task and by text where sketches
    are near: the nearest pair of each component, and once that joins nothing more, all. No link between different texts is lost.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rid"), "text")
    width = math.log(100 / threshold)
    guess = rows.select(F.floor(F.log(F.greatest(F.octet_length("text") / 6.0, F.lit(1.0))) / width).cast("int").alias("band")).groupBy("band").count()
    # Rows per size band, by bytes: a few dozen numbers, for the choice of the schemes alone.
    schemes = Schemes(threshold, {r["band"]: r["count"] for r in guess.collect() if r["band"] is not None})
    known = WordHashes()

    def sign(text):
        members = shingles(text, size, known)
        return schemes.signatures(members), len(members)

    marks = shared_names(rows, sign, False, 1 << 60)
    facts = marks.where("rid is not null").select("rid", F.col("fact").alias("n_shingles"))
    marks = marks.where("rid is not null and names is not null").select("rid", "names")
    shared = written(marks.mapInArrow(_expand, "sig long, tid long").distinct())
    first = rows.groupBy("rid").agg(F.min(F.coalesce("doc_id", F.lit(NULL_ID))).alias("doc"))
    some, _ = maybe(rows.withColumn("doc", F.coalesce("doc_id", F.lit(NULL_ID))), key_filter(marks.select("rid")))
    texts = written(some.join(first, ["rid", "doc"], "left_semi").dropDuplicates(["rid"]).select(F.col("rid").alias("tid"), "text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = WordHashes()
        for batch in batches:
            found = [shingles(t, size, own) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("tid"), pa.array([len(f) for f in found], pa.int64()), pa.array([sketch(f) for f in found], pa.binary())], names=["tid", "n", "bits"]
            )

    sets = written(texts.mapInArrow(measure, "tid long, n long, bits binary"))

    def verified(pairs: DataFrame) -> DataFrame:
        # Pairs are written first: each side then sends only the texts that a pair names, and few pairs are no shuffle of texts at all.
        pairs = written(pairs)
        a, b = (maybe(texts.withColumnRenamed("tid", "rid"), key_filter(pairs.select(F.col(x).alias("rid"))))[0] for x in "ab")
        a, b = a.select(F.col("rid").alias("a"), F.col("text").alias("text_a")), b.select(F.col("rid").alias("b"), F.col("text").alias("text_b"))
        return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(_linked(size, threshold), "a long, b long")

    one = one_of_alike(shared)
    # The smallest member is compared with all others of a signature at once, so later it is none of them.
    shared = written(shared.join(one, "sig").where("tid <> a"))
    stars = shared.select("a", F.col("tid").alias("b")).distinct()
    side = [sets.select(F.col("tid").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"k{x}")) for x in "ab"]

    def near(pairs: DataFrame) -> DataFrame:
        return pairs.join(side[1], "b").join(side[0], "a").select("a", "b", "na", "nb", "ka", "kb").mapInArrow(_plausible(threshold), "a long, b long")

    stars = written(near(stars))
    links = written(verified(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")))
    labels = components(links)
    ends = [labels.select(F.col("v").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab"]
    apart = stars.join(ends[0], "a", "left").join(ends[1], "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    labels = joined(labels, written(verified(apart.select("a", "b"))))
    last = False
    while True:
        placed = shared.join(labels.withColumnRenamed("v", "tid"), "tid", "left").select("sig", "tid", F.coalesce("comp", "tid").alias("comp"))
        mixed = placed.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("held")).where("lo <> hi")
        members = meetings(placed.join(mixed.select("sig", "held"), "sig"), BLOCK).join(sets, "tid")
        members = members.select("group", "half", "tid", "comp", "n", "bits").repartition(partitions(spark), "group")
        pairs = members.mapInArrow(_across(threshold, not last), "a long, b long").distinct()
        new = written(verified(pairs))
        none = new.isEmpty()
        if not none:
            labels = joined(labels, new)
        if last:
            break
        last = none
    return rows, first, facts, labels


def linked_groups(docs: DataFrame, size: int = 4, threshold: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``, linked at ``threshold`` percent or more.

    Null texts and texts without words have no shingles and stay alone. A null id counts as larger than all
    others; component_id is null only if all ids of the component are. Equal rows share their result. An empty table gives no rows.
    """
    rows, first, facts, labels = text_components(docs, size, threshold)
    own = labels.select(F.col("v").alias("rid"), "comp")
    named = first.join(own, "rid", "left").select("rid", "doc", F.coalesce("comp", "rid").alias("comp"))
    # Only linked vertices need a smallest id beyond their own.
    least = named.join(own.select(F.col("comp").alias("comp")).distinct(), "comp", "left_semi").groupBy("comp").agg(F.min("doc").alias("least"))
    named = named.join(least, "comp", "left").select("rid", F.coalesce("least", "doc").alias("component_id"))

    id_ = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("component_id") != NULL_ID, F.col("component_id"))
    # Narrow rows; those of a hot text are spread by Spark's skew handling.
    return rows.select("doc_id", "rid").join(named.join(facts, "rid"), "rid").select("doc_id", "n_shingles", id_.alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, threshold: int = 80) -> DataFrame:
    """``docs`` with one row of each component of linked texts; the columns are unchanged.

    Of a component the row with the smallest id stays (null counts as the largest), of rows with one id that with the smallest hash of
    the text and then of the whole row, and of rows equal in everything one. So rows without id, rows that repeat an
    id and an id with two texts are judged by their texts. Rows without words (null, empty, white space) all stay. An empty table stays empty.
    """
    _, _, _, labels = text_components(docs, size, threshold)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    place = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64("text").alias("rid"), F.xxhash64(F.to_json(whole)).alias("of_row"))
    rid = F.coalesce(F.xxhash64("text"), F.lit(0))
    keyed = docs.select(whole.alias("row"), rid.alias("rid"), F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("_told"), place.alias("_place"))
    # Counted per text before anything is shuffled; only texts of several rows, or linked ones, need a decision.
    held = keyed.where("_told").groupBy("rid").agg(F.min("_place").alias("best"), F.count("*").alias("n"))
    held = held.join(labels.select(F.col("v").alias("rid"), "comp"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    several = held.groupBy("comp").agg(F.min("best").alias("_best"), F.sum("n").alias("n")).where("n > 1").drop("n")
    decided = written(held.select("rid", "comp").join(several, "comp").select("rid", "_best"))
    # Whole rows are shuffled only where their text may need one.
    some, others = maybe(keyed, key_filter(decided.select("rid")))
    judged = some.join(decided, "rid", "left").where("_best is null or _place = _best")
    # Equal rows of one place are one: the first of each task, then of all. Rows without a decision are apart.
    judged = judged.withColumn("_own", F.when(F.col("_best").isNull(), F.monotonically_increasing_id())).dropDuplicates(["_place", "_own"])
    return others.select("row.*").unionByName(judged.select("row.*"))


def op6_jaccard(spark, sf_dir):
    return linked_groups(table(spark, sf_dir, "documents"))
