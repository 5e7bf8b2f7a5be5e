"""Operator 5: language-model scoring by a weighted backoff automaton."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stitchrank.llm.common import BASE, WordHashes, mix, partitions, remainder, table, word_hashes, written

# Words with at least this share of the training tokens are states and arcs of the automaton; by
# definition there are at most 1 / WORD_SHARE of them. The same for n-grams. All others are counted and scored
# exactly too, but by a shuffle: the shares decide what is broadcast, not what is scored.
WORD_SHARE = 1e-6
GRAM_SHARE = 1e-6
ORDER = 2
BLOCK_TOKENS = 2_000_000
START = xxhash.xxh64_intdigest(b"\n\n")  # the context of a first word
END = xxhash.xxh64_intdigest(b"\n")  # no word is a line break


def tokens(text: str | None, known: WordHashes) -> np.ndarray:
    """Hashes of the lower-cased words of a text and of its end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.append(word_hashes(words, known), np.uint64(END))


def _part(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


_BLOCK = pa.schema([
    ("block", pa.int64()), ("train_tokens", pa.int64()), ("train_rows", pa.int64()),
    ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())),
    ("words", pa.binary()), ("counts", pa.binary()), ("places", pa.binary()),
])
_BLOCK_SQL = "block long, train_tokens long, train_rows long, doc_id array<long>, held_out array<boolean>, sizes array<int>, words binary, counts binary, places binary"
_CELLS = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("kinds", pa.binary()), ("keys", pa.binary()), ("subs", pa.binary()), ("counts", pa.binary())])
_CELLS_SQL = "part int, block long, kinds binary, keys binary, subs binary, counts binary"
_COUNTED = pa.schema([
    ("block", pa.int64()), ("part", pa.int32()), ("reply", pa.binary()), ("distinct", pa.int64()), ("once", pa.int64()), ("twice", pa.int64()),
    ("codes", pa.binary()), ("counts", pa.binary()), ("states", pa.binary()), ("types", pa.binary()),
])
_COUNTED_SQL = "block long, part int, reply binary, distinct long, once long, twice long, codes binary, counts binary, states binary, types binary"
_DONE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_DONE_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"

# Kinds of n-grams, by where they are counted: by state and frequent word, by rare word, by rare context.
ARC, WORD, CONTEXT = 0, 1, 2


def _packed(values: np.ndarray) -> bytes:
    """Byte by byte of all values, which leaves the high ones next to nothing."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, kind: str) -> np.ndarray:
    if not packed:
        return np.empty(0, kind)
    n, width = int.from_bytes(packed[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(packed[8:], n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes, which of them each code is, and a place of each."""
    order = np.argsort(codes)
    codes = codes[order]
    new = np.concatenate((np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1]))
    which = np.empty(len(codes), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    return codes[new], which, order[new]


def blocks(rows: DataFrame) -> DataFrame:
    """The tokens of ``rows`` (doc_id, held_out, text), written in blocks of rows with some ``BLOCK_TOKENS`` tokens.

    A block has the hashes of its distinct words, the frequent first, their counts in training rows, and the number of
    the word at each place. All steps after it read blocks, so texts are cut into words once, and a block is the same in each.
    """

    def flush(number: int, ids: list, held: list, parts: list) -> pa.RecordBatch:
        words, places, _ = _distinct(np.concatenate(parts))
        by_count = np.argsort(-np.bincount(places), kind="stable")
        rank = np.empty(len(words), np.int32)
        rank[by_count] = np.arange(len(words))
        words, places, sizes = words[by_count], rank[places], [len(p) for p in parts]
        train = ~np.repeat(np.array(held, bool), sizes)
        counts = np.bincount(places[train], minlength=len(words))
        return pa.RecordBatch.from_pylist([{
            "block": number, "train_tokens": int(train.sum()), "train_rows": len(held) - sum(held), "doc_id": ids, "held_out": held, "sizes": sizes,
            "words": _packed(words), "counts": _packed(counts), "places": _packed(places),
        }], schema=_BLOCK)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number, size = WordHashes(), TaskContext.get().partitionId() << 32, 0
        ids, held, parts = [], [], []
        for batch in batches:
            for doc_id, is_held, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids.append(doc_id)
                held.append(is_held)
                parts.append(tokens(text, known))
                size += len(parts[-1])
                if size >= BLOCK_TOKENS:
                    yield flush(number, ids, held, parts)
                    number, size, ids, held, parts = number + 1, 0, [], [], []
        if ids:
            yield flush(number, ids, held, parts)

    return written(rows.select("doc_id", "held_out", "text").mapInArrow(cut, _BLOCK_SQL))


@dataclass
class Level:
    """The distinct n-grams of a block, for one n."""

    n: int
    which: np.ndarray  # the n-gram that ends at each place, -1 where a row has not so many words before
    at: np.ndarray  # a place of each
    hashes: np.ndarray
    counts: np.ndarray  # in training rows
    kind: np.ndarray
    key: np.ndarray
    sub: np.ndarray
    context: np.ndarray  # state that is the context of each, 0 if none is
    found: np.ndarray  # frequent word that each ends in, -1 if it is rare
    states: np.ndarray  # state that each is as a context

    def cells(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The order in which n-grams are sent, part by part, and where each of ``n`` parts starts."""
        spread = np.where(self.kind == ARC, mix(self.key), self.key) if self.n > 1 else self.key
        part = _part(spread, n).astype(np.int64)
        order = np.lexsort((self.sub, self.key, part * 4 + self.kind))
        return order, np.searchsorted(part[order], np.arange(n + 1))


def levels(block: dict, model: Automaton | None, order: int) -> Iterator[Level]:
    """The n-grams of a block from n = 1 to ``order``. A text starts with START, which only n-grams of two or more hold."""
    words, places = _unpacked(block["words"], "<u8"), _unpacked(block["places"] or b"", "<i4")
    none, zeros = np.zeros(len(words), np.uint64), np.zeros(len(words), np.int64)
    found = model.find(words) if model else zeros - 1
    level = Level(1, places, np.empty(0, np.int64), words, _unpacked(block["counts"], "<i8"), zeros, words, none, zeros, found, found + 1)
    yield level
    if order == 1:
        return
    first = np.concatenate(([0], np.cumsum(block["sizes"])[:-1]))
    train = ~np.repeat(np.array(block["held_out"], bool), block["sizes"])
    hashes, states = np.append(words, np.uint64(START)), np.append(level.states, model.start)
    for n in range(2, order + 1):
        before = np.concatenate((level.which[:1], level.which[:-1])).astype(np.int64)
        before[first] = len(words) if n == 2 else -1
        there = np.flatnonzero(before >= 0)
        codes, which, at = _distinct(before[there] * len(words) + places[there] if len(words) else there)
        context, word = codes // len(words), codes % len(words)
        state, last = states[context], found[word]
        kind = np.where(state == 0, CONTEXT, np.where(last < 0, WORD, ARC))
        key = np.where(kind == CONTEXT, hashes[context], np.where(kind == WORD, words[word], (state * model.width + last).astype(np.uint64)))
        # A rare context has few words after it, so 40 bits tell them apart.
        sub = np.where(kind == CONTEXT, words[word] >> np.uint64(24), np.where(kind == WORD, state, 0).astype(np.uint64))
        everywhere = np.full(len(places), -1, np.int32)
        everywhere[there] = which
        hashes = mix(hashes[context] * np.uint64(BASE) + words[word] + np.uint64(n))
        states = model.states_of(n, state, last)
        counts = np.bincount(which[train[there]], minlength=len(codes))
        level = Level(n, everywhere, there[at], hashes, counts, kind, key, sub, state, last, states)
        yield level


def counted(lots: DataFrame, model: Automaton | None, n: int, least: float) -> tuple[dict, DataFrame]:
    """Totals of the n-grams of all blocks with the codes and counts of those that come ``least`` times, and replies to the blocks.

    A block sends each of its n-grams once, and gets back how often it comes in all training rows; for one whose context
    is no state also how often the context does and how many words follow it: n-grams of a rare context meet in the task of the
    context. The others are dealt by state and word. ``types`` has the number of different words after each state.
    """
    spark, parts = lots.sparkSession, partitions(lots.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1).to_pylist()[0]
                for level in levels(block, shared.value, n):
                    pass
                order, edges = level.cells(parts)
                out = []
                for p in np.flatnonzero(np.diff(edges)):
                    at = order[edges[p] : edges[p + 1]]
                    out.append({
                        "part": int(p), "block": block["block"], "kinds": _packed(level.kind[at].astype("<u1")), "keys": _packed(_steps(level.key[at])),
                        "subs": _packed(level.sub[at]), "counts": _packed(level.counts[at].astype("<u4")),
                    })
                yield pa.RecordBatch.from_pylist(out, schema=_CELLS)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds, keys, subs, counts, part = [], [], [], [], [], 0
        for batch in batches:
            for row in batch.to_pylist():
                part = row["part"]
                names.append(row["block"])
                kinds.append(_unpacked(row["kinds"], "<u1"))
                keys.append(np.cumsum(_unpacked(row["keys"], "<u8"), dtype=np.uint64))
                subs.append(_unpacked(row["subs"], "<u8"))
                counts.append(_unpacked(row["counts"], "<u4"))
        if not names:
            return
        edges = np.concatenate(([0], np.cumsum([len(k) for k in kinds])))
        kind, key, sub, count = (np.concatenate(x) for x in (kinds, keys, subs, counts))
        del kinds, keys, subs, counts
        order = np.lexsort((sub, key, kind))
        kind, key, sub = kind[order], key[order], sub[order]
        new_key = np.concatenate(([True], (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])))
        new = new_key | np.concatenate(([True], sub[1:] != sub[:-1]))
        starts = np.flatnonzero(new)
        seen = np.add.reduceat(count[order].astype(np.int64), starts)
        of_key = np.cumsum(new_key)[starts] - 1
        held = np.bincount(of_key, weights=seen)[of_key].astype(np.int64)
        types = np.bincount(of_key, weights=seen > 0)[of_key].astype(np.int64)
        kind, key, sub = kind[starts], key[starts], sub[starts]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        for name, a, b in zip(names, edges[:-1], edges[1:], strict=True):
            some = place[a:b]
            rare = some[kind[some] == CONTEXT]
            reply = _packed(np.concatenate((seen[some], held[rare], types[rare])))
            yield pa.RecordBatch.from_pylist([{"block": name, "part": part, "reply": reply}], schema=_COUNTED)
        heavy = (kind == ARC) & (seen >= max(1.0, least))
        row = {"distinct": int((seen > 0).sum()), "once": int((seen == 1).sum()), "twice": int((seen == 2).sum())}
        row |= {"codes": _packed(key[heavy]), "counts": _packed(seen[heavy])}
        if n > 1:
            own = (seen > 0) & (kind != CONTEXT)
            state = np.where(kind == ARC, key // np.uint64(model.width), sub)[own].astype(np.int64)
            states, types = np.unique(state, return_counts=True)
            row |= {"states": states.tobytes(), "types": types.astype("<i8").tobytes()}
        yield pa.RecordBatch.from_pylist([row], schema=_COUNTED)

    columns = ["block", "words", "counts", *(["places", "sizes", "held_out"] if n > 1 else [F.lit(None).cast("binary").alias("places")])]
    sent = lots.select(*columns).mapInArrow(send, _CELLS_SQL).repartitionById(parts, F.col("part"))
    table_ = written(sent.mapInArrow(meet, _COUNTED_SQL))
    facts = table_.where("block is null")
    out = facts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("distinct", "once", "twice")]).first().asDict()
    codes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for row in facts.select("codes", "counts").toLocalIterator():
        codes.append(_unpacked(row["codes"], "<u8"))
        counts.append(_unpacked(row["counts"], "<i8"))
    codes, counts = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(codes)
    out |= {"codes": codes[order], "counts": counts[order]}
    if n > 1:
        types = facts.select("states", "types").mapInArrow(_spread_types, "state long, types long").groupBy("state").agg(F.sum("types").alias("types")).toArrow()
        out |= {"types": (types.column("state").to_numpy(), types.column("types").to_numpy())}
    return out, table_.where("block is not null").select("block", F.lit(n).alias("level"), "part", "reply")


def _spread_types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for states, types in zip(batch.column("states").to_pylist(), batch.column("types").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(states, "<i8")), pa.array(np.frombuffer(types, "<i8"))], names=["state", "types"])


@dataclass
class Automaton:
    """States are the empty context (0), the frequent words (1 ...), the start of a text, then frequent n-grams.

    An arc reads a word at its discounted, interpolated probability and leads to the longest context
    that is a state. Where a state has no arc for a word, its failure arc leads to the next shorter context at the
    backoff weight. From the empty context every frequent word has an arc; a rare word fails down to it
    and is priced by its own count. Weights and discounts are those of all n-grams, so what has no arc can be priced elsewhere.
    """

    total: int
    distinct: int
    discount: float
    words: np.ndarray  # sorted hashes of the frequent words
    counts: np.ndarray
    arcs: np.ndarray  # sorted, state * width + word
    leads: np.ndarray  # state that an arc leads to
    prices: np.ndarray  # its log10 probability
    fail: np.ndarray
    weight: np.ndarray  # log10 weight of the failure arc
    order: int
    held: np.ndarray  # how often each state is a context
    less: list[float]  # discount of the n-grams of n words, by n
    codes_of: list[np.ndarray]  # sorted codes of the kept n-grams, by length
    first_of: list[int]  # the first state of them

    @property
    def width(self) -> int:
        return len(self.words) + 1

    @property
    def start(self) -> int:
        return len(self.words) + 1

    @cached_property
    def steps(self) -> dict[int, tuple[int, float]]:
        """The arcs one by one: state * width + word -> (state, log10 probability)."""
        return dict(zip(self.arcs.tolist(), zip(self.leads.tolist(), self.prices.tolist()), strict=True))

    @cached_property
    def failing(self) -> list[tuple[int, float]]:
        """The failure arc of each state: (state, log10 weight)."""
        return list(zip(self.fail.tolist(), self.weight.tolist(), strict=True))

    @cached_property
    def to_root(self) -> list[float]:
        """Sum of the weights down to the empty context."""
        out = [0.0] * len(self.fail)
        for state in range(1, len(self.fail)):  # a state comes after the one it fails to
            out[state] = self.failing[state][1] + out[self.failing[state][0]]
        return out

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each frequent word, -1 for a rare one."""
        at, there = _among(self.words, hashes)
        return np.where(there, at, -1)

    def rare(self, counts: np.ndarray) -> np.ndarray:
        """log10 probability of words at the empty context by their counts; that of a word never seen in training is the mass that is free."""
        if not self.total:
            return np.zeros(len(counts))
        unseen = self.discount * self.distinct / self.total
        return np.log10(np.where(counts > 0, (counts - self.discount) / self.total, unseen))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.total + self.distinct + 1))

    def states_of(self, n: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """State that each n-gram is, by the state of its context and its last word; 0 if it is none."""
        if n - 2 >= len(self.codes_of) or n >= self.order:
            return np.zeros(len(context), np.int64)
        at, there = _among(self.codes_of[n - 2], context * self.width + word)
        return np.where(there & (context > 0) & (word >= 0), at + self.first_of[n - 2], 0)

    def traverse(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From each state, over failure arcs to the first arc for the frequent word: the state it leads to, log10 probability of the way, state with the arc."""
        leads, price, state = np.zeros(len(state), np.int64), np.zeros(len(state)), state.copy()
        todo = np.arange(len(state))
        while len(todo):
            at, there = _among(self.arcs, state[todo] * self.width + word[todo])
            here, at, todo = todo[there], at[there], todo[~there]
            leads[here] = self.leads[at]
            price[here] += self.prices[at]
            price[todo] += self.weight[state[todo]]
            state[todo] = self.fail[state[todo]]
        return leads, price, state

    def probabilities(self, level: Level, seen: np.ndarray, held: np.ndarray, types: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Probability of each n-gram's last word: that of its arc, else by its counts and the probability after the next ``shorter`` context."""
        own = level.kind != CONTEXT
        held, rest = held.astype(float), types * self.less[level.n - 1]
        held[own] = self.held[level.context[own]]
        rest = np.where(held > 0, rest / np.maximum(held, 1), 1.0)
        rest[own] = 10.0 ** self.weight[level.context[own]]
        out = np.maximum(seen - self.less[level.n - 1], 0) / np.maximum(held, 1) + rest * shorter
        at = np.flatnonzero(level.kind == ARC)
        _, price, state = self.traverse(level.context[at], level.found[at])
        whole = state == level.context[at]
        out[at[whole]] = 10.0 ** price[whole]
        return out


def _among(codes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted code among sorted ones, and whether it is there."""
    if not len(codes):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return at, codes[at] == wanted


def _step(model: Automaton, state: int, word: int) -> tuple[int, float]:
    """Where a word leads from a state, and the log10 probability of it, over failure arcs."""
    score = 0.0
    while (step := model.steps.get(state * model.width + word)) is None:
        state, weight = model.failing[state]
        score += weight
    return step[0], score + step[1]


def _fitted(lots: DataFrame, order: int = ORDER, word_share: float = WORD_SHARE, gram_share: float = GRAM_SHARE) -> tuple[Automaton, list[DataFrame]]:
    """The automaton of the training rows of all blocks, and the replies to the blocks for n = 1 to ``order``."""
    total, rows = lots.agg(F.coalesce(F.sum("train_tokens"), F.lit(0)), F.coalesce(F.sum("train_rows"), F.lit(0))).first()
    one, reply = counted(lots, None, 1, word_share * total)
    replies = [reply]
    discount = one["once"] / (one["once"] + 2 * one["twice"]) if one["once"] and one["twice"] else 0.5
    size = len(one["codes"])
    model = Automaton(
        total, one["distinct"], discount, one["codes"], one["counts"], np.arange(size), np.arange(size) + 1, np.empty(0),
        np.zeros(size + 2, np.int64), np.zeros(size + 2), order, np.empty(0), [discount], [], [],
    )
    model.prices = model.rare(one["counts"])
    ends = int(model.find(np.array([END], np.uint64))[0])
    # How often each state is a context; a text starts once in each row.
    model.held = np.concatenate(([0], one["counts"], [rows]))
    for n in range(2, order + 1):
        some, reply = counted(lots, model, n, gram_share * total)
        replies.append(reply)
        codes, counts = some["codes"].astype(np.int64), some["counts"]
        less = some["once"] / (some["once"] + 2 * some["twice"]) if some["once"] and some["twice"] else 0.5
        states, words = codes // model.width, codes % model.width
        rest, follow = np.ones(len(model.held)), some["types"]
        rest[follow[0]] = np.clip(less * follow[1] / model.held[follow[0]], 1e-12, 1.0)
        model.weight[follow[0]] = np.log10(rest[follow[0]])
        targets, shorter, _ = model.traverse(model.fail[states], words)
        prices = np.log10((counts - less) / model.held[states] + rest[states] * 10.0**shorter)
        first = len(model.held)
        model.less.append(less)
        model.codes_of.append(codes)
        model.first_of.append(first)
        leads = targets
        if n < order:
            leads = np.where(words != ends, first + np.arange(len(codes)), targets)
            model.fail, model.weight = np.append(model.fail, targets), np.append(model.weight, np.zeros(len(codes)))
            model.held = np.append(model.held, counts)
        arcs = np.append(model.arcs, codes)
        by_arc = np.argsort(arcs)
        model.arcs, model.leads, model.prices = arcs[by_arc], np.append(model.leads, leads)[by_arc], np.append(model.prices, prices)[by_arc]
    return model, replies


def build(train: DataFrame, **settings) -> Automaton:
    """Count the words and n-grams of all of ``train`` and make the automaton."""
    return _fitted(blocks(train.select("doc_id", F.lit(False).alias("held_out"), "text")), **settings)[0]


def scored(docs: DataFrame, modulus: int = 7, held: int = 2, **settings) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Rows whose crc32(doc_id as text) mod ``modulus`` is ``held`` are held out; the model counts all others, a
    null id among them. Null and empty texts have one token, their end. The n-grams of a block of rows are counted over all
    training rows once, and the counts come back to the block, where words and n-grams without a place in the
    automaton are priced by them; a word never seen in training takes the mass that the discount frees. The shares of the
    automaton change what is broadcast, not the scores.
    Equal rows score alike. An empty table gives no rows.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    lots = blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(modulus) == held, F.lit(False)).alias("held_out"), "text"))
    model, replies = _fitted(lots, **settings)
    shared = spark.sparkContext.broadcast(model)  # at most 1 / WORD_SHARE words and as many n-grams

    def price(lot: pa.Table) -> pa.Table:
        automaton = shared.value
        block = lot.filter(pc.equal(lot.column("level"), 0)).to_pylist()[0]
        first = np.concatenate(([0], np.cumsum(block["sizes"])[:-1]))
        for level in levels(block, automaton, automaton.order):
            order, edges = level.cells(n)
            seen, held_, types = (np.zeros(len(order), np.int64) for _ in range(3))
            for reply in lot.filter(pc.equal(lot.column("level"), level.n)).select(["part", "reply"]).to_pylist():
                at = order[edges[reply["part"]] : edges[reply["part"] + 1]]
                rare = at[level.kind[at] == CONTEXT]
                values = _unpacked(reply["reply"], "<i8")
                seen[at] = values[: len(at)]
                held_[rare], types[rare] = values[len(at) :].reshape(2, -1)
            if level.n == 1:
                known = np.add.reduceat((seen > 0).astype(np.int64)[level.which], first)
                base = np.add.reduceat(automaton.base(seen)[level.which], first)
                chance = (10.0 ** automaton.rare(seen))[level.which]
            else:
                there = level.which >= 0
                chance[there] = automaton.probabilities(level, seen, held_, types, chance[level.at])[level.which[there]]
        score = np.add.reduceat(np.log10(chance), first)
        return pa.table([block["doc_id"], block["held_out"], block["sizes"], known, base, score], schema=_DONE)

    lot = lots.select("block", F.lit(0).alias("level"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("reply"), "doc_id", "held_out", "sizes", "words", "counts", "places")
    for reply in replies:
        lot = lot.unionByName(reply, allowMissingColumns=True)
    done = lot.groupBy("block").applyInArrow(price, _DONE_SQL)
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op5_language_model(spark, sf_dir):
    return scored(table(spark, sf_dir, "documents"))
