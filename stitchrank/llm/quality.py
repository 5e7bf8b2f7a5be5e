"""Operator 4: quality classifier on random-indexing word vectors, with calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stitchrank.llm.common import remainder, table, word_hashes, WordHashes, written

# The bound on the labelled rows that the classifier is fitted on: those of the lowest hashes.
SAMPLE = 8000
# Words with this share of the sample's words get vectors of their contexts: at most 1 / SHARE of them.
SHARE = 5e-5
DIM = 64
BUCKETS = 4096  # rows that all other words share by hash
SHAPES = 512
WINDOW = 2
NONZERO = 8
CUT = 0.3
STRETCH = 100_000
HELD = 2_000_000  # words counted at once
FEATURES = 2 * DIM + 4


def index_vectors(rows: int, seed: int) -> np.ndarray:
    """A sparse ternary vector for each row: NONZERO entries of +1 or -1, the same in every process."""
    random = np.random.default_rng(seed)
    out = np.zeros((rows, DIM), np.int8)
    at = random.random((rows, DIM)).argsort(axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, random.choice(np.array([-1, 1], np.int8), (rows, NONZERO)), axis=1)
    return out



def shape(word: str) -> str:
    """Kinds of characters of a word in order, repeats folded: ``The,`` is ``Aa,`` and ``42%`` is ``0%``."""
    out: list[str] = []
    for ch in word:
        kind = "A" if ch.isupper() else "a" if ch.isalpha() else "0" if ch.isdigit() else ch
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out[:12])


class Rows(dict):
    """word -> row of its vector * SHAPES + row of its shape; the memory is bounded."""

    def __init__(self, frequent: np.ndarray, most: int = 150_000):
        super().__init__()
        self.frequent, self.most = {int(h): i for i, h in enumerate(frequent)}, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        code = xxhash.xxh64_intdigest(word)
        row = self.frequent.get(code)
        row = len(self.frequent) + code % BUCKETS if row is None else row
        kind = xxhash.xxh64_intdigest(shape(word.decode("utf-8", "replace")).encode()) % SHAPES
        value = self[word] = row * SHAPES + kind
        return value


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _codes(words: list[bytes], rows: Rows) -> np.ndarray:
    return np.fromiter(map(rows.__getitem__, words), np.int64, len(words))


def frequent_words(sample: DataFrame, share: float = SHARE) -> np.ndarray:
    """Hashes of the words with ``share`` of all words of the sample, in ascending order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = WordHashes(), [], 0

        def flush() -> pa.RecordBatch:
            codes, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(counts.astype(np.int64))], names=["code", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.append(word_hashes(_words(text), known))
                size += len(held[-1])
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    counts = written(sample.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # At most 1 / share words reach the driver.
    codes = counts.where(F.col("n") >= share * total).select("code").toArrow().column("code").to_numpy()
    return np.sort(codes.astype(np.int64).view(np.uint64))


def word_vectors(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the frequent words, unit vector of every row) by random indexing over the sample.

    The context vector of a word is the sum of the index vectors of the words and shapes around it; the
    sums are of integers, so they do not depend on the order of the tasks.
    """
    frequent = frequent_words(sample)
    size = len(frequent)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, own, kinds = Rows(frequent), index_vectors(size + BUCKETS, 1), index_vectors(SHAPES, 2)
        sums = np.zeros((size, DIM), np.int32)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                codes = _codes(_words(text), rows)
                for at in range(0, len(codes), STRETCH):
                    part = codes[max(0, at - WINDOW) : at + STRETCH + WINDOW]
                    word, vectors = part // SHAPES, own[part // SHAPES].astype(np.int32) + kinds[part % SHAPES]
                    around = np.zeros_like(vectors)
                    for step in range(1, WINDOW + 1):
                        around[step:] += vectors[:-step]
                        around[:-step] += vectors[step:]
                    inner = slice(min(at, WINDOW), min(at, WINDOW) + STRETCH)
                    word, around = word[inner], around[inner]
                    np.add.at(sums, word[word < size], around[word < size])
        used = np.flatnonzero(sums.any(axis=1))
        for at in range(0, len(used), 1000):
            some = used[at : at + 1000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(list(sums[some]), pa.list_(pa.int32()))], names=["word", "sums"])

    lines = sample.select("text").mapInArrow(contexts, "word long, sums array<int>")
    total = lines.groupBy("word").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(DIM)]).toArrow()
    vectors = index_vectors(size + BUCKETS, 1).astype(np.float64)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    if total.num_rows:
        sums = np.stack([total.column(f"s{i}").to_numpy() for i in range(DIM)], axis=1).astype(np.float64)
        sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        vectors[total.column("word").to_numpy()] += sums
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return frequent, vectors.astype(np.float32)


def pooled(words: list[bytes], rows: Rows, vectors: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Mean word vector and mean shape vector of a text, their lengths, the likeness of neighbours and the log of the words."""
    out = np.zeros(FEATURES, np.float32)
    if not words:
        return out
    like = 0.0
    for at in range(0, len(words), STRETCH):
        codes = _codes(words[at : at + STRETCH + 1], rows)
        own = vectors[codes // SHAPES]
        like += float(np.einsum("ij,ij->", own[1:], own[:-1]))
        out[:DIM] += own[:STRETCH].sum(axis=0)
        out[DIM : 2 * DIM] += kinds[codes[:STRETCH] % SHAPES].sum(axis=0)
    out[: 2 * DIM] /= len(words)
    out[2 * DIM] = np.linalg.norm(out[:DIM])
    out[2 * DIM + 1] = np.linalg.norm(out[DIM : 2 * DIM])
    out[2 * DIM + 2] = like / max(1, len(words) - 1)
    out[2 * DIM + 3] = np.log1p(len(words))
    return out


@dataclass
class Network:
    """Standardised inputs, a hidden layer of tanh units, one output; probabilities at a fitted temperature."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, steps: int = 1500, seed: int = 3) -> Network:
    """Adam on mini-batches over four fifths of the rows; the temperature on the rest."""
    random = np.random.default_rng(seed)
    order = random.permutation(len(x))
    hold, fit = order[: len(x) // 5], order[len(x) // 5 :]
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
    z = (x - mean) / scale
    d = x.shape[1]
    w = [random.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), random.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for step in range(1, steps + 1):
        some = random.choice(fit, min(256, len(fit)))
        a = np.tanh(z[some] @ w[0] + w[1])
        error = (1 / (1 + np.exp(-np.clip(a @ w[2] + w[3], -40, 40))) - y[some]) / len(some)
        back = np.outer(error, w[2]) * (1 - a * a)
        for i, g in enumerate((z[some].T @ back, back.sum(axis=0), a.T @ error, np.array([error.sum()]))):
            g = g + 1e-4 * w[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            w[i] = w[i] - 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, w, 1.0)
    if len(hold):
        raw, sign = net.logits(x[hold]), 2 * y[hold] - 1
        choices = np.geomspace(0.25, 8, 61)
        net.temperature = float(choices[np.argmin([np.logaddexp(0, -sign * raw / t).mean() for t in choices])])
    return net


class Classifier:
    """What a task needs to score texts; its size is set by SHARE, BUCKETS and DIM, not by the data."""

    def __init__(self, frequent: np.ndarray, vectors: np.ndarray, network: Network | None):
        self.frequent, self.vectors, self.network = frequent, vectors, network

    def features(self):
        rows, kinds = Rows(self.frequent), index_vectors(SHAPES, 2).astype(np.float32) / NONZERO**0.5
        return lambda text: pooled(_words(text), rows, self.vectors, kinds)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, sample: int = SAMPLE) -> Classifier:
    """Fit on at most ``sample`` labelled rows of ``docs`` whose crc32(doc_id as text) mod ``modulus`` is not 0.

    The sample are the rows of the lowest hashes of their ids. Null labels are left out; an id with several labels
    has the highest. Without a row of either class the classifier gives 0.5 throughout.
    """
    marked = labels.where(F.col(label).isNotNull() & (remainder(modulus) != 0)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = marked.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    # At most ``sample`` rows are broadcast.
    rows = written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label"))
    frequent, vectors = word_vectors(rows)
    model = Classifier(frequent, vectors, None)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = model.features()
        for batch in batches:
            found = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.list_(pa.float32()))], names=["doc_id", "label", "x"])

    found = rows.mapInArrow(measure, "doc_id long, label int, x array<float>").toArrow().sort_by("doc_id")
    y = found.column("label").to_numpy().astype(float)
    if len(y) and 0 < y.mean() < 1:
        x = np.stack(found.column("x").to_numpy()).astype(np.float64)
        # Rows of equal ids come in any order; equal inputs in one order make the fit repeatable.
        order = np.lexsort((*x.T, y))
        model.network = fit_network(x[order], y[order])
    return model


def score(docs: DataFrame, model: Classifier, modulus: int = 5) -> DataFrame:
    """``docs`` (its columns in the struct ``row``) with held_out, score and predicted.

    Every whole text is scored, null as empty; an empty text gets the network's answer to no words. A row
    with a null id is not held out. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, network = shared.value.features(), shared.value.network
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores = []
            for at in range(0, len(texts), 1000):
                x = np.stack([features(t) for t in texts[at : at + 1000]]).astype(np.float64)
                scores.append(network.probability(x) if network else np.full(len(x), 0.5))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.concatenate(scores) if scores else np.empty(0))], names=["row", "score"])

    fields = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(fields, "text")
    scored = rows.mapInArrow(judge, f"row {rows.schema['row'].dataType.simpleString()}, score double")
    held = F.coalesce(remainder(modulus, "row.doc_id") == 0, F.lit(False))
    return scored.select("row", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op4_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select("row.doc_id", "held_out", "score", "predicted")
