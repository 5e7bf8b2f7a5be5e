"""Listwise training of a scorer with hidden layers, by mini-batches of queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stitchrank.functions.vectors import feature_dim
from stitchrank.operators.embeddings import fit_width
from stitchrank.operators.listwise import feature_scale, make_model, scaled_features, with_vectors
from stitchrank.operators.scale import SIM_DECIMALS, shared_dir

Layers = list[tuple[np.ndarray, np.ndarray]]
# Sums of a task are put on this grid, so that their total over the tasks is exact, whatever the order.
GRADIENT_GRID = float(1 << 32)


def initial_layers(width: int, hidden: Sequence[int], seed: int) -> Layers:
    """Uniform weights and biases within 1 / sqrt(inputs) of zero, the same for the same seed."""
    rng, layers = np.random.Generator(np.random.Philox(seed)), []
    for n in [*hidden, 1]:
        bound = 1 / np.sqrt(width)
        layers.append((rng.uniform(-bound, bound, (width, n)), rng.uniform(-bound, bound, n)))
        width = n
    return layers


def flat(layers: Layers) -> np.ndarray:
    return np.concatenate([part.ravel() for layer in layers for part in layer])


def unflat(values: np.ndarray, shapes: list[tuple[int, int]]) -> Layers:
    layers, at = [], 0
    for n, m in shapes:
        layers.append((values[at : at + n * m].reshape(n, m), values[at + n * m : at + n * m + m]))
        at += n * m + m
    return layers


def pair_matrix(q: np.ndarray, p: np.ndarray, extra: np.ndarray | None, abs_diff=True, product=True, sq_diff=False, raw=False) -> np.ndarray:
    """The features of ``pair_features`` of one query with each row of ``p``."""
    parts = [(p @ q)[:, None]]
    parts += [np.abs(q - p)] if abs_diff else []
    parts += [q * p] if product else []
    parts += [(q - p) ** 2] if sq_diff else []
    parts += [np.broadcast_to(q, p.shape), p] if raw else []
    parts += [np.broadcast_to(extra, (len(p), len(extra)))] if extra is not None else []
    return np.concatenate(parts, axis=1)


def dropped(query: int, epoch: int, layer: int, shape: tuple[int, int], rate: float, seed: int) -> np.ndarray:
    """Scaled dropout mask of one query's list: a function of (seed, query, epoch, layer), of nothing else."""
    bits = np.random.Philox(key=np.array([seed, query], np.int64).view(np.uint64), counter=[0, 0, epoch, layer])
    return (np.random.Generator(bits).random(shape) >= rate) / (1 - rate)


def forward(layers: Layers, x: np.ndarray, masks: Sequence[np.ndarray] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
    """Logits, and the input of every layer."""
    inputs = []
    for depth, (w, b) in enumerate(layers):
        inputs.append(x)
        x = x @ w + b
        if depth < len(layers) - 1:
            x = np.maximum(x, 0.0)
            if masks:
                x = x * masks[depth]
    return x[:, 0], inputs


def list_loss(logits: np.ndarray, positive: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Loss, positive probability and the loss's gradient by the logits, of one list with some positives and some not."""
    p = np.exp(logits - logits.max())
    top = np.exp(logits - logits[positive].max()) * positive
    share = p[positive].sum() / p.sum()
    loss = np.log(np.exp(logits - logits.max()).sum()) + logits.max() - np.log(top.sum()) - logits[positive].max()
    return loss, share, p / p.sum() - top / top.sum()


def backward(layers: Layers, inputs: list[np.ndarray], pull: np.ndarray, masks: Sequence[np.ndarray] = ()) -> Layers:
    """Gradients by all weights and biases from the gradient by the logits."""
    out, delta = [], pull[:, None]
    for depth in range(len(layers) - 1, -1, -1):
        out.append((inputs[depth].T @ delta, delta.sum(axis=0)))
        if depth:
            delta = delta @ layers[depth][0].T * (inputs[depth] > 0)
            if masks:
                delta = delta * masks[depth - 1]
    return out[::-1]


def place_metrics(order: np.ndarray, positive: np.ndarray, n_truth: int, cuts: Sequence[int]) -> list[float]:
    """Recall and hit at each cut, and the reciprocal rank within the largest, of one list in ``order``."""
    hits, out = positive[order], []
    for c in cuts:
        n = float(hits[:c].sum())
        out += [n / n_truth, float(n > 0)]
    first = np.flatnonzero(hits[: max(cuts)])
    return [*out, 1.0 / (first[0] + 1) if len(first) else 0.0]


def _lists(batch):
    """(query, q, p, extra, base, positive, n_truth) of every packed row."""
    import numpy as np

    def lists(name):
        column = batch.column(name)
        ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
        return np.split(column.flatten().to_numpy(zero_copy_only=False), ends[:-1])

    columns = [lists(c) for c in ("q", "p", "extra", "base", "mask")]
    for i, (query, n_truth) in enumerate(zip(batch.column("query").to_pylist(), batch.column("n_truth").to_pylist())):
        q, p, extra, base, mask = (c[i] for c in columns)
        q = q.astype(float)
        yield query, q, p.astype(float).reshape(-1, len(q)), extra if len(extra) else None, base, mask.astype(bool), n_truth


def packed_lists(
    records: DataFrame, queries: DataFrame, index: DataFrame, truth: DataFrame, extra_dim: int, batch_size: int, seed: int
) -> tuple[DataFrame, int]:
    """One row per query with its vector and its candidates' vectors, written by mini-batch; and the number of mini-batches.

    Training queries are dealt to batches by a seeded hash; batch -1 holds the validation queries. A batch is a folder
    of its own, so a step reads its own rows only, and an epoch reads each row once. A list is as long as its pool.
    """
    spark = records.sparkSession
    sizes = truth.join(index.select("product_id"), "product_id", "left_semi").select("bundle_id", "product_id").distinct().groupBy("bundle_id").agg(F.count("*").alias("n_truth"))
    extra = F.col("extra") if extra_dim else F.array().cast("array<double>")
    items = with_vectors(records, queries, index).groupBy("bundle_id", "split", "q", extra.alias("extra")).agg(
        F.array_sort(F.collect_list(F.struct("product_id", "score", "positive", "p"))).alias("items")
    )
    rows = items.join(sizes, "bundle_id").select(
        F.col("bundle_id").cast("string").alias("bundle_id"), F.xxhash64(F.col("bundle_id").cast("string")).alias("query"), "split", "n_truth", "q", "extra",
        F.flatten(F.transform("items", lambda i: i["p"])).alias("p"),
        F.transform("items", lambda i: i["score"]).alias("base"), F.transform("items", lambda i: i["positive"]).alias("mask"),
    )
    train = records.where("split = 'train'").select("bundle_id").distinct().count()
    batches = max(1, -(-train // batch_size))
    deal = F.when(F.col("split") == "train", F.pmod(F.xxhash64(F.lit(seed), F.col("query")), F.lit(batches))).otherwise(-1)
    path = f"{shared_dir(spark)}/lists-{uuid.uuid4().hex}"
    # The validation queries, one "batch", are spread over the tasks.
    spread = F.when(F.col("_batch") == -1, F.pmod("query", F.lit(256))).otherwise(0)
    dealt = rows.withColumn("_batch", deal.cast("int"))
    dealt.repartition("_batch", spread).sortWithinPartitions("_batch", "query").write.partitionBy("_batch").parquet(path)
    return spark.read.schema(dealt.schema).parquet(path), batches


def _total(rows: DataFrame, task: Callable, **widths: int) -> dict[str, np.ndarray]:
    """The sum of the arrays of these widths that ``task`` returns for each task, added up on the executors."""
    sums = rows.mapInArrow(task, ", ".join(f"{n} array<double>" for n in widths))
    # The sum of no rows is zero.
    zero = rows.sparkSession.range(1).select(*[F.array_repeat(F.lit(0.0), w).alias(n) for n, w in widths.items()])
    row = sums.unionByName(zero).agg(*[vector_to_array(Summarizer.sum(array_to_vector(n))).alias(n) for n in widths]).first()
    return {n: np.asarray(row[n]) for n in widths}


def training_sums(rows: DataFrame, layers: Layers, features: dict, epoch: int = 0, dropout: float = 0.0, seed: int = 0) -> tuple[np.ndarray, float, float, int]:
    """(gradient, loss, positive probability, lists), each summed over the packed lists ``rows``.

    Lists without positives, or with nothing else, add nothing. With ``dropout``, hidden units are dropped
    by (seed, query, epoch), so a task that is run again computes the same.
    """
    shapes = [w.shape for w, _ in layers]
    weights, size = flat(layers), sum(n * m + m for n, m in shapes)

    def task(batches):
        import pyarrow as pa

        layers, grad, stats = unflat(weights, shapes), np.zeros(size), np.zeros(3)
        for batch in batches:
            for query, q, p, extra, _, mask, _ in _lists(batch) if batch.num_rows else ():
                if not mask.any() or mask.all():
                    continue
                x = pair_matrix(q, p, extra, **features)
                masks = [dropped(query, epoch, d, (len(p), n), dropout, seed) for d, (_, n) in enumerate(shapes[:-1])] if dropout else ()
                logits, inputs = forward(layers, x, masks)
                loss, share, pull = list_loss(logits, mask)
                grad += flat(backward(layers, inputs, pull, masks))
                stats += (loss, share, 1.0)
        on_grid = [np.rint(a * GRADIENT_GRID) / GRADIENT_GRID for a in (grad, stats)]
        yield pa.RecordBatch.from_pylist([{"grad": on_grid[0].tolist(), "stats": on_grid[1].tolist()}])

    total = _total(rows, task, grad=size, stats=3)
    loss, share, n = total["stats"]
    return total["grad"], float(loss), float(share), int(n)


def validation_metrics(rows: DataFrame, layers: Layers | None, features: dict, alpha: float, cuts: Sequence[int]) -> dict[str, float]:
    """Mean Recall and Hit at ``cuts`` and MRR at the largest, by model score plus ``alpha`` times the base score.

    Without ``layers`` the base score alone ranks. Scores equal to nine decimals keep the order of ``product_id``.
    """
    shapes = [w.shape for w, _ in layers] if layers else []
    weights, cuts = flat(layers) if layers else np.zeros(0), sorted(set(cuts))
    names = [f"{m}@{c}" for c in cuts for m in ("recall", "hit")] + ["mrr"]

    def task(batches):
        import pyarrow as pa

        layers, sums = unflat(weights, shapes), np.zeros(len(names) + 1)
        for batch in batches:
            for _, q, p, extra, base, mask, n_truth in _lists(batch) if batch.num_rows else ():
                score = forward(layers, pair_matrix(q, p, extra, **features))[0] + alpha * base if layers else base
                sums += [*place_metrics(np.argsort(-np.round(score, SIM_DECIMALS), kind="stable"), mask, n_truth, cuts), 1.0]
        yield pa.RecordBatch.from_pylist([{"sums": (np.rint(sums * GRADIENT_GRID) / GRADIENT_GRID).tolist()}])

    sums = _total(rows, task, sums=len(names) + 1)["sums"]
    n = sums[-1]
    return {"queries": float(n), **{name: float(sums[i] / n) if n else 0.0 for i, name in enumerate(names)}}


class AdamW:
    """Adam with decoupled weight decay."""

    def __init__(self, size: int, lr: float, decay: float) -> None:
        self.m, self.v, self.n, self.lr, self.decay = np.zeros(size), np.zeros(size), 0, lr, decay

    def step(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.n += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        ahead = (self.m / (1 - 0.9**self.n)) / (np.sqrt(self.v / (1 - 0.999**self.n)) + 1e-8)
        return weights * (1 - self.lr * self.decay) - self.lr * ahead


def fit_mlp(
    records: DataFrame,
    queries: DataFrame,
    index: DataFrame,
    truth: DataFrame,
    dim: int,
    hidden: Sequence[int] = (512, 128),
    epochs: int = 15,
    lr: float = 3e-4,
    weight_decay: float = 1e-4,
    dropout: float = 0.2,
    batch_size: int = 64,
    k: int = 15,
    ks: tuple[int, ...] = (),
    alpha: float = 0.2,
    features: dict | None = None,
    query_features: DataFrame | None = None,
    seed: int = 42,
    layers: Layers | None = None,
) -> tuple[dict, list[dict]]:
    """A scorer with hidden layers, fitted by AdamW on mini-batches of lists; the best epoch by validation Recall@k.

    The arguments are those of :func:`stitchrank.operators.listwise.fit_linear`. Lists are packed and written once, by
    mini-batch. A step is one job over its own batch: tasks return summed gradients of the weights, which
    the executors add up, and only the weights' width reaches the driver. Batches come in a seeded order per epoch.
    The same data, seed and files give the same model: partial sums are exact, and dropout depends on (seed, query, epoch).

    ``history[0]`` is the start: loss and positive probability of all training lists without dropout, and the
    metrics of the first weights; ``base_recall`` is Recall@k of the cosine order, which an epoch has to beat.
    Later entries hold the means over the epoch's steps. ``layers`` replaces the seeded first weights.
    """
    features, cuts, scale = dict(features or {}), sorted({k, *ks}), None
    if query_features is not None:
        scale = feature_scale(query_features, records.filter(F.col("split") == "train"))
        extra = scaled_features(query_features, {"scale": scale, "extra_dim": len(scale["names"])})
        queries = queries.join(extra, "bundle_id", "left").withColumn("extra", fit_width(F.col("extra"), len(scale["names"])))
    extra_dim = len(scale["names"]) if scale else 0
    layers = layers or initial_layers(feature_dim(dim, extra_dim=extra_dim, **features), hidden, seed)
    make_model(layers, dim, features, extra_dim, alpha, scale)  # checks widths and size
    packed, batches = packed_lists(records, queries, index, truth, extra_dim, batch_size, seed)
    train, val = packed.where("_batch >= 0"), packed.where("_batch = -1")
    shapes, weights = [w.shape for w, _ in layers], flat(layers)
    base = validation_metrics(val, None, features, alpha, cuts)
    best, best_recall = weights, base[f"recall@{k}"]
    _, loss, share, n = training_sums(train, layers, features)
    history = [{"epoch": 0, "train_loss": loss / max(1, n), "train_pos_prob": share / max(1, n), "base_recall": best_recall} | validation_metrics(val, layers, features, alpha, cuts)]
    rule = AdamW(len(weights), lr, weight_decay)
    for epoch in range(1, epochs + 1) if n else ():
        losses, shares = [], []
        for batch in np.random.Generator(np.random.Philox(key=seed, counter=[0, 0, 0, epoch])).permutation(batches):
            rows = packed.where(F.col("_batch") == int(batch))
            gradient, loss, share, n = training_sums(rows, unflat(weights, shapes), features, epoch, dropout, seed)
            if n:
                weights = rule.step(weights, gradient / n)
                losses.append(loss / n)
                shares.append(share / n)
        entry = {"epoch": epoch, "train_loss": float(np.mean(losses)), "train_pos_prob": float(np.mean(shares)), "base_recall": base[f"recall@{k}"]}
        entry |= validation_metrics(val, unflat(weights, shapes), features, alpha, cuts)
        history.append(entry)
        # Without validation queries the last epoch is taken.
        if not entry["queries"] or entry[f"recall@{k}"] > best_recall:
            best, best_recall = weights, entry[f"recall@{k}"]
    return make_model(unflat(best, shapes), dim, features, extra_dim, alpha, scale), history
