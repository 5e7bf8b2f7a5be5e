"""Learned scorers over candidate pairs: loss, linear fit, scoring, rerank.

A model is a plain dict: ``layers`` is a list of ``(weights [in][out], bias [out])`` with ReLU
between them, ``features`` holds the keyword arguments of ``pair_features``, ``dim`` and
``extra_dim`` the vector widths, ``scale`` the names, means and deviations of the query features. One layer makes it linear. Weights are small and travel in
the task closure; their size is checked.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stitchrank.functions.vectors import dot, feature_dim, pair_features
from stitchrank.operators.embeddings import fit_width, weighted_bundle_vector
from stitchrank.operators.rank import zscore
from stitchrank.operators.scale import checkpointed, stable

MODEL_BYTES = 256 << 20
NO_VECTOR_SCORE = -1e9  # score of a product without a vector


def listwise_loss(scores: Column, mask: Column) -> Column:
    """Struct of the multi-positive loss and the positive probability of one list."""
    top = F.array_repeat(F.array_max(scores), F.size(scores))  # evaluated once, not per element
    weights = F.zip_with(scores, top, lambda s, t: F.exp(s - t))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
    positive = F.aggregate(
        F.zip_with(weights, mask, lambda w, m: F.when(m, w).otherwise(0.0)), F.lit(0.0), lambda acc, w: acc + w
    )
    share = positive / total
    return F.struct((-F.ln(share)).alias("loss"), share.alias("pos_prob"))


def listwise_losses(records: DataFrame) -> DataFrame:
    """N6 for N5 records with a ``score``: one row per query, by partial aggregates over lists of any length.

    ``records`` is read twice.
    """
    top = records.groupBy("bundle_id").agg(F.max("score").alias("_top"))
    weighed = records.join(top, "bundle_id").withColumn("_w", F.exp(F.col("score") - F.col("_top")))
    share = F.sum(F.when(F.col("positive"), F.col("_w")).otherwise(0.0)) / F.sum("_w")
    sums = weighed.groupBy("bundle_id").agg(share.alias("pos_prob"))
    return sums.select("bundle_id", (-F.ln("pos_prob")).alias("loss"), "pos_prob")


def make_model(
    layers, dim: int, features: dict | None = None, extra_dim: int = 0, alpha: float = 0.2, scale: dict | None = None
) -> dict:
    """A checked model; raises when the layer widths do not fit the features.

    ``scale`` has ``names``, ``mean`` and ``std`` of the query features, ``extra_dim`` entries each.
    """
    if scale is not None and {len(scale[c]) for c in ("names", "mean", "std")} != {extra_dim}:
        raise ValueError(f"query features {scale['names']} for extra_dim {extra_dim}")
    features = dict(features or {})
    layers = [(np.asarray(w, dtype=float), np.asarray(b, dtype=float)) for w, b in layers]
    width = feature_dim(dim, extra_dim=extra_dim, **features)
    for w, b in layers:
        if w.ndim != 2 or w.shape[0] != width or b.shape != (w.shape[1],):
            raise ValueError(f"layer of shape {w.shape} / {b.shape} after {width} inputs")
        width = w.shape[1]
    if width != 1:
        raise ValueError("the last layer must have one output")
    if sum(w.nbytes + b.nbytes for w, b in layers) > MODEL_BYTES:
        raise ValueError("model too large to send to the tasks")
    return {"layers": layers, "dim": dim, "features": features, "extra_dim": extra_dim, "alpha": alpha, "scale": scale}


def save_model(spark: SparkSession, model: dict, path: str) -> None:
    """Model as one JSON document."""
    body = {**model, "layers": [(w.tolist(), b.tolist()) for w, b in model["layers"]]}
    spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> dict:
    """Model written by :func:`save_model`, its dimensions checked again."""
    body = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    return make_model(body["layers"], body["dim"], body["features"], body["extra_dim"], body["alpha"], body.get("scale"))


def score_pairs(pairs: DataFrame, model: dict, name: str = "model_score") -> DataFrame:
    """Score every pair row by its ``q``, ``p`` (and ``extra``) vectors; the vectors drop out.

    A linear model stays inside the JVM; deeper ones run as matrix products over Arrow batches.
    """
    extra = F.col("extra") if model["extra_dim"] else None
    features = pair_features(F.col("q"), F.col("p"), extra=extra, **model["features"])
    rest = [c for c in pairs.columns if c not in ("q", "p", "extra")]
    if len(model["layers"]) == 1:
        w, b = model["layers"][0]
        weights = F.array(*[F.lit(float(x)) for x in w[:, 0]])
        return pairs.select(*rest, (dot(features, weights) + F.lit(float(b[0]))).alias(name))
    layers = model["layers"]
    rows = pairs.select(*rest, features.alias("_x"))
    schema = T.StructType([rows.schema[c] for c in rest] + [T.StructField(name, T.DoubleType())])

    def forward(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for depth, (w, b) in enumerate(layers, start=1):
                x = x @ w + b
                if depth < len(layers):
                    x = x.clip(min=0.0)
            columns = [batch.column(c) for c in rest] + [pa.array(x[:, 0])]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, name])

    return rows.mapInArrow(forward, schema)


def with_vectors(candidates: DataFrame, queries: DataFrame, index: DataFrame) -> DataFrame:
    """Candidate rows with the vector ``q`` of their bundle and ``p`` of their product.

    ``queries`` may carry ``extra`` features.
    """
    extra = ["extra"] if "extra" in queries.columns else []
    q = queries.select("bundle_id", F.col("v").alias("q"), *extra)
    return candidates.join(q, "bundle_id").join(index.select("product_id", F.col("v").alias("p")), "product_id")


def scaled_features(features: DataFrame, model: dict) -> DataFrame:
    """``bundle_id, extra``: the raw query features standardised as the model was trained.

    ``features`` has the columns ``model["scale"]["names"]``, or an array ``extra`` that is standardised already.
    A missing value counts as the mean.
    """
    scale = model["scale"]
    if scale is None or "extra" in features.columns:
        return features.select("bundle_id", fit_width(F.col("extra"), model["extra_dim"]).alias("extra"))
    values = [
        F.coalesce((F.col(c).cast("double") - m) / d, F.lit(0.0))
        for c, m, d in zip(scale["names"], scale["mean"], scale["std"], strict=True)
    ]
    return features.select("bundle_id", F.array(*values).alias("extra"))


def learned_rerank(
    ranked: DataFrame, crops: DataFrame, index: DataFrame, model: dict, alpha: float | None = None,
    features: DataFrame | None = None,
) -> DataFrame:
    """F8: model score plus ``alpha`` times the bundle's z-scored base score, re-ranked.

    A product without a vector gets -1e9 as model score; the list of a bundle without a usable
    vector stays as it is. A model with query features needs ``features`` (see :func:`scaled_features`);
    a bundle without a row in it has the mean of each.
    """
    alpha = model["alpha"] if alpha is None else alpha
    queries = weighted_bundle_vector(crops).select("bundle_id", F.col("v").alias("q"))
    if model["extra_dim"]:
        if features is None:
            raise ValueError(f"the model needs {model['extra_dim']} query features")
        queries = queries.join(scaled_features(features, model), "bundle_id", "left")
        queries = queries.withColumn("extra", fit_width(F.col("extra"), model["extra_dim"]))
    pairs = ranked.select("bundle_id", "product_id").join(queries, "bundle_id").join(
        index.select("product_id", F.col("v").alias("p")), "product_id"
    )
    scored = score_pairs(pairs, model, "_model")
    rows = zscore(ranked, "_z").join(scored, ["bundle_id", "product_id"], "left")
    rows = rows.join(queries.select("bundle_id", F.lit(True).alias("_known")), "bundle_id", "left")
    learned = F.coalesce("_model", F.lit(NO_VECTOR_SCORE)) + F.lit(alpha) * F.col("_z")
    mixed = rows.withColumn("score", F.when(F.col("_known"), stable(learned)).otherwise(F.col("score")))
    order = Window.partitionBy("bundle_id").orderBy(F.desc("score"), F.asc("product_id"))
    return mixed.drop("_z", "_model", "_known").withColumn("rank", F.row_number().over(order))


def feature_scale(features: DataFrame, train_ids: DataFrame) -> dict:
    """Names, means and population deviations of the query features over the training queries; a flat one keeps 1."""
    names = [c for c in features.columns if c != "bundle_id"]
    train = features.join(train_ids.select("bundle_id").distinct(), "bundle_id", "left_semi")
    row = train.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = [row[f"m{i}"] or 0.0 for i in range(len(names))]
    std = [row[f"s{i}"] if (row[f"s{i}"] or 0.0) >= 1e-6 else 1.0 for i in range(len(names))]
    return {"names": names, "mean": mean, "std": std}


def fit_linear(
    records: DataFrame,
    queries: DataFrame,
    index: DataFrame,
    truth: DataFrame,
    dim: int,
    epochs: int = 15,
    lr: float = 3e-4,
    k: int = 15,
    alpha: float = 0.2,
    features: dict | None = None,
    query_features: DataFrame | None = None,
    ks: tuple[int, ...] = (),
) -> tuple[dict, list[dict]]:
    """Linear listwise scorer by full-batch Adam, the best epoch by validation Recall@k.

    ``records`` are candidate rows ``(bundle_id, product_id, score, positive, split)``: N5
    records for ``train``, all candidates for ``val``. ``query_features`` (``bundle_id`` and one column per
    feature) are standardised on the training queries and go into the model with their scale. Rows are packed once,
    one per query (a list is as long as its pool, which the search bounds), and checkpointed. One job per epoch
    returns the summed gradient and metrics; only vectors of the feature width reach the driver.

    The history has one entry per epoch: loss, positive probability, Recall and Hit at ``k`` and each of
    ``ks``, and MRR of the validation queries. Weights start as plain cosine, so epoch 0 is the baseline.
    """
    features = dict(features or {})
    scale = None
    if query_features is not None:
        scale = feature_scale(query_features, records.filter(F.col("split") == "train"))
        extra = scaled_features(query_features, {"scale": scale, "extra_dim": len(scale["names"])})
        queries = queries.join(extra, "bundle_id", "left").withColumn("extra", fit_width(F.col("extra"), len(scale["names"])))
    extra_dim = len(scale["names"]) if scale else 0
    width = feature_dim(dim, extra_dim=extra_dim, **features)
    cuts = sorted({k, *ks})
    sizes = truth.join(index.select("product_id"), "product_id", "left_semi").select(
        "bundle_id", "product_id"
    ).distinct().groupBy("bundle_id").agg(F.count("*").alias("n_truth"))
    vectors = with_vectors(records, queries, index)
    x = pair_features(F.col("q"), F.col("p"), extra=F.col("extra") if extra_dim else None, **features)
    packed = checkpointed(
        vectors.select("bundle_id", "split", F.struct("product_id", "score", "positive", x.alias("x")).alias("item"))
        .groupBy("bundle_id", "split").agg(F.array_sort(F.collect_list("item")).alias("items"))
        .join(sizes, "bundle_id")
        .select(
            "split", "n_truth",
            F.transform("items", lambda i: i["score"]).alias("base"),
            F.transform("items", lambda i: i["positive"]).alias("mask"),
            F.flatten(F.transform("items", lambda i: i["x"])).alias("x"),
        )
    )
    names = ["loss", "prob", "n", "n_val", "mrr", *[f"{m}@{c}" for c in cuts for m in ("recall", "hit")]]

    def epoch_job(weights: np.ndarray):
        def sums(batches):
            import numpy as np
            import pyarrow as pa

            grad, stats = np.zeros(len(weights)), dict.fromkeys(names, 0.0)
            for batch in batches:
                if not batch.num_rows:
                    continue
                column = {c: batch.column(c) for c in ("base", "mask", "x")}
                rows = column["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(weights))
                base = column["base"].flatten().to_numpy(zero_copy_only=False)
                mask = column["mask"].flatten().to_numpy(zero_copy_only=False).astype(bool)
                size = column["base"].value_lengths().to_numpy()
                query, starts = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
                train = batch.column("split").to_numpy(zero_copy_only=False) != "val"
                logits = rows @ weights
                p = np.exp(logits - np.maximum.reduceat(logits, starts)[query])
                p /= np.add.reduceat(p, starts)[query]
                share = np.add.reduceat(p * mask, starts)
                pull = p - np.where(mask, p / np.where(share > 0, share, 1.0)[query], 0.0)
                grad += rows.T @ (pull * train[query])
                stats["loss"] -= np.log(share[train]).sum()
                stats["prob"] += share[train].sum()
                stats["n"] += train.sum()
                stats["n_val"] += (~train).sum()
                # The place of each candidate in its list, ties in the order of the list.
                order = np.lexsort((-(logits + alpha * base), query))
                place = np.empty(len(query), np.int64)
                place[order] = np.arange(len(query)) - starts[query]
                truth_size = batch.column("n_truth").to_numpy()
                best = np.minimum.reduceat(np.where(mask, place, len(query)), starts)
                stats["mrr"] += (1.0 / (best + 1))[~train & (best < size)].sum()
                for c in cuts:
                    hits = np.add.reduceat(mask & (place < c), starts, dtype=np.int64)
                    stats[f"recall@{c}"] += (hits / truth_size)[~train].sum()
                    stats[f"hit@{c}"] += (hits > 0)[~train].sum()
            yield pa.RecordBatch.from_pylist([{"grad": grad.tolist(), "stats": [float(stats[s]) for s in names]}])

        # One row per task; the rows are added up on the executors.
        added = packed.mapInArrow(sums, "grad array<double>, stats array<double>").agg(
            *[vector_to_array(Summarizer.sum(array_to_vector(c))).alias(c) for c in ("grad", "stats")]
        ).first()
        return np.asarray(added["grad"]), dict(zip(names, added["stats"], strict=True))

    weights, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    weights[0] = 1.0  # starts as plain cosine ranking
    best, best_recall, history = weights.copy(), -1.0, []
    for epoch in range(epochs + 1):
        gradient, totals = epoch_job(weights)
        n, n_val = int(totals["n"]), int(totals["n_val"])
        entry = {
            "epoch": epoch,
            "train_loss": totals["loss"] / n if n else 0.0,
            "train_pos_prob": totals["prob"] / n if n else 0.0,
        }
        entry |= {f"{s}": totals[s] / n_val if n_val else 0.0 for s in names[4:]}
        history.append(entry)
        recall = entry[f"recall@{k}"] if n_val else entry["train_pos_prob"]
        if recall > best_recall:
            best, best_recall = weights.copy(), recall
        if not n:
            break
        gradient /= n
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        step = epoch + 1
        weights = weights - lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return make_model([(best[:, None], np.zeros(1))], dim, features, extra_dim, alpha, scale), history
