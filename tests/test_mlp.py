import numpy as np
import pytest

from stitchrank.operators import listwise, mlp
from stitchrank.functions.vectors import pair_features
from pyspark.sql import functions as F


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def data(spark, n=40, m=25, dim=5):
    """Positives agree with the query on the first coordinate, which plain cosine does not single out."""
    rng = np.random.default_rng(2)
    q, p = unit(rng.normal(size=(n, dim))), unit(rng.normal(size=(m, dim)))
    cand, truth = [], []
    for i in range(n):
        good = set(np.argsort(-(q[i, 0] * p[:, 0]))[:3].tolist())
        truth += [(f"b{i}", f"p{j}") for j in good]
        cand += [(f"b{i}", f"p{j:02d}", float(q[i] @ p[j]), j in good, "val" if i % 5 == 0 else "train") for j in range(m)]
    truth = [(b, f"p{int(x[1:]):02d}") for b, x in truth]
    return (
        spark.createDataFrame(cand, "bundle_id string, product_id string, score double, positive boolean, split string"),
        spark.createDataFrame([(f"b{i}", v.tolist()) for i, v in enumerate(q)], "bundle_id string, v array<double>"),
        spark.createDataFrame([(f"p{i:02d}", v.tolist()) for i, v in enumerate(p)], "product_id string, v array<double>"),
        spark.createDataFrame(truth, "bundle_id string, product_id string"),
    )


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(0)
    layers = mlp.initial_layers(6, (5, 4), 3)
    shapes, weights = [w.shape for w, _ in layers], mlp.flat(layers)
    x, positive = rng.normal(size=(7, 6)), np.array([1, 0, 0, 1, 0, 0, 0], bool)
    masks = [mlp.dropped(11, 2, d, (7, n), 0.3, 5) for d, (_, n) in enumerate(shapes[:-1])]

    def loss(values):
        return mlp.list_loss(mlp.forward(mlp.unflat(values, shapes), x, masks)[0], positive)

    logits, inputs = mlp.forward(layers, x, masks)
    gradient = mlp.flat(mlp.backward(layers, inputs, mlp.list_loss(logits, positive)[2], masks))
    step = 1e-6
    for i in range(len(weights)):
        ahead, behind = weights.copy(), weights.copy()
        ahead[i] += step
        behind[i] -= step
        assert gradient[i] == pytest.approx((loss(ahead)[0] - loss(behind)[0]) / (2 * step), abs=1e-6)
    p = np.exp(logits) / np.exp(logits).sum()
    assert loss(weights)[:2] == pytest.approx((-np.log(p[positive].sum()), p[positive].sum()))


def test_dropout_depends_on_seed_query_and_epoch_alone():
    mask = mlp.dropped(-7, 3, 1, (200, 50), 0.25, 9)
    assert (mask == mlp.dropped(-7, 3, 1, (200, 50), 0.25, 9)).all()
    assert set(np.unique(mask)) == {0.0, 1 / 0.75} and abs((mask > 0).mean() - 0.75) < 0.02
    for other in ((-8, 3, 1), (-7, 4, 1), (-7, 3, 0)):
        assert (mask != mlp.dropped(*other, (200, 50), 0.25, 9)).any()


def test_adamw_decays_apart_from_the_gradient():
    rule, w = mlp.AdamW(2, 0.1, 0.5), np.array([1.0, -2.0])
    # The first step has the sign of the gradient, whatever its size.
    assert rule.step(w, np.array([3.0, 0.0])) == pytest.approx([0.95 - 0.1, -1.9])


def test_features_are_those_of_the_columns(spark):
    options = dict(abs_diff=True, product=True, sq_diff=True, raw=True)
    q, p, extra = [0.5, -1.0], [[2.0, 0.25], [0.0, 1.0]], [7.0]
    rows = spark.createDataFrame([(q, v, extra) for v in p], "q array<double>, p array<double>, e array<double>")
    want = [r[0] for r in rows.select(pair_features(F.col("q"), F.col("p"), extra=F.col("e"), **options)).collect()]
    assert mlp.pair_matrix(np.array(q), np.array(p), np.array(extra), **options).tolist() == want


def test_fit_learns_and_is_repeatable(spark, tmp_path):
    frames = data(spark)
    settings = dict(hidden=(8,), epochs=6, lr=0.03, dropout=0.1, batch_size=8, k=3, ks=(1,), alpha=0.1)
    model, history = mlp.fit_mlp(*frames, 5, **settings)
    again, same = mlp.fit_mlp(*frames, 5, **settings)
    assert history == same and all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(model["layers"], again["layers"]))
    assert history[-1]["train_loss"] < history[0]["train_loss"] * 0.8
    assert max(h["recall@3"] for h in history[1:]) > history[0]["base_recall"]
    # The saved model goes through N8 and F8 unchanged.
    listwise.save_model(spark, model, str(tmp_path / "model"))
    loaded = listwise.load_model(spark, str(tmp_path / "model"))
    records, queries, index, _ = frames
    pairs = listwise.with_vectors(records.where("split = 'val'").select("bundle_id", "product_id", "score", "positive"), queries, index)
    scored = listwise.score_pairs(pairs, loaded).collect()
    hits = {}
    for b in {r.bundle_id for r in scored}:
        mine = sorted((r for r in scored if r.bundle_id == b), key=lambda r: (-round(r.model_score + 0.1 * r.score, 9), r.product_id))
        hits[b] = sum(r.positive for r in mine[:3]) / 3
    assert max(h["recall@3"] for h in history[1:]) == pytest.approx(np.mean(list(hits.values())))
    crops = queries.select("bundle_id", F.monotonically_increasing_id().alias("crop_id"), "v", F.lit(1.0).alias("conf"))
    ranked = records.where("split = 'val'").select("bundle_id", "product_id", "score", F.lit(1).alias("rank"))
    assert listwise.learned_rerank(ranked, crops, index, loaded).count() == ranked.count()


def test_gradients_sum_over_any_partitioning(spark):
    records, queries, index, truth = data(spark)
    packed, batches = mlp.packed_lists(records, queries, index, truth, 0, 8, 1)
    assert batches == 4 and {r[0] for r in packed.select("_batch").distinct().collect()} == {-1, 0, 1, 2, 3}
    layers = mlp.initial_layers(11, (4,), 1)
    one = mlp.training_sums(packed.where("_batch >= 0").coalesce(1), layers, {}, 1, 0.2, 3)
    many = mlp.training_sums(packed.where("_batch >= 0").repartition(5), layers, {}, 1, 0.2, 3)
    assert one[1:] == pytest.approx(many[1:]) and one[0] == pytest.approx(many[0], abs=1e-7) and one[3] == 32


def test_fit_without_lists(spark):
    records, queries, index, truth = data(spark)
    model, history = mlp.fit_mlp(records.where("false"), queries, index, truth, 5, hidden=(3,), epochs=2)
    assert len(history) == 1 and history[0]["queries"] == 0 and len(model["layers"]) == 2
    model, history = mlp.fit_mlp(records.where("split = 'train'"), queries, index, truth, 5, hidden=(3,), epochs=1)
    assert len(history) == 2 and history[1]["queries"] == 0
