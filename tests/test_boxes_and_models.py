"""Boxes, vector means, learned scorers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stitchrank.operators import boxes, embeddings, listwise, splits

BOX = "bundle_id string, box_id bigint, x1 int, y1 int, x2 int, y2 int, conf double"


def overlap(a, b):
    w = max(0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return w * h / (area(a) + area(b) - w * h)


def test_nms_goes_on_past_a_crowded_band(spark):
    rng = random.Random(5)
    rows = []
    for image, n in (("crowd", 120), ("few", 6), ("none", 0)):
        for i in range(n):
            x, y = rng.randrange(60), rng.randrange(60)
            rows.append((image, i, x, y, x + rng.randrange(10, 60), y + rng.randrange(10, 60), round(rng.random(), 2)))
    frame = spark.createDataFrame(rows, BOX)
    got = {}
    for r in boxes.nms(frame, iou=0.2, max_boxes=10, min_score=0.1, band=4).orderBy("rank").collect():
        got.setdefault(r["bundle_id"], []).append(r["box_id"])
    for image in ("crowd", "few"):
        kept = []
        for r in sorted((r for r in rows if r[0] == image and r[6] >= 0.1), key=lambda r: (-r[6], r[1])):
            if len(kept) < 10 and all(overlap(r[2:6], k[2:6]) < 0.2 for k in kept):
                kept.append(r)
        assert got[image] == [k[1] for k in kept]
    assert set(got) == {"crowd", "few"}


@pytest.mark.parametrize("iou", [0.2, 1.5])
def test_nms_bands_agree_on_empty_boxes(spark, iou):
    rng = random.Random(6)
    rows = [("a", i, 5, 5, 5, 5, 0.5) for i in range(5)]
    for i in range(5, 40):
        x, y = rng.randrange(60), rng.randrange(60)
        rows.append(("a", i, x, y, x + rng.choice((0, 20)), y + 30, round(rng.random(), 2)))
    frame = spark.createDataFrame(rows, BOX)
    found = [[r["box_id"] for r in boxes.nms(frame, iou=iou, max_boxes=9, min_score=0.1, band=b).orderBy("rank").collect()] for b in (2, 7, 256)]
    assert found[0] == found[1] == found[2] and len(set(found[0])) == 9


def test_sanitize_rounds_half_even_and_clips(spark):
    rows = [("a", 1, 0.5, -3.0, 10.5, 20.0, 0.9, 0), ("a", 2, 5.0, 5.0, 5.4, 9.0, 0.8, 9), ("a", 3, 0.0, 0.0, 200.0, 200.0, 0.7, 9)]
    frame = spark.createDataFrame(rows, "bundle_id string, box_id int, x1 double, y1 double, x2 double, y2 double, conf double, cls_id int")
    got = boxes.sanitize_boxes(frame.withColumns({"width": F.lit(100), "height": F.lit(100)}), class_names={0: "shoes"}).orderBy("place").collect()
    assert [(r["x1"], r["y1"], r["x2"], r["y2"], r["cls"]) for r in got] == [(0, 0, 10, 20, "shoes"), (0, 0, 100, 100, "clothing")]


def test_pad_falls_back(spark):
    frame = spark.createDataFrame([("a", 1, 200, 10, 240, 20, 1.0)], BOX).withColumns({"width": F.lit(100), "height": F.lit(100)})
    kept = boxes.pad_box(frame).first()
    assert (kept["x1"], kept["x2"]) == (200, 240)  # outside the image: the box itself
    full = boxes.pad_box(frame, mode="trunc").first()
    assert (full["x1"], full["x2"]) == (99, 100)  # a crop clamps to the last column


def test_box_features_are_zero_without_boxes(spark):
    bundles = spark.createDataFrame([("a", 10, 10), ("b", 10, 10), ("c", 1, 10)], "bundle_id string, width int, height int")
    frame = spark.createDataFrame([("a", 1, 0, 0, 5, 10, 0.5), ("c", 1, 0, 0, 5, 10, 0.5)], BOX)
    got = {r["bundle_id"]: tuple(r)[1:] for r in boxes.box_features(bundles, frame).collect()}
    assert got["b"] == got["c"] == (0.0,) * 8
    assert got["a"] == pytest.approx((np.log(2), 0.5, 0.5, 0.5, 0.5, 0.5, 0.25, 0.5))


def test_weighted_vector_drops_what_cancels(spark):
    rows = [("a", [1.0, 0.0], 0.0), ("a", [0.0, 1.0], 0.3), ("z", [1.0, 0.0], 0.5), ("z", [-1.0, 0.0], 0.5)]
    got = embeddings.weighted_bundle_vector(spark.createDataFrame(rows, "bundle_id string, v array<float>, conf double")).collect()
    assert [r["bundle_id"] for r in got] == ["a"] and got[0]["n_crops"] == 2
    assert got[0]["v"] == pytest.approx([0.1 / np.hypot(0.1, 0.3), 0.3 / np.hypot(0.1, 0.3)])


def test_fit_width(spark):
    frame = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1.0],), (None,)], "f array<double>")
    assert [r[0] for r in frame.select(embeddings.fit_width(F.col("f"), 2)).collect()] == [[1.0, 2.0], [1.0, 0.0], [0.0, 0.0]]


def test_mlp_scores_match_numpy(spark, tmp_path):
    rng = np.random.default_rng(0)
    dim, width = 3, 7
    model = listwise.make_model([(rng.normal(size=(width, 5)), rng.normal(size=5)), (rng.normal(size=(5, 1)), rng.normal(size=1))], dim)
    q, p = rng.normal(size=(9, dim)), rng.normal(size=(9, dim))
    pairs = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(q, p))], "i int, q array<double>, p array<double>")
    x = np.hstack([(q * p).sum(1, keepdims=True), abs(q - p), q * p])
    (w1, b1), (w2, b2) = model["layers"]
    want = (np.maximum(x @ w1 + b1, 0) @ w2 + b2)[:, 0]
    listwise.save_model(spark, model, str(tmp_path / "model"))
    for m in (model, listwise.load_model(spark, str(tmp_path / "model"))):
        got = {r["i"]: r["model_score"] for r in listwise.score_pairs(pairs, m).collect()}
        assert [got[i] for i in range(9)] == pytest.approx(want.tolist())
    with pytest.raises(ValueError, match="layer"):
        listwise.make_model([(np.zeros((4, 1)), np.zeros(1))], dim)


def test_learned_rerank_keeps_lists_without_a_vector(spark):
    schema = "bundle_id string, product_id string, score double"
    ranked = spark.createDataFrame([("a", "p", 0.9), ("a", "q", 0.8), ("a", "lost", 0.7), ("dark", "p", 0.4)], schema)
    crops = spark.createDataFrame([("a", [1.0, 0.0], 1.0)], "bundle_id string, v array<float>, conf double")
    index = spark.createDataFrame([("p", [0.0, 1.0]), ("q", [1.0, 0.0])], "product_id string, v array<float>")
    model = listwise.make_model([(np.eye(5)[:, :1], np.zeros(1))], 2)
    got = listwise.learned_rerank(ranked, crops, index, model, alpha=0.0).orderBy("bundle_id", "rank").collect()
    assert [(r["bundle_id"], r["product_id"]) for r in got] == [("a", "q"), ("a", "p"), ("a", "lost"), ("dark", "p")]
    assert got[2]["score"] == -1e9 and got[3]["score"] == 0.4


def test_listwise_loss(spark):
    frame = spark.createDataFrame([([1.0, 2.0, 3.0], [True, False, True])], "s array<double>, m array<boolean>")
    got = frame.select(listwise.listwise_loss(F.col("s"), F.col("m")).alias("l")).first()["l"]
    share = (np.exp(1) + np.exp(3)) / np.exp([1, 2, 3]).sum()
    assert (got["loss"], got["pos_prob"]) == pytest.approx((-np.log(share), share))


def test_fit_linear_lowers_the_loss(spark):
    rng = np.random.default_rng(2)
    dim = 4
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    q, p = unit(rng.normal(size=(30, dim))), unit(rng.normal(size=(20, dim)))
    # positives agree with the query on the first coordinate, which plain cosine does not single out
    cand, truth = [], []
    for i in range(30):
        good = set(np.argsort(-(q[i, 0] * p[:, 0]))[:3].tolist())
        truth += [(f"b{i}", f"p{j}") for j in good]
        cand += [(f"b{i}", f"p{j}", float(q[i] @ p[j]), j in good, "val" if i >= 24 else "train") for j in range(20)]
    records = spark.createDataFrame(cand, "bundle_id string, product_id string, score double, positive boolean, split string")
    queries = spark.createDataFrame([(f"b{i}", v.tolist()) for i, v in enumerate(q)], "bundle_id string, v array<double>")
    index = spark.createDataFrame([(f"p{i}", v.tolist()) for i, v in enumerate(p)], "product_id string, v array<double>")
    pairs = spark.createDataFrame(truth, "bundle_id string, product_id string")
    model, history = listwise.fit_linear(records, queries, index, pairs, dim, epochs=8, lr=0.3, k=3)
    assert history[-1]["train_loss"] < history[0]["train_loss"] * 0.8
    assert max(h["recall@3"] for h in history) > history[0]["recall@3"]
    assert len(model["layers"]) == 1


def test_query_features_go_from_training_to_rerank(spark, tmp_path):
    rng = np.random.default_rng(4)
    queries = spark.createDataFrame([(f"b{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(12, 2)))], "bundle_id string, v array<double>")
    index = spark.createDataFrame([(f"p{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(5, 2)))], "product_id string, v array<double>")
    cand = [(f"b{i}", f"p{j}", float(j), j == i % 5, "val" if i > 8 else "train") for i in range(12) for j in range(5)]
    records = spark.createDataFrame(cand, "bundle_id string, product_id string, score double, positive boolean, split string")
    raw = spark.createDataFrame([(f"b{i}", float(10 * i), 3.0) for i in range(12)], "bundle_id string, boxes double, flat double")
    truth = records.filter("positive").select("bundle_id", "product_id")
    model, history = listwise.fit_linear(records, queries, index, truth, 2, epochs=2, k=2, ks=(1, 5), query_features=raw)
    assert model["extra_dim"] == 2 and model["scale"]["names"] == ["boxes", "flat"]
    assert model["scale"]["mean"] == pytest.approx([40.0, 3.0]) and model["scale"]["std"] == pytest.approx([np.std(10.0 * np.arange(9)), 1.0])
    assert history[0]["recall@5"] == history[0]["hit@5"] == 1.0 and 0 < history[0]["mrr"] <= 1 and history[0]["hit@1"] <= history[0]["hit@2"]
    listwise.save_model(spark, model, str(tmp_path / "m"))
    assert listwise.load_model(spark, str(tmp_path / "m"))["scale"] == model["scale"]
    crops = queries.withColumn("conf", F.lit(1.0))
    with pytest.raises(ValueError, match="query features"):
        listwise.learned_rerank(records, crops, index, model)
    assert listwise.learned_rerank(records, crops, index, model, features=raw.limit(3)).count() == 60


def test_listwise_losses_of_long_lists(spark):
    scores = np.linspace(500, 900, 300)
    frame = spark.createDataFrame([("a", f"p{i}", float(x), i % 7 == 0) for i, x in enumerate(scores)], "bundle_id string, product_id string, score double, positive boolean")
    got = listwise.listwise_losses(frame).first()
    w = np.exp(scores - scores.max())
    assert got["pos_prob"] == pytest.approx(w[::7].sum() / w.sum()) and got["loss"] == pytest.approx(-np.log(w[::7].sum() / w.sum()))


def test_n5_truth_must_be_indexed(spark):
    cand = spark.createDataFrame([("a", "x", 1.0)], "bundle_id string, product_id string, score double")
    truth = spark.createDataFrame([("a", "x")], "bundle_id string, product_id string")
    assert splits.listwise_records(cand, truth)[0].count() == 0  # all positive
