"""Caps, padding, ensembles, metrics and splits on small lists."""

import random

import pytest
from pyspark.sql import functions as F

from stitchrank.operators import catalog, ensemble, evaluate, rank, splits
from stitchrank.plans import recommend

LIST = "bundle_id string, product_id string, score double"


def ranked(spark, *scored):
    return spark.createDataFrame([("b", p, float(s)) for p, s in scored], LIST)


def order(df):
    return [r["product_id"] for r in df.orderBy("bundle_id", "rank").collect()]


def by_bundle(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["bundle_id"], []).append(r["product_id"])
    return out


def test_category_cap_and_backfill(spark):
    r = ranked(spark, ("a", 9), ("b", 8), ("c", 7), ("d", 6), ("e", 5), ("f", 4))
    desc = spark.createDataFrame([(p, c) for p, c in zip("abcdef", ["X", "x ", "X", None, "Y", ""])], "product_id string, description string")
    assert order(rank.top_n(rank.category_cap(r, 2, desc), 9)) == ["a", "b", "d", "e", "f"]
    assert rank.category_cap(r, 0, desc).count() == 6
    assert order(rank.category_cap_backfill(r, 1, 5, desc)) == ["a", "d", "e", "f", "b"]  # appended, not re-sorted
    assert order(rank.category_cap_backfill(r, 1, 6, desc)) == ["a", "d", "e", "f", "b", "c"]


def test_section_filter(spark):
    r = ranked(spark, ("a", 3), ("b", 2), ("c", 1))
    products = spark.createDataFrame([("a", 1), ("b", 2), ("c", 0)], "product_id string, gender int")
    for section, want in ((2, {"b", "c"}), (0, {"a", "b", "c"}), (None, {"a", "b", "c"})):
        bundles = spark.createDataFrame([("b", section)], "bundle_id string, section int")
        assert {x["product_id"] for x in rank.section_filter(r, bundles, products).collect()} == want


def test_ties_go_to_the_lower_id(spark):
    assert order(rank.top_n(ranked(spark, ("z", 1), ("a", 1), ("m", 1)), 2)) == ["a", "m"]


def test_pad_skips_what_is_there(spark):
    held = spark.createDataFrame([("b", "p1", 1), ("b", "f2", 2)], "bundle_id string, product_id string, rank int")
    fallback = spark.createDataFrame([(f"f{i}", i) for i in range(1, 9)], "product_id string, position int")
    bundles = spark.createDataFrame([("b",), ("empty",)], "bundle_id string")
    got = rank.pad(held, bundles, fallback, 4)
    assert order(got.filter("bundle_id = 'b'")) == ["p1", "f2", "f1", "f3"]
    assert order(got.filter("bundle_id = 'empty'")) == ["f1", "f2", "f3", "f4"]


def test_hubness(spark):
    rows = [(f"b{i}", "hub", 1.0) for i in range(4)] + [("b0", "rare", 0.99)]
    got = {(r["bundle_id"], r["product_id"]): r["score"] for r in rank.hubness(spark.createDataFrame(rows, LIST), 0.5, 0.1).collect()}
    assert got["b0", "hub"] == pytest.approx(0.95) and got["b0", "rare"] == pytest.approx(0.99)


def test_zscore_of_equal_scores_is_zero(spark):
    assert {r["z"] for r in rank.zscore(ranked(spark, ("a", 2), ("b", 2))).collect()} == {0.0}


def test_rrf_counts_repeats_and_keeps_first_seen_order(spark):
    rows = [(1, "b", "p", 1), (1, "b", "q", 2), (1, "b", "p", 3), (2, "b", "q", 1), (2, "b", "r", 3), (2, "x", "p", 1)]
    subs = spark.createDataFrame(rows, "submission int, bundle_id string, product_id string, rank int")
    got = ensemble.rrf(subs, top=3)
    assert order(got) == ["q", "p", "r"] and got.filter("bundle_id = 'x'").count() == 0
    tied = spark.createDataFrame([(1, "b", "z", 1), (2, "b", "a", 1)], subs.schema)
    assert order(ensemble.rrf(tied)) == ["z", "a"]
    assert order(ensemble.rrf(tied.repartition(3))) == ["z", "a"]


def on_grid(value):
    return round(value * 2**30) / 2**30


def repaired(base, matches, score, guard):
    """The repair one product after the other."""
    slots = list(base)
    for m in matches:
        if m in slots:
            continue
        weakest = min(range(len(slots)), key=lambda i: (score.get(slots[i], 0), i))
        if guard is None or score.get(slots[weakest], 0) <= guard:
            slots[weakest] = m
    return slots


@pytest.mark.parametrize("seed", [1, 2])
def test_article_repair_matches_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    products = [(f"p{i:02d}", f"h/{rng.choice('abc')}-e1.jpg") for i in range(40)]
    bundles = [(f"b{i}", f"h/{rng.choice('abcd')}-p.jpg") for i in range(25)]
    names = [p for p, _ in products]
    subs = []
    for b, _ in bundles:
        for s in range(1, 4):
            subs += [(s, b, p, i + 1) for i, p in enumerate(rng.sample(names, 6))]
    frame = spark.createDataFrame(subs, "submission int, bundle_id string, product_id string, rank int")
    p = spark.createDataFrame(products, "product_id string, image_url string")
    b = spark.createDataFrame(bundles, "bundle_id string, image_url string")
    base = frame.filter("submission = 3").drop("submission")
    votes, rrf = {}, {}
    for s, bundle, product, r in subs:
        votes.setdefault(bundle, {}).setdefault(product, 0)
        votes[bundle][product] += 1
        rrf.setdefault(bundle, {}).setdefault(product, 0.0)
        rrf[bundle][product] = rrf[bundle][product] + s / 6 / (60 + r)
    weights = spark.createDataFrame([(s, s / 6) for s in (1, 2, 3)], "submission int, weight double")
    by_votes = by_bundle(ensemble.article_repair_votes(base, b, p, catalog.votes(frame), max_votes=1))
    by_rrf = by_bundle(ensemble.article_repair_rrf(base, b, p, ensemble.weighted_rrf(frame, weights)))
    for bundle, url in bundles:
        start = [x for s, bb, x, _ in subs if s == 3 and bb == bundle]
        matches = sorted(x for x, u in products if u.split("/")[1].split("-")[0] == url.split("/")[1].split("-")[0])
        assert by_votes[bundle] == repaired(start, matches, votes[bundle], 1)
        slots = repaired(start, matches, {k: on_grid(v) for k, v in rrf[bundle].items()}, None)
        want = [x for x in slots if x in matches] + sorted(
            (x for x in slots if x not in matches), key=lambda x: -on_grid(rrf[bundle].get(x, 0))
        )
        assert by_rrf[bundle] == want


def test_repair_reads_lists_and_scores_in_one_pass(spark):
    rng = random.Random(3)
    rows = [(s, float(s), f"b{i}", f"p{rng.randrange(30):02d}", r + 1) for i in range(20) for s in (1, 2, 3) for r in range(18)]  # products repeat
    subs = spark.createDataFrame(rows, "submission int, quality double, bundle_id string, product_id string, rank int")
    p = spark.createDataFrame([(f"p{i:02d}", f"h/{'abc'[i % 3]}-e1.jpg") for i in range(40)], "product_id string, image_url string")
    b = spark.createDataFrame([(f"b{i}", f"h/{'abcd'[i % 4]}-p.jpg") for i in range(20)], "bundle_id string, image_url string")
    weights = ensemble.submission_weights(subs.select("submission", "quality").distinct())
    found = recommend.ensemble_rrf(subs, b, p)
    want = ensemble.article_repair_rrf(recommend.best_submission(subs), b, p, ensemble.weighted_rrf(subs, weights))
    columns = ["bundle_id", "rank", "product_id", "score", "is_match"]
    assert sorted(found.select(columns).collect()) == sorted(want.select(columns).collect())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan


def metric(df, name, k):
    return df.filter((F.col("metric") == name) & (F.col("k") == k)).first()["value"]


def test_metrics_scopes_and_repeats(spark):
    lists = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", "n", 3)], "bundle_id string, product_id string, rank int")
    truth = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "bundle_id string, product_id string")
    every = evaluate.hit_recall(lists, truth, [1, 2, 0])
    assert metric(every, "hit", 2) == 0.5 and metric(every, "recall", 2) == 0.5  # a repeat counts again
    only = evaluate.hit_recall(lists, truth, [1], scope="predicted")
    assert metric(only, "hit", 1) == 1.0 and metric(only, "num_bundles_evaluated", 0) == 1
    index = spark.createDataFrame([("x",), ("z",)], "product_id string")
    m3 = evaluate.ranking_metrics(lists, truth, index, [2])
    assert metric(m3, "mrr", 2) == 0.5 and metric(m3, "queries", 0) == 2
    with pytest.raises(ValueError):
        evaluate.hit_recall(lists, truth, [0])
    nothing = evaluate.ranking_metrics(lists, truth.filter("false"), index, [2])
    assert metric(nothing, "mrr", 2) == 0.0


def test_stratified_shortfall_goes_to_the_largest_remainder(spark):
    strata = spark.createDataFrame([(1, 19), (2, 19), (3, 19), (4, 9), (5, 4)], "stratum int, n bigint")
    got = {r["stratum"]: r["n_val"] for r in splits.allocate(strata, 0.1).collect()}
    # 70 rows, target 7, floors 1 + 1 + 1 + 0 + 0: four slots left, all fit the first stratum with remainder 0.9
    assert got == {1: 5, 2: 1, 3: 1, 4: 0, 5: 0}
    tight = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 10)], "stratum int, n bigint")
    got = {r["stratum"]: r["n_val"] for r in splits.allocate(tight, 0.6).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 6}


def test_splits_are_disjoint_and_sized(spark):
    links = spark.createDataFrame([(f"b{i % 30}", f"p{i}") for i in range(90)], "bundle_id string, product_id string")
    pairs = splits.split_pairs(links, 0.25)
    sides = {r["bundle_id"]: set() for r in pairs.collect()}
    for r in pairs.collect():
        sides[r["bundle_id"]].add(r["split"])
    assert pairs.count() == 90 and all(len(s) == 1 for s in sides.values())
    assert sum(s == {"val"} for s in sides.values()) == 8  # 7.5 rounds to the even 8
    one = links.filter("bundle_id = 'b0'")
    assert {r["split"] for r in splits.split_pairs(one, 0.5).collect()} == {"train"}
    assert {r["split"] for r in splits.split_ids(one.select("bundle_id"), 0.5).collect()} == {"train"}
    assert splits.val_ids(links.select("bundle_id"), 0.0).count() == 0
    assert splits.val_ids(links.select("bundle_id"), 0.001).count() == 1
    assert splits.split_ids(links.select("bundle_id"), 0.999).filter("split = 'train'").count() == 1


def test_listwise_records_drop_reasons(spark):
    cand = spark.createDataFrame(
        [(b, p, 0.5, r) for b in ("some", "all", "none", "blind") for r, p in enumerate(("x", "y"), 1)],
        "bundle_id string, product_id string, score double, rank int",
    )
    truth = spark.createDataFrame([("some", "x"), ("all", "x"), ("all", "y"), ("none", "q")], "bundle_id string, product_id string")
    records, counts = splits.listwise_records(cand, truth)
    assert {r["bundle_id"] for r in records.collect()} == {"some"} and records.filter("positive").count() == 1
    assert {r["reason"]: r["queries"] for r in counts.collect()} == {"usable": 1, "all_positive": 1, "no_positive": 1, "no_truth": 1}
