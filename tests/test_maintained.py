import random

import pytest

from stitchrank.operators.retrieve import topk
from stitchrank.sources.maintained import MaintainedLists

Q, P = "query_id string, v array<double>", "product_id string, v array<double>"


def vector(rng):
    return [rng.choice((-1.0, -0.5, 0.0, 0.5, 1.0)) for _ in range(4)]


def whole(spark, queries, products, k):
    """Lists by a search from nothing."""
    q = spark.createDataFrame([(i, v) for i, v in queries.items()], Q)
    p = spark.createDataFrame([(i, v) for i, v in products.items()], P)
    return sorted((r.query_id, r["rank"], r.product_id, r.score) for r in topk(q, p, k).collect())


def now(lists):
    return sorted((r.query_id, r["rank"], r.product_id, r.score) for r in lists.lists().collect())


@pytest.mark.parametrize("k", [4, 30])
def test_lists_equal_a_new_search_after_every_change(spark, tmp_path, k):
    rng = random.Random(k)
    queries, products = {f"q{i}": vector(rng) for i in range(20)}, {f"p{i:02d}": vector(rng) for i in range(25)}
    lists = MaintainedLists.create(spark, str(tmp_path / "lists"), spark.createDataFrame(list(queries.items()), Q), spark.createDataFrame(list(products.items()), P), k)
    assert now(lists) == whole(spark, queries, products, k)
    steps = [
        ({"p30": vector(rng), "p31": vector(rng)}, {}),  # added
        ({"p03": None, "p30": None, "gone": None}, {}),  # deleted, one never there
        ({"p04": vector(rng), "p05": vector(rng), "p03": vector(rng)}, {"q5": vector(rng), "q90": vector(rng)}),  # replaced, back again; queries
        ({}, {}),
        ({p: None for p in products}, {}),  # nearly all gone
    ]
    for changes, asked in steps:
        report = lists.apply(
            spark.createDataFrame(list(changes.items()), P) if changes else None, spark.createDataFrame(list(asked.items()), Q) if asked else None
        )
        queries |= asked
        products = {p: v for p, v in (products | changes).items() if v is not None}
        assert now(lists) == whole(spark, queries, products, k)
        assert report["scored"] <= report["all_pairs"] + report["changed"] * len(queries)
    small = lists.compact(str(tmp_path / "small"))
    assert now(small) == now(lists) and small.version() == 0
    assert MaintainedLists(spark, str(tmp_path / "lists")).version() == 5


def test_few_pairs_for_few_changes(spark, tmp_path):
    rng = random.Random(1)
    queries = spark.createDataFrame([(f"q{i}", [rng.gauss(0, 1) for _ in range(6)]) for i in range(100)], Q)
    products = spark.createDataFrame([(f"p{i:03d}", [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)], P)
    lists = MaintainedLists.create(spark, str(tmp_path / "lists"), queries, products, 5)
    report = lists.apply(spark.createDataFrame([("p000", None), ("p001", [0.1] * 6), ("new", [0.2] * 6)], P))
    assert report["searched"] < 20 and report["scored"] < report["all_pairs"] / 4
    logged = lists.log().where("version = 1").first()
    assert (logged.scored, logged.lists) == (report["scored"], report["lists"])


def test_a_failed_version_leaves_the_one_before(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    queries, products = {f"q{i}": vector(rng) for i in range(6)}, {f"p{i}": vector(rng) for i in range(9)}
    lists = MaintainedLists.create(spark, str(tmp_path / "lists"), spark.createDataFrame(list(queries.items()), Q), spark.createDataFrame(list(products.items()), P), 3)
    before = now(lists)
    with monkeypatch.context() as patch:
        patch.setattr(MaintainedLists, "_commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            lists.apply(spark.createDataFrame([("p1", None), ("x", [1.0] * 4)], P))
    assert now(lists) == before and lists.version() == 0
    lists.apply(spark.createDataFrame([("p2", None)], P))
    del products["p2"]
    assert now(lists) == whole(spark, queries, products, 3)
    with pytest.raises(ValueError):
        lists.apply(spark.createDataFrame([("p1", None), ("p1", [1.0] * 4)], P))
    with pytest.raises(ValueError):
        lists.apply(spark.createDataFrame([(None, [1.0] * 4)], P))
