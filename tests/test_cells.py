import numpy as np
import pytest

from stitchrank.operators import cells, retrieve


def rows_of(df):
    return sorted((r.query, r.product_id, r.score, r["rank"]) for r in df.collect())


def frames(spark, x, q, sections=None):
    index = [(f"p{i:04d}", [float(a) for a in v], None if sections is None else sections[i % len(sections)], i) for i, v in enumerate(x)]
    asked = [(i if i % 7 else None, i, [float(a) for a in v], None if sections is None else sections[i % len(sections)]) for i, v in enumerate(q)]
    return (
        spark.createDataFrame(asked, "id int, query int, v array<double>, s string").repartition(3),
        spark.createDataFrame(index, "product_id string, v array<double>, s string, n int").repartition(3),
    )


def clusters(n, spread=0.05, dim=8, of=12, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(of, dim))
    x = centers[rng.integers(0, of, n)] + spread * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("sections", [None, ["a", "b", None]])
def test_lists_equal_those_of_the_whole_scan(spark, sections):
    rng = np.random.default_rng(3)
    # clusters, a third copies of one vector, zeros, and norms far from one
    x = np.concatenate([clusters(300), np.repeat(clusters(1), 150, axis=0), np.zeros((3, 8)), 5 * rng.normal(size=(30, 8))])
    q = np.concatenate([clusters(40, seed=2), np.zeros((1, 8)), rng.normal(size=(10, 8)), x[310:312]])
    queries, index = frames(spark, x, q, sections)
    by = None if sections is None else "s"
    if by is None:
        queries, index = queries.drop("s"), index.drop("s")
    stored = cells.build_cells(index, by=by, cell_rows=16)
    for k in (1, 10, 10_000):
        found, report = cells.pruned_topk(queries, stored, k, query_rows=8)
        assert rows_of(found) == rows_of(retrieve.topk(queries, index, k, by=by))
        assert all(r.pairs <= r.all_pairs for r in report.collect())
    assert rows_of(retrieve.topk(queries, stored, 10, by=by)) == rows_of(retrieve.topk(queries, index, 10, by=by))
    if by is None:
        texts = index.selectExpr("product_id", "concat('d', n) as description")
        one = [retrieve.lookup_products(queries, i, texts, 4).collect() for i in (stored, index)]
        assert sorted(map(str, one[0])) == sorted(map(str, one[1]))
    # no block holds more than twice the rows asked for
    assert stored.blocks.agg({"rows": "max"}).first()[0] <= 48


def test_clusters_are_left_out(spark):
    queries, index = frames(spark, clusters(3000), clusters(200, seed=1))
    stored = cells.build_cells(index.drop("s"), cell_rows=32)
    found, report = cells.pruned_topk(queries.drop("s"), stored, 10)
    assert rows_of(found) == rows_of(retrieve.topk(queries.drop("s"), index.drop("s"), 10))
    rounds = report.collect()
    assert [r.round for r in sorted(rounds)] == [0, 1, 2] and rounds[0].all_pairs == 200 * 3000
    assert sum(r.pairs for r in rounds) < rounds[0].all_pairs / 3


def test_empty_sides_and_bad_input(spark):
    queries, index = frames(spark, clusters(20), clusters(4))
    queries, index = queries.drop("s"), index.drop("s")
    none = cells.build_cells(index.where("false"))
    assert cells.pruned_topk(queries, none, 3)[0].count() == 0
    stored = cells.build_cells(index)
    assert cells.pruned_topk(queries.where("false"), stored, 3)[0].count() == 0
    with pytest.raises(ValueError):
        cells.pruned_topk(queries, stored, 0)
    with pytest.raises(ValueError):
        retrieve.topk(queries, stored, 3, by="s")
    with pytest.raises(ValueError):
        cells.build_cells(index.unionByName(spark.createDataFrame([("x", [1.0], 1)], "product_id string, v array<double>, n int")))
