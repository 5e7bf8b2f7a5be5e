"""The search kernel, its blocks and the packs of the cell search."""

import numpy as np
import pytest

from stitchrank.operators import cells, nearest


def test_blocks_do_not_grow_with_the_rows():
    assert nearest.blocks(500, 200, 300) == 3
    # 100,000 rows in blocks of 200: copies of the other side stay bounded
    assert nearest.blocks(100_000, 200, 300) == nearest.BLOCKS
    assert nearest.blocks(10**8, 200, 300) * nearest.BLOCK_BYTES >= 10**8 * 300


@pytest.mark.parametrize("scale", [1.0, 1e20])
def test_lists_equal_a_full_sort(scale):
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (700, 4)) * scale  # many ties
    q = rng.integers(-2, 3, (30, 4)).astype(float)
    lists = nearest.lists_of(9, 9)(q)
    for a in range(0, 700, 64):
        lists.add(x[a : a + 64], np.arange(a, min(700, a + 64)))
    row, number, score, rank = lists.best()
    for i in range(30):
        s = np.round(q[i] @ x.T, 9)
        want = np.lexsort((np.arange(700), -s))[:9]
        assert number[row == i].tolist() == want.tolist() and score[row == i].tolist() == s[want].tolist()
        assert rank[row == i].tolist() == list(range(1, 10))


def test_visits_of_a_search_without_clusters_are_one_row_per_query_and_pack(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 8))
    index = spark.createDataFrame([(f"p{i}", v.tolist()) for i, v in enumerate(x)], "product_id string, v array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:100])], "query int, v array<double>")
    stored, kept = cells.build_cells(index, cell_rows=4), []
    plain = cells.checkpointed
    monkeypatch.setattr(cells, "checkpointed", lambda df: kept.append(plain(df)) or kept[-1])
    _, report = cells.pruned_topk(asked, stored, 5)
    most = max(df.count() for df in kept)
    # it used to keep a row per query and block
    assert most <= 100 * (nearest.BLOCKS + 1) < max(r.visits for r in report.collect())
