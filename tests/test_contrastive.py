import math
import random

import pytest

from stitchrank.operators import contrastive as c


def plain(rows, truth, scale, k, margin):
    """Losses of one batch, element by element; ``rows``: (bundle, product, q, p)."""
    n = len(rows)
    sims = [[sum(a * b for a, b in zip(q, p)) for _, _, _, p in rows] for _, _, q, _ in rows]

    def entropy(grid, hits):
        total = 0.0
        for r in range(n):
            own = hits[r] or {r}
            whole = math.log(sum(math.exp(scale * grid[r][j]) for j in range(n)))
            total -= sum(scale * grid[r][j] - whole for j in own) / len(own)
        return total / n

    hits = [{j for j in range(n) if (rows[r][0], rows[j][1]) in truth} for r in range(n)]
    back = [{j for j in range(n) if (rows[j][0], rows[r][1]) in truth} for r in range(n)]
    gaps, counted = [], 0
    for r in range(n):
        own = hits[r] or {r}
        negatives = sorted((sims[r][j] for j in range(n) if j not in own), reverse=True)[: min(k, n - 1)]
        counted += bool(negatives)
        gaps += [max(0.0, x - sum(sims[r][j] for j in own) / len(own) + margin) for x in negatives]
    columns = [[sims[j][r] for j in range(n)] for r in range(n)]
    return entropy(sims, hits), entropy(columns, back), sum(gaps) / len(gaps) if gaps else 0.0, counted


@pytest.mark.parametrize("batch_size", [1, 7, 100])
def test_losses_equal_a_plain_version(spark, batch_size):
    rng = random.Random(5)
    q = {f"b{i}": [rng.gauss(0, 1) for _ in range(4)] for i in range(12)}
    p = {f"p{i}": [rng.gauss(0, 1) for _ in range(4)] for i in range(9)}
    pairs = [(b, x) for b in q for x in p if rng.random() < 0.3 or b == "b0"]
    truth = {pair for pair in pairs if rng.random() < 0.8} | {("b1", "p1"), ("none", "p1")}
    frame = spark.createDataFrame([*pairs, pairs[0], ("b1", "no vector"), ("no vector", "p1")], "bundle_id string, product_id string").repartition(3)
    queries = spark.createDataFrame(list(q.items()), "bundle_id string, v array<double>")
    index = spark.createDataFrame(list(p.items()), "product_id string, v array<double>")
    facts = spark.createDataFrame([*truth, *truth], "bundle_id string, product_id string")
    dealt = {}
    known = frame.where("bundle_id <> 'no vector' and product_id <> 'no vector'")
    for r in c.deal_batches(known, batch_size, 3).collect():
        dealt.setdefault(r.batch, {})[r.row] = (r.bundle_id, r.product_id, q[r.bundle_id], p[r.product_id])
    assert sum(map(len, dealt.values())) == len(pairs) and max(map(len, dealt.values())) <= batch_size
    got = {r.batch: r for r in c.batch_losses(frame, queries, index, facts, batch_size, 3, scale=2.0, top_k=3, margin=0.4).collect()}
    assert got.keys() == dealt.keys()
    for batch, rows in dealt.items():
        want = plain([rows[i] for i in range(len(rows))], truth, 2.0, 3, 0.4)
        assert tuple(got[batch])[1:] == pytest.approx((len(rows), *want))
    if batch_size == 1:
        assert all(r.hard_loss == 0.0 and r.hard_rows == 0 for r in got.values())


def test_no_negatives_and_no_pairs(spark):
    pairs = spark.createDataFrame([("b", "x"), ("b", "y")], "bundle_id string, product_id string")
    queries = spark.createDataFrame([("b", [1.0, 0.0])], "bundle_id string, v array<double>")
    index = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "product_id string, v array<double>")
    (row,) = c.batch_losses(pairs, queries, index, pairs).collect()
    assert (row.hard_loss, row.hard_rows) == (0.0, 0)
    assert c.batch_losses(pairs.where("false"), queries, index, pairs).count() == 0


def test_another_seed_deals_otherwise(spark):
    pairs = spark.createDataFrame([(f"b{i}", "p") for i in range(40)], "bundle_id string, product_id string")
    deals = [{(r.bundle_id, r.batch, r.row) for r in c.deal_batches(pairs, 10, seed).collect()} for seed in (1, 1, 2)]
    assert deals[0] == deals[1] != deals[2]
