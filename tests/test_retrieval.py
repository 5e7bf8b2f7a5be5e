"""Exact top-k, its two plans, and the fusions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stitchrank.operators import rank, retrieve
from stitchrank.operators.scale import global_position, hash_rank


def frames(spark, n_queries=40, n_index=60, dim=4, seed=0, copies=True):
    rng = np.random.default_rng(seed)
    q, p = rng.normal(size=(n_queries, dim)), rng.normal(size=(n_index, dim))
    if copies:
        p[n_index // 3 :: 3] = p[0]  # a third of the index is one and the same vector
    queries = spark.createDataFrame([(f"b{i % 7}", i, r.tolist(), i % 3) for i, r in enumerate(q)], "bundle_id string, crop_id bigint, v array<float>, s int")
    index = spark.createDataFrame([(f"p{i:03d}", r.tolist(), i % 3) for i, r in enumerate(p)], "product_id string, v array<float>, s int")
    return queries, index, q.astype(np.float32).astype(float), p.astype(np.float32).astype(float)


def brute(q, p, k):
    out = {}
    for i, row in enumerate(np.round(q @ p.T, 9)):
        order = sorted(range(len(row)), key=lambda j: (-row[j], f"p{j:03d}"))[:k]
        out[i] = [f"p{j:03d}" for j in order]
    return out


def listed(df):
    out = {}
    for r in df.orderBy("crop_id", "rank").collect():
        out.setdefault(r["crop_id"], []).append(r["product_id"])
    return out


@pytest.mark.parametrize("k", [1, 7, 60, 100])
@pytest.mark.parametrize("plan", [{}, {"broadcast_bytes": 0, "index_block": 13, "query_block": 9}])
def test_topk_matches_brute_force_with_ties(spark, k, plan):
    queries, index, q, p = frames(spark)
    found = retrieve.topk(queries.drop("s"), index.drop("s"), k, **plan)
    assert listed(found) == brute(q, p, k)


@pytest.mark.parametrize("plan", [{}, {"broadcast_bytes": 0, "index_block": 13, "query_block": 9}])
def test_topk_by_section(spark, plan):
    queries, index, q, p = frames(spark)
    got = listed(retrieve.topk(queries, index, 5, by="s", **plan))
    for i in range(len(q)):
        pool = [j for j in range(len(p)) if j % 3 == i % 3]
        sims = np.round(p[pool] @ q[i], 9)
        order = sorted(range(len(pool)), key=lambda a: (-sims[a], pool[a]))[:5]
        assert got[i] == [f"p{pool[a]:03d}" for a in order]


def test_topk_rejects_bad_input(spark):
    queries, index, *_ = frames(spark)
    with pytest.raises(ValueError):
        retrieve.topk(queries, index, 0)
    with pytest.raises(ValueError, match="both sides"):
        retrieve.topk(queries, index, 3)
    ragged = index.drop("s").unionByName(spark.createDataFrame([("x", [1.0])], "product_id string, v array<float>"))
    with pytest.raises(ValueError, match="length"):
        retrieve.topk(queries.drop("s"), ragged, 3)


@pytest.mark.parametrize("plan", [{}, {"broadcast_bytes": 0, "index_block": 13, "query_block": 9}])
def test_topk_has_one_list_per_row(spark, plan):
    queries, index, q, p = frames(spark, n_queries=12)
    same = queries.select(F.when(F.col("crop_id") % 2 == 0, F.lit(5)).alias("crop_id"), F.col("crop_id").alias("place"), "v")
    found = retrieve.topk(same, index.drop("s"), 4, **plan).orderBy("place", "rank").collect()
    want = brute(q, p, 4)
    assert [(r["place"], r["rank"], r["product_id"]) for r in found] == [(i, j + 1, x) for i in range(12) for j, x in enumerate(want[i])]
    assert {r["crop_id"] for r in found} == {5, None}


@pytest.mark.parametrize("plan", [{}, {"broadcast_bytes": 0}])
@pytest.mark.parametrize("bad", [[1.0], [1.0, 2.0, None, 4.0]])
def test_topk_checks_query_vectors(spark, plan, bad):
    queries, index, *_ = frames(spark)
    wrong = spark.createDataFrame([(1, bad)], "crop_id bigint, v array<float>")
    with pytest.raises(Exception, match="length|NULL elements"):
        retrieve.topk(queries.select("crop_id", "v").unionByName(wrong), index.drop("s"), 3, **plan).collect()


def test_attributes_count_as_index_bytes(spark):
    _, index, *_ = frames(spark)
    wide = index.withColumn("note", F.repeat(F.lit("x"), 1000))
    assert retrieve.measured(index, 10_000).shared is not None
    assert retrieve.measured(wide, 10_000).shared is None


def test_empty_index(spark):
    queries, index, *_ = frames(spark)
    assert retrieve.topk(queries.drop("s"), index.drop("s").filter("false"), 3).count() == 0


def crops(spark, confs):
    rows = [("b", i, [1.0, float(i) / 10], c) for i, c in enumerate(confs)]
    return spark.createDataFrame(rows, "bundle_id string, crop_id bigint, v array<float>, conf double")


def test_fusions_differ_on_purpose(spark):
    index = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [0.0, 1.0])], "product_id string, v array<float>")
    c = crops(spark, [0.05, 0.9])
    top = {r["product_id"]: r["score"] for r in retrieve.retrieve_max(c, index).collect()}
    assert top["p"] == 1.0  # MAX of raw cosines
    total = {r["product_id"]: r["score"] for r in retrieve.retrieve_sum(c, index).collect()}
    assert total["p"] == pytest.approx(0.1 + 0.9)  # SUM of weighted, the weight floored at 0.1
    first = retrieve.retrieve_top1(c, index).collect()
    assert [(r["product_id"], r["score"]) for r in first] == [("p", pytest.approx(0.1))]  # first crop counts
    assert retrieve.retrieve_top1(crops(spark, [0.6]), index).count() == 0  # full-image crop skipped
    assert retrieve.retrieve_top1(crops(spark, [1.0]), index).count() == 1


def test_boosted_floor_and_article(spark):
    index = spark.createDataFrame(
        [("p", [-1.0, 0.0], "A", 0, "x"), ("q", [0.5, 0.0], "B", 0, "z")],
        "product_id string, v array<float>, category string, gender int, article string",
    )
    sections = spark.createDataFrame([("p", 1), ("q", 1), ("q", 2)], "product_id string, section int")
    categories = spark.createDataFrame([("B", [1.0, 0.0]), ("A", [0.0, 1.0])], "category string, v array<float>")
    c = crops(spark, [1.0]).withColumns({"section": F.lit(None).cast("int"), "cls": F.lit(""), "bundle_article": F.lit("z")})
    got = {r["product_id"]: r["score"] for r in retrieve.retrieve_boosted(c, index, sections, categories).collect()}
    assert got == {"q": pytest.approx(0.5 * 1.4 * 1000), "p": 0.0}


def test_global_position_and_hash_rank(spark):
    ids = spark.range(1000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("g"))
    placed = {r["k"]: r["position"] for r in global_position(ids, ["k"]).collect()}
    assert [k for k, _ in sorted(placed.items(), key=lambda kv: kv[1])] == sorted(placed)
    ranks = hash_rank(ids, "k", 7, by=["g"]).collect()
    for g in range(3):
        assert sorted(r["hash_rank"] for r in ranks if r["g"] == g) == list(range(1, len([r for r in ranks if r["g"] == g]) + 1))
    again = hash_rank(ids.repartition(7), "k", 7, by=["g"]).collect()
    assert {r["k"]: r["hash_rank"] for r in ranks} == {r["k"]: r["hash_rank"] for r in again}


def test_late_interaction_splits_a_large_bundle(spark, monkeypatch):
    monkeypatch.setattr(rank, "CROP_BLOCK", 8)
    rng = np.random.default_rng(3)
    c, p = rng.normal(size=(100, 5)), rng.normal(size=(6, 5))
    crops2 = spark.createDataFrame([("b", i, r.tolist()) for i, r in enumerate(c)], "bundle_id string, crop_id int, v array<double>")
    index2 = spark.createDataFrame([(f"p{i}", r.tolist()) for i, r in enumerate(p[:5])], "product_id string, v array<double>")
    ranked = spark.createDataFrame([("b", f"p{i}", 0.5) for i in range(6)] + [("lone", "p0", 0.2)], "bundle_id string, product_id string, score double")
    got = {(r["bundle_id"], r["product_id"]): r["score"] for r in rank.late_interaction(ranked, crops2, index2, 0.4).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    best = (unit(c) @ unit(p).T).max(axis=0)
    for i in range(5):
        assert got["b", f"p{i}"] == pytest.approx(0.3 + 0.4 * best[i], abs=1e-8)
    assert got["b", "p5"] == 0.5 and got["lone", "p0"] == pytest.approx(0.2)


def test_an_index_by_sections_is_broadcast_section_by_section(spark):
    import pyarrow as pa

    rows = [(f"p{i:03d}", None if i % 4 == 3 else i % 4, [float(i % 7), 1.0]) for i in range(200)]
    index = spark.createDataFrame(rows, "product_id string, section int, v array<float>").repartition(3)
    size = retrieve.measured(index, by="section")
    table = size.shared.value
    assert [(r["section"], r["product_id"]) for r in table.to_pylist()] == sorted(((r[1], r[0]) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    prepare, _ = retrieve._scorer(3, "section", [], ["product_id"], pa.schema([]), 2)
    prepared = prepare(table, in_order=True)
    assert prepared[0] is table  # no copy of the rows in a worker
    assert prepared[2] == {0: (0, 50), 1: (50, 100), 2: (100, 150), None: (150, 200)}
    size.release()
