"""Sources, sinks, catalogue rules, the stream, and registered queries beside their SQL."""

import glob
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from checks import compare, registry
from stitchrank.operators import alignment, catalog
from stitchrank.plans import prepare
from stitchrank.sources import sinks, tables
from stitchrank.streaming.lookup import start_lookup

SF = "/root/testdata/sf0.001"
registry.load()


def test_csv_columns_are_checked(spark, tmp_path):
    path = tmp_path / "bundles.csv"
    path.write_text("bundle_asset_id,bundle_id_section,bundle_image_url\nb1,2.0,http://h\nb2,,\n")
    got = tables.read_bundles(spark, str(path)).orderBy("bundle_id").collect()
    assert [(r["bundle_id"], r["section"], r["image_url"]) for r in got] == [("b1", 2, "http://h"), ("b2", None, None)]
    with pytest.raises(ValueError, match="product_asset_id"):
        tables.read_links(spark, str(path))


def test_manifest_lenient_and_strict(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text('{"id": "a"}\n\n   \n{"id": \n{"id": "b"}\n')
    assert tables.read_manifest(spark, str(path)).count() == 2
    with pytest.raises(Exception):
        tables.read_manifest(spark, str(path), strict=True).collect()
    with pytest.raises(ValueError):
        tables.read_manifest(spark, str(tmp_path / "m.txt"))


def test_assets_vectors_boxes(spark, tmp_path):
    (tmp_path / "img").mkdir()
    for name in ("a.jpg", "b.tar.gz", ".hid"):
        (tmp_path / "img" / name).write_text("x")
    assert {r["asset_id"] for r in tables.list_assets(spark, str(tmp_path / "img")).collect()} >= {"a", "b.tar"}
    frame = spark.createDataFrame([("a", [3.0, 4.0], [1.0]), ("b", [1.0, 0.0], [1.0, 2.0])], "pids string, embeddings array<float>, feat array<double>")
    with pytest.warns(UserWarning, match="ignored"):
        got = tables.as_vectors(frame, ["ids", "pids"], ["embeddings"], ["feat"])
    assert got.columns == ["id", "v"] and got.filter("id = 'a'").first()["v"] == pytest.approx([0.6, 0.8])
    with pytest.raises(KeyError):
        tables.as_vectors(frame, ["nope"], ["embeddings"])
    ragged = frame.unionByName(spark.createDataFrame([("c", [1.0], None)], frame.schema))
    with pytest.raises(Exception, match="not of length"):
        tables.as_vectors(ragged, ["pids"], ["embeddings"]).collect()
    (tmp_path / "cache.json").write_text('{"a": [[0.5, 0, 10, 10], [5, 5, 1, 9, 0.4], ["x", 1, 2, 3]],\n "b": []}')
    boxes = tables.read_boxes(spark, str(tmp_path / "cache.json")).collect()
    assert [(r["bundle_id"], r["x1"], r["conf"]) for r in boxes] == [("a", 0, 1.0)]
    assert tables.boxes_cache_path("/d") == "/d/bundle_boxes_conf0.25_iou0.45_max15_area0.001"


def test_submission_order(spark, tmp_path):
    ranked = spark.createDataFrame([("b", "q", 2), ("b", "p", 1), ("a", "r", 1)], "bundle_id string, product_id string, rank int")
    template = spark.createDataFrame([("b", 0), ("a", 1), ("b", 5)], "bundle_id string, pos int")
    sinks.write_submission(ranked, str(tmp_path / "out"), template)
    lines = [line for f in sorted(glob.glob(f"{tmp_path}/out/part-*")) for line in open(f).read().split()[1:]]
    assert lines == ["b,p", "b,q", "a,r"]
    one = tmp_path / "foreign.csv"
    one.write_text("bundle_asset_id,product_asset_id\nb,z\na,y\nb,x\n")
    got = {(r["bundle_id"], r["product_id"]): r["rank"] for r in tables.read_ranked_csv(spark, str(one), 1).collect()}
    assert got == {("b", "z"): 1, ("a", "y"): 1, ("b", "x"): 2}


def test_candidate_cache_notices_new_ids(spark, tmp_path):
    q = spark.createDataFrame([("a", [1.0, 0.0])], "bundle_id string, v array<float>")
    p = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "product_id string, v array<float>")
    tables.cached_topk(spark, str(tmp_path), q, p, 1)
    tables.cached_topk(spark, str(tmp_path), q, p, 1)
    assert len(os.listdir(tmp_path)) == 1
    tables.cached_topk(spark, str(tmp_path), q, p, 2)
    tables.cached_topk(spark, str(tmp_path), q, p.filter("product_id = 'x'"), 1)
    assert len(os.listdir(tmp_path)) == 3


def test_strict_links_and_sections(spark):
    links = spark.createDataFrame([("b1", "p1"), ("b2", "p1"), ("b2", "p1"), ("b1", "p2"), ("x", "p2"), ("b3", "p3")], "bundle_id string, product_id string")
    bundles = spark.createDataFrame([("b1", 1), ("b2", 2), ("b3", None)], "bundle_id string, section int")
    products = spark.createDataFrame([("p1", "coat"), ("p2", " Coat"), ("p3", "baby hat"), ("p4", "COAT"), ("p5", None)], "product_id string, description string")
    with pytest.raises(ValueError, match="unknown bundles: 1"):
        catalog.check_links(links, bundles, products, strict=True)
    direct = {r["product_id"]: (r["section"], r["n_sections"]) for r in catalog.direct_sections(links, bundles).collect()}
    assert direct == {"p1": (2, 2), "p2": (1, 1)}  # majority of links; no section contributes nothing
    done = {r["product_id"]: (r["gender"], r["method"]) for r in prepare.sections(links, bundles, products, 0.5).collect()}
    assert done["p3"] == (3, "baby_prefix") and done["p4"] == (1, "desc_heuristic") and done["p5"] == (0, "fallback_unknown")
    spread = {}
    for r in catalog.product_sections(links, bundles, products).collect():
        spread.setdefault(r["product_id"], set()).add(r["section"])
    assert spread["p4"] == {1, 2} and spread["p5"] == {1, 2, 3}


def test_alignment_lists_of_a_large_bundle_stay_whole(spark):
    bundles = spark.createDataFrame([("b", "h/a.jpg?ts=1735687800000")], "bundle_id string, image_url string")
    products = spark.createDataFrame([(f"p{i:02d}", f"h/a.jpg?ts={1735687800000 + i * 86400000}" if i else None) for i in range(30)], "product_id string, image_url string")
    links = products.select(F.lit("b").alias("bundle_id"), "product_id")
    members = alignment.ts_alignment_ids(links, bundles, products)
    lists = {r["list_name"]: r["product_ids"].split("|") for r in alignment.joined_ids(members).collect()}
    both = lists.get("same_month", []) + lists["diff_month"] + lists["missing_ts"]
    assert sorted(both) == [f"p{i:02d}" for i in range(30)]
    assert lists["missing_ts"] == ["p00"] and all(lists[x] == sorted(lists[x]) for x in lists)
    report = alignment.ts_alignment(links, bundles, products).first()
    assert report["n_products_with_ts"] == 29 and report["n_products_missing_ts"] == 1 and report["n_products_same_date"] == 0


def test_ranked_csv_keeps_the_order_of_files(spark, tmp_path):
    folder = tmp_path / "list.csv"
    folder.mkdir()
    for name, rows in (("part-0", ["b,p1", "b,p2"]), ("part-1", ["b,p3"] + [f"c,q{i}" for i in range(400)]), ("part-2", ["b,p4"])):
        (folder / f"{name}.csv").write_text("bundle_asset_id,product_asset_id\n" + "\n".join(rows) + "\n")
    rows = tables.read_ranked_csv(spark, str(folder), 3).filter("bundle_id = 'b'").orderBy("rank").collect()
    assert [(r["submission"], r["product_id"], r["rank"]) for r in rows] == [(3, f"p{i}", i) for i in (1, 2, 3, 4)]


def test_corpus_plan_writes_disjoint_manifests(spark, tmp_path):
    x = registry.Inputs(spark, SF)
    images = x.f_bundles.filter("section = 1").select(F.col("bundle_id").alias("asset_id"), F.lit("p").alias("path"))
    out = prepare.corpus(x.f_links, x.f_bundles, x.f_products, images, str(tmp_path / "c"))
    sides = [{json.loads(line)["bundle_asset_id"] for f in glob.glob(f"{tmp_path}/c/{side}_manifest/part-*") for line in open(f)} for side in ("train", "val")]
    assert not sides[0] & sides[1] and len(sides[0] | sides[1]) == out["records"].count()
    assert len(sides[1]) == round(0.1 * len(sides[0] | sides[1]))


def test_stream_of_batches(spark, tmp_path):
    x = registry.Inputs(spark, SF)
    queries = x.embeddings.select(F.col("vec_id").alias("crop_id"), F.col("embedding").alias("v"))
    queries.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = start_lookup(
        stream, x.f_index, x.f_products, lambda df, i: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={i}"), str(tmp_path / "log"), k=2
    )
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 2 * queries.count() and got.select("batch").distinct().count() == 3


@pytest.mark.parametrize(
    "name",
    ["plan_per_crop_metrics", "R1_topk_blocks", "R4_retrieve_boosted", "F6_hubness", "H2_rrf", "A5_ts_alignment", "A9_assign_sections", "N3_stratified_split", "B4_nms", "P20_select_assets"],
)
def test_registered_query_agrees_with_sql(spark, name):
    assert compare.compare(registry.QUERIES[name](spark, SF), compare.connect(SF), registry.ORACLES[name]) == ""


def test_every_operator_is_registered():
    ids = {name.split("_")[0] for name in registry.QUERIES}
    want = {f"{letter}{i}" for letter, n in dict(S=10, P=22, J=10, A=18, E=7, B=8, R=11, F=13, U=4, H=6, M=5, N=8).items() for i in range(1, n + 1)}
    assert want <= ids


def test_product_manifest(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text(
        '{"product_asset_id": " ", "id": " a "}\n{"asset_id": "b", "path": "/x/b.png", "text": "late", "description": ""}\n'
        '{"text": "nobody"}\n{"id": "c", "description": "one"}\n{"id": "c", "product_description": "two"}\n'
    )
    found = tables.product_manifest(tables.read_manifest(spark, str(tmp_path / "m.jsonl")), "/all/")
    assert sorted(tuple(r) for r in found.collect()) == [("a", "/all/a.jpg", ""), ("b", "/x/b.png", "late"), ("c", "/all/c.jpg", "two")]
    assert tables.product_manifest(found.limit(0), "/all").count() == 0


def test_ranked_csv_sorts_narrow_rows_in_parts_of_bounded_size(spark, tmp_path, monkeypatch):
    folder = tmp_path / "a list.csv"
    folder.mkdir()
    for name, first in (("part-0", 0), ("part-1", 300), ("part-é", 600)):
        (folder / f"{name}.csv").write_text("bundle_asset_id,product_asset_id\n" + "".join(f"b{i % 50},p{i}\n" for i in range(first, first + 300)))
    monkeypatch.setattr(tables, "RANK_BYTES", 256, raising=False)
    ranked = tables.read_ranked_csv(spark, str(folder), 1)
    assert {(r["bundle_id"], r["product_id"], r["rank"]) for r in ranked.collect()} == {(f"b{i % 50}", f"p{i}", i // 50 + 1) for i in range(900)}
    size = sum(f.stat().st_size for f in folder.iterdir())
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    dealt = re.search(r"hashpartitioning\(bundle_id#\d+, (\d+)\)", plan)
    assert int(dealt[1]) >= size / 256
    sort = re.search(r"Sort \[bundle_id#\d+ ASC[^\n]*", plan)[0]
    assert "_file" in sort and "_place" not in sort and "_name" not in sort


def test_labels_of_a_bundle_are_collected_in_one_grouping(spark):
    links = spark.createDataFrame([("b1", "p1"), ("b1", "p2"), ("b1", "p1"), ("b2", "p2")], "bundle_id string, product_id string")
    bundles = spark.createDataFrame([("b1", 1, None), ("b2", 2, None)], "bundle_id string, section int, image_url string")
    products = spark.createDataFrame([("p1", "coat/hat"), ("p2", "Hat/bag")], "product_id string, description string")
    records = catalog.bundle_labels(links, bundles, products)[0]
    assert {r["bundle_id"]: len(r["labels"]) for r in records.collect()} == {"b1": 3, "b2": 2}
    assert all(r["labels"] == sorted(set(r["labels"])) for r in records.collect())
    grouped = re.findall(r"\nAggregate \[([^\]]*)\]", "\n" + re.sub(r"(?m)^[ :+-]*", "", records._jdf.queryExecution().optimizedPlan().toString()))
    assert not any("label#" in keys for keys in grouped)  # no grouping by (bundle, label) before


def test_corpus_statistics_read_the_records_once(spark):
    plan = registry.QUERIES["A4_corpus_stats"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan
