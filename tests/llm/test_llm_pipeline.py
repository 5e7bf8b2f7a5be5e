"""The pipeline's stages, each beside a plain version of itself on the smallest tables."""

from collections import Counter

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from stitchrank.llm import mixing, queries
from stitchrank.llm.common import table, written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
        out.append(docs)
    return out


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns(spark, stages):
    columns = table(spark, SF, "documents").columns
    assert all(df.columns == columns for df in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_quality_keeps_clean_rows(stages):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    kept = ids(stages[0])
    wrong = [d for d, q in labels.items() if (q == 1) != (d in kept)]
    assert len(wrong) <= 0.05 * len(labels)


def test_near_duplicates(stages):
    before, kept = texts(stages[0]), set(ids(stages[1]))

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {d: shingles(t) for d, t in before.items()}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    assert kept == {d for d in sets if root(d) == d}


def test_decontamination(stages):
    items = [r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    before, after = texts(stages[1]), texts(stages[2])
    held = {d for d, t in before.items() if any(i in t for i in items)}
    assert held and set(after) == set(before) - held


def test_mixing_and_sharding(stages):
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(stages[2]).select("row.doc_id", "copies").collect()}
    assert ids(stages[3]) == Counter({d: c for d, c in plan.items() if c})
    assert ids(stages[4]) == ids(stages[3])
    sizes = Counter()
    for r in stages[4].collect():
        sizes[r["shard"]] += r["size"]
    largest = max(r["size"] for r in stages[4].collect())
    assert max(sizes.values()) - sum(sizes.values()) / 40 <= largest


def test_run_and_registration(spark, stages):
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == stages[4].columns
    assert ids(found) == ids(stages[4])
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
