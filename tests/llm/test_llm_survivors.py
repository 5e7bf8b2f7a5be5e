"""One row of each group, by row and not by id, beside a plain version; the pipeline's stages on odd tables."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from stitchrank.llm import decontaminate, dedup, jaccard, mixing, quality, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, _rid string, _place string, comp string, best string"


def text(seed, n=60, swap=None):
    words = [f"w{random.Random(seed * 1000 + i).randrange(500)}" for i in range(n)]
    if swap is not None:
        words[swap] = "other"
    return " ".join(words)


def line(doc_id, body, source="s", extra="x"):
    return (doc_id, body, "en", source, None if body is None else len(body), extra, "r", "p", "c", "b")


ROWS = [
    line(5, text(1)), line(5, text(1)), line(5, text(2)), line(3, text(1, swap=0)), line(None, text(1, swap=59)), line(None, text(1, swap=59)),
    line(9, text(2)), line(9, text(2), "t"), line(9, text(2), "s", "y"), line(None, text(3)), line(None, text(3), "t"), line(7, text(4)), line(7, text(5)),
    line(1, None), line(1, None), line(None, ""), line(2, " \t\n"), line(8, "one word"), line(8, "ONE  word"), line(4, "one word "), line(6, text(6, 4000)), line(11, text(6, 4000, 7)),
]


def shingles(body):
    words = (body or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def components(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and sets[j]:
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i) if sets[i] else ("alone", i)].append(r)
    return groups


def test_one_row_of_each_component(spark):
    kept = [tuple(r) for r in jaccard.one_of_each(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).collect()]
    left = Counter(kept)
    assert not left - Counter(ROWS)
    for group in components(ROWS).values():
        mine = [r for r in kept if r in group]
        ids = [r[0] for r in group if r[0] is not None]
        if shingles(group[0][1]):
            assert len(mine) == 1 and mine[0][0] == (min(ids) if ids else None)
    assert sum(not shingles(r[1]) for r in kept) == sum(not shingles(r[1]) for r in ROWS)
    assert jaccard.one_of_each(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_row_of_each_text(spark):
    kept = [tuple(r) for r in dedup.deduplicated(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).collect()]
    groups = defaultdict(list)
    for r in ROWS:
        groups["".join((r[1] or "").translate(str.maketrans("", "", " \t\n\x0b\f\r")))].append(r)
    assert not Counter(kept) - Counter(ROWS) and len(kept) == len(groups)
    for group in groups.values():
        (one,) = [r for r in kept if r in group]
        rank = lambda r: (-len(r[1] or ""), 1 << 63 if r[0] is None else r[0])
        assert rank(one) == min(map(rank, group))
    assert dedup.deduplicated(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folders with the pipeline's tables: odd rows, and no rows."""
    out = {}
    for name, rows in (("odd", ROWS + [line(100 + i, text(50 + i)) for i in range(60)]), ("empty", [])):
        folder = tmp_path_factory.mktemp(name)
        spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{folder}/documents.parquet")
        labels = [(100 + i, i % 3 and 1, 0) for i in range(60)] if rows else []
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        items = [(1, text(4, 30)), (2, None), (None, "")] if rows else []
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out[name] = str(folder)
    return out


@pytest.mark.parametrize("name", ["odd", "empty"])
def test_stages_on_odd_and_empty_tables(spark, tables, name):
    docs = spark.read.parquet(f"{tables[name]}/documents.parquet")
    rows = Counter(tuple(r) for r in docs.collect())
    for stage, function in corpus_pipeline.STAGES:
        found = function(spark, docs, tables[name])
        got = [tuple(r) for r in found.collect()]
        if stage != "sharding":
            assert found.columns == docs.columns
        if stage in ("quality", "near_duplicates", "decontamination"):
            assert not Counter(got) - rows
        if name == "empty":
            assert got == []
        elif stage == "sharding":
            assert len(got) == sum(rows.values())
        elif stage == "decontamination":
            assert rows - Counter(got) == Counter({line(7, text(4)): 1})
    assert {decontaminate, mixing, quality, sharding}
