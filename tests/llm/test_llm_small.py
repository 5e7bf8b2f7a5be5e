"""Every operator beside a plain version on rows with nulls, ties, repeats, odd white space and clashing columns."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from stitchrank.llm import binary, bwt, decontaminate, dedup, jaccard, language_model, mixing, quality, repeats, sharding, substrings

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(c, T.StringType()) for c in ("size", "rid", "row", "draw", "shard", "tid", "target", "_o0", "score", "label", "comp", "digest", "part")],
])
RANDOM = np.random.default_rng(5)
WORDS = [f"w{i}" for i in range(400)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def changed(text, every):
    return " ".join(w + "x" if i % every == every - 1 else w for i, w in enumerate(text.split()))


BASE_ROWS = [
    (7, prose(120, 1), "a"), (3, prose(120, 1), "b"), (9, prose(120, 1).upper(), "a"), (11, changed(prose(120, 1), 100), None),
    (12, changed(prose(120, 1), 30), "a"), (20, "x " + prose(60, 2) + " y " + prose(50, 1), "c"), (21, prose(60, 2), "c"),
    (None, prose(60, 2), "a"), (None, None, None), (30, None, "b"), (31, "", "b"), (32, " \t\n\x0b\f\r ", "z"), (33, "one", "z"),
    (34, "one two three", "z"), (35, "one two three  four", "z"), (36, "one  two\tthree\x85four", "z"),
    (40, "a " * 300, "a"), (41, "ab" * 200, "a"), (42, "ab" * 200 + "c", "a"), (50, prose(30000, 3), "a"), (51, prose(400, 3), "a"),
    (52, prose(400, 3), "a"), (52, prose(400, 3), "a"), (53, prose(30, 4) + " " + prose(30, 4), None), (-4, prose(60, 4), None),
    (60, "é" * 80 + " ñandú " + "日本" * 40, "é"), (61, "é" * 80, "é"), (62, "the end", "é"), (62, "the end", "é"), (62, "The end", "\U0001f600"),
]


def frame(spark, rows):
    extra = ["x"] * (len(SCHEMA) - 5)
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *extra) for i, t, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, BASE_ROWS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, []).cache()


def utf8(text):
    return (text or "").encode()


def key(i):
    return (1 << 63) - 1 if i is None else i


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# 1


def test_mixing(docs, empty):
    rows = [r.asDict(recursive=True) for r in mixing.mix_plan(docs).collect()]
    assert len(rows) == len(BASE_ROWS)
    size = Counter()
    for _, t, s in BASE_ROWS:
        size[s] += len(utf8(t).split())
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(size.values()), set(order)
    while True:
        part = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if part[s] > 2 * size[s]}
        if not over:
            target |= part
            break
        target |= {s: 2.0 * size[s] for s in over}
        left, free = left - sum(2 * size[s] for s in over), free - over
    for r in rows:
        s = r["row"]["source"]
        assert r["size"] == len(utf8(r["row"]["text"]).split())
        assert (r["source_size"], r["row"]["draw"]) == (size[s], "x")
        assert r["target"] == pytest.approx(target[s])
        rate = target[s] / size[s]
        assert math.floor(rate) <= r["copies"] <= math.ceil(rate) <= 2
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in rows)
    assert collected(mixing.mix(docs), "doc_id", "text", "size") == collected(mixed, "doc_id", "text", "size")
    assert mixing.mix(empty).count() == 0


def test_mixing_comes_near_targets(spark):
    many = frame(spark, [(i, prose(20, i % 50), "ab"[i % 3 == 0]) for i in range(3000)])
    rows = mixing.mix_plan(many).collect()
    taken, target = Counter(), {}
    for r in rows:
        taken[r["row"]["source"]] += r["size"] * r["copies"]
        target[r["row"]["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) < 0.05 * target[s] for s in target)


# 2


def test_template_slots():
    kinds = decontaminate.Kinds()
    symbols, slots, _ = decontaminate.template("The train with Alice runs 42 km in 3.5 hours. Then Bob waits.".encode().split(), kinds)
    other, _, _ = decontaminate.template("The train with Carol runs 7 miles in 12 days. Then Eve waits.".encode().split(), kinds)
    assert np.array_equal(symbols, other)
    assert np.flatnonzero(slots).tolist() == [3, 5, 6, 8, 9, 11]


def test_contaminated(spark, docs, empty):
    sums = "12 + 7 = 19 and 20 - 3 = 17 so 4 * 5 = 20"
    question = "Yesterday the farmer Alice sold 12 kg of apples to her neighbour and then Alice bought 3 cows from the market"
    swapped = "Yesterday the farmer Bob sold 90 kg of apples to her neighbour and then Bob bought 3 cows from the market"
    broken = "Yesterday the farmer Bob sold 90 kg of apples to her neighbour and then Eve bought 3 cows from the market"
    items = spark.createDataFrame([(1, question), (2, prose(40, 77)), (3, None), (4, ""), (5, "short question here"), (6, sums)], "item_id long, text string")
    rows = [
        (1, f"{prose(40, 1)}. {question}. {prose(9, 2)}", "a"), (2, f"{swapped}.", "a"), (3, prose(200, 78), "a"), (4, prose(40, 77), "a"), (4, prose(40, 77), "a"),
        (5, "a short question here and there", "b"), (6, None, "a"), (7, "", "a"), (None, question, "a"), (8, prose(10, 77), "b"),
        (9, f"so {sums}", "a"), (10, sums.replace("1", "8"), "a"), (11, "8 * 8 = 64 or 9 * 9 = 81 or 1 * 1 = 1 x", "a"),
    ]
    found = decontaminate.contaminated(frame(spark, rows), items)
    # A row is reported once for each item.
    assert collected(found, "doc_id", "item_id") == sorted([(1, 1), (2, 1), (4, 2), (5, 5), (9, 6), (10, 6), (None, 1)], key=repr)
    strict = decontaminate.contaminated(frame(spark, [(1, swapped, "a"), (2, broken, "a")]), items, cover=0.9)
    assert collected(strict, "doc_id") == [(1,)]
    clean = decontaminate.clean(frame(spark, rows), items)
    assert clean.columns == docs.columns
    assert collected(clean, "doc_id") == sorted([(3,), (6,), (7,), (8,), (11,)], key=repr)
    assert decontaminate.clean(docs, items.limit(0)).count() == len(BASE_ROWS)
    assert decontaminate.contaminated(empty, items).count() == 0


# 3


def test_cuckoo_index():
    index, live = dedup.CuckooIndex(4), {}
    for i in range(3000):
        digest = hashlib.sha256(str(i % 1100).encode()).digest()
        if i % 3 == 2:
            assert index.delete(digest) == (live.pop(digest, None) is not None)
        else:
            index.insert(digest, i)
            live[digest] = i
        if i % 500 == 0:
            assert all(index.get(d) == v for d, v in live.items())
    assert index.buckets > 4
    assert all(index.get(d) == v for d, v in live.items())
    assert index.get(hashlib.sha256(b"never").digest()) is None
    assert sum(1 for s in index.slots if s) == len(live)


def test_cuckoo_index_verifies_equal_fingerprints():
    """Keys of one fingerprint and one bucket are told apart by the key in the slot; an overflow keeps all of them."""
    index = dedup.CuckooIndex(1)
    alike = [b"\x07\x00" + bytes([i]) + b"\x00" * 5 + bytes([i]) * 24 for i in range(64)]
    for i, digest in enumerate(alike):
        assert index.get(digest) is None and not index.delete(digest)
        index.insert(digest, i)
    assert len(index) == 64 and [index.get(d) for d in alike] == list(range(64))
    assert sorted(index.items()) == sorted(zip(alike, range(64), strict=True))
    index.insert(alike[5], "again")
    assert index.get(alike[5]) == "again" and len(index) == 64
    assert all(index.delete(d) for d in alike[::2]) and [index.get(d) is None for d in alike] == [True, False] * 32
    index.clear()
    assert len(index) == 0 and not list(index.items())


def test_exact_groups(docs, empty):
    strip = str.maketrans("", "", " \t\n\x0b\f\r")
    held = defaultdict(list)
    for i, t, _ in BASE_ROWS:
        held[(t or "").translate(strip)].append((-len(t or ""), key(i)))
    want = []
    for i, t, _ in BASE_ROWS:
        text = (t or "").translate(strip)
        best = min(held[text])
        want.append((i, None if best[1] == key(None) else best[1], len(held[text]), best == (-len(t or ""), key(i)), hashlib.sha256(text.encode()).hexdigest()))
    assert collected(dedup.exact_groups(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    assert dedup.exact_groups(empty).count() == 0


def test_digest_index_insert_and_delete(docs, rows):
    all_rows = dedup.digests(docs).cache()
    index = dedup.groups(dedup._changes(all_rows.where("doc_id < 40"), 1))
    index = dedup.insert(index, all_rows.where("doc_id >= 40 or doc_id is null"))
    whole = dedup.groups(dedup._changes(all_rows, 1))
    assert rows(index, "digest", "keep_id", "group_size") == rows(whole, "digest", "keep_id", "group_size")
    less = dedup.delete(index, all_rows.where("doc_id in (3, 7)"))
    assert less.count() == whole.count() - 1


def test_exact_groups_beyond_a_full_index(docs, rows, monkeypatch):
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    want = collected(dedup.exact_groups(docs), *columns)
    all_rows = dedup.digests(docs).cache()
    whole = rows(dedup.groups(dedup._changes(all_rows, 1)), "digest", "keep_id", "group_size")
    monkeypatch.setattr(dedup, "MOST_LIVE", 2)
    assert collected(dedup.exact_groups(docs), *columns) == want
    index = dedup.insert(dedup.groups(dedup._changes(all_rows.where("doc_id < 40"), 1)), all_rows.where("doc_id >= 40 or doc_id is null"))
    assert rows(index, "digest", "keep_id", "group_size") == whole
    assert dedup.delete(index, all_rows.where("doc_id in (3, 7)")).count() == len(whole) - 1


def test_more_digests_than_an_index_holds(spark):
    n = dedup.MOST_LIVE + 5000
    changes = spark.range(0, 2 * n, 1, 2).selectExpr(f"sha2(cast(id % {n} as string), 256) as digest", "1L as n_chars", "id as keep_id", "1L as group_size", "1L as added")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        found = dedup.groups(changes.selectExpr("cast(digest as binary) as digest", "n_chars", "keep_id", "group_size", "added"))
        assert found.selectExpr("count(*)", "min(group_size)", "max(keep_id)").first() == (n, 2, n - 1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


# 4


def test_quality(spark, docs, empty):
    rows, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        text = prose(80, i)
        rows.append((i, text if good else " ".join(w + "&&&" for w in text.split()), "s"))
        labels.append((i, int(good), 0))
    rows += [(None, "a b", "s"), (1000, None, "s"), (1001, "", "s"), (1002, prose(50000, 9), "s"), (5, rows[5][1], "s")]
    marks = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    table = frame(spark, rows)
    model = quality.fit(table, marks)
    found = quality.score(table, model)
    again = quality.score(table, quality.fit(table, marks))
    assert collected(found, "row.doc_id", "score") == collected(again, "row.doc_id", "score")
    got = found.select("row.doc_id", "row.score", "held_out", found["score"], "predicted").collect()
    assert len(got) == len(rows)
    assert all(r["score"] == "x" for r in found.select("row.score").collect())
    for doc_id, _, held, score, predicted in got:
        assert held == (doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0)
        assert 0 <= score <= 1 and predicted == (score >= 0.3)
    right = [p == (d % 3 > 0) for d, _, h, _, p in got if h and d < 600]
    assert len(right) > 60 and np.mean(right) > 0.97
    assert quality.score(empty, model).count() == 0
    none = quality.score(docs, quality.fit(docs, marks.limit(0)))
    assert {r["score"] for r in none.collect()} == {0.5}


def test_frequent_words(spark, empty, monkeypatch):
    texts = [*(prose(90, i) for i in range(40)), "\u00e9\u00e9 Ab,\u00a0c " * 30, "once", "", None]
    sample = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    counts = Counter(w for t in texts for w in (t or "").encode().split())
    for share in (quality.SHARE, 0.004, 0.02, 1.0):
        heavy = sorted(xxhash.xxh64_intdigest(w) for w, n in counts.items() if n >= share * counts.total())
        assert quality.frequent_words(sample, share).tolist() == heavy
    monkeypatch.setattr(quality, "HELD", 100)
    assert quality.frequent_words(sample).tolist() == sorted(map(xxhash.xxh64_intdigest, counts))
    assert quality.frequent_words(empty).tolist() == []
    frequent, vectors = quality.word_vectors(sample)
    assert vectors.shape == (len(frequent) + quality.BUCKETS, quality.DIM)


# 5


def tokens(text):
    return [*utf8(text).lower().split(), b"\n"]


@pytest.mark.parametrize("settings", [{}, {"order": 3}, {"word_share": 0.002, "gram_share": 0.001}])
def test_language_model(docs, settings):
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t, _ in BASE_ROWS if not out(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t, _ in BASE_ROWS:
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))
        want.append((i, out(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(base, 6)))
    found = language_model.scored(docs, **settings).collect()
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all(r.score <= 0 for r in found)


@pytest.mark.parametrize("settings", [{}, {"order": 3}, {"word_share": 0.002, "gram_share": 0.001}, {"order": 3, "word_share": 0.002, "gram_share": 0.001}, {"word_share": 0.9, "gram_share": 0.9}])
def test_language_model_prices_all_ngrams(docs, settings):
    order = settings.get("order", 2)
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    grams = [Counter() for _ in range(order + 1)]
    for i, t, _ in BASE_ROWS:
        if not out(i):
            w = [b"^", *tokens(t)]
            for n in range(1, order + 1):
                grams[n].update(tuple(w[j : j + n]) for j in range(n == 1, len(w) - n + 1))
    once, twice = ([sum(c == k for c in g.values()) for g in grams] for k in (1, 2))
    less = [a / (a + 2 * b) if a and b else 0.5 for a, b in zip(once, twice, strict=True)]
    held, types = Counter(), Counter()
    for g in grams[2:]:
        for gram, c in g.items():
            held[gram[:-1]] += c
            types[gram[:-1]] += 1
    total = sum(grams[1].values())

    def prob(gram):
        n = len(gram)
        if n == 1:
            return (grams[1][gram] - less[1]) / total if grams[1][gram] else less[1] * len(grams[1]) / total
        shorter = prob(gram[1:])
        if not held[gram[:-1]]:
            return shorter
        return (max(grams[n][gram] - less[n], 0) + less[n] * types[gram[:-1]] * shorter) / held[gram[:-1]]

    want = []
    for i, t, _ in BASE_ROWS:
        w = [b"^", *tokens(t)]
        want.append((i, sum(math.log10(prob(tuple(w[max(0, j + 1 - order) : j + 1]))) for j in range(1, len(w)))))
    got = [(r.doc_id, r.score) for r in language_model.scored(docs, **settings).collect()]
    by = lambda x: (key(x[0]), x[1])
    for (i, p), (j, q) in zip(sorted(got, key=by), sorted(want, key=by), strict=True):
        assert i == j
        assert p == pytest.approx(q, rel=1e-7)


def test_automaton_is_a_distribution(docs):
    model = language_model.build(docs.where("text is not null"), order=3)
    words = range(len(model.words))
    for state in range(len(model.fail)):
        seen = sum(10 ** language_model._step(model, state, w)[1] for w in words)
        rare = 10 ** model.to_root[state] * model.discount * model.distinct / model.total  # all words are frequent here
        assert seen + rare == pytest.approx(1, abs=1e-6)


def test_language_model_sends_each_ngram_of_a_block_once(spark):
    # A third of the tokens are rare words, the others are the same two in every row.
    rng = np.random.default_rng(5)
    docs = frame(spark, [(i, " ".join(f"w{x} all rows" for x in rng.integers(0, 200_000, 300)), "s") for i in range(300)])
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    before = shuffled()
    n_tokens = sum(r.n_tokens for r in language_model.scored(docs).collect())
    assert n_tokens == 300 * 901
    assert shuffled() - before < 14 * n_tokens


def test_language_model_of_nothing(empty, docs):
    assert language_model.scored(empty).count() == 0
    assert language_model.scored(docs.where("doc_id is null and text is null")).count() == 1


# 6


def shingles(text, size):
    w = utf8(text).lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


@pytest.mark.parametrize(("size", "threshold", "block"), [(4, 85, 2048), (5, 80, 2048), (2, 50, 2048), (2, 50, 3)])
def test_jaccard(spark, docs, monkeypatch, size, threshold, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    more = [(100 + i, changed(prose(90, 8), 7 + i % 60), "n") for i in range(80)] + [(300 + i, f"k{i % 7} " * 5 + prose(i % 12, 6), "n") for i in range(60)]
    rows = BASE_ROWS + more
    sets = [shingles(t, size) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= threshold * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for x, (i, _, _) in enumerate(rows):
        least[root(x)] = min(least.get(root(x), key(None)), key(i))
    want = [(i, len(sets[x]), i if not sets[x] else None if least[root(x)] == key(None) else least[root(x)]) for x, (i, _, _) in enumerate(rows)]
    found = jaccard.linked_groups(docs.unionByName(frame(spark, more)), size, threshold)
    assert collected(found, "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)


def test_schemes_share_a_signature():
    random = np.random.default_rng(2)
    for sets in (1, 10**9):  # without and with deletion segments
        for threshold in (85, 80, 50):
            schemes = jaccard.Schemes(threshold, dict.fromkeys(range(80), sets))
            for n in (1, 2, 3, 5, 8, 13, 40, 120, 700):
                for _ in range(30):
                    a = np.unique(random.integers(1, 1 << 62, n).astype(np.uint64))
                    drop = random.integers(0, n * (100 - threshold) // 100 + 1)
                    add = random.integers(0, n * (100 - threshold) // threshold + 1)
                    b = np.unique(np.concatenate((a[drop:], random.integers(1, 1 << 62, add).astype(np.uint64))))
                    both = len(np.intersect1d(a, b))
                    if 100 * both >= threshold * (len(a) + len(b) - both):
                        assert len(np.intersect1d(schemes.signatures(a), schemes.signatures(b)))


def test_hot_signatures_do_not_overflow(spark):
    # Hashes of one sign add up as those of very many members do.
    members = spark.range(8000).where("xxhash64(id, 7) > (1L << 61)")
    shared = members.selectExpr("explode(array(1L, 2L)) as sig", "id as tid").union(members.limit(1).selectExpr("3L as sig", "id as tid"))
    assert collected(jaccard.one_of_alike(shared), "sig", "a") == [(1, members.agg({"id": "min"}).first()[0])]


@pytest.mark.parametrize("sizes", [(400, 1), (90, 60, 30), (1,) * 40, (5, 5), (3, 1)])
def test_members_of_hot_signatures_meet(spark, sizes):
    """All members of different components meet, in groups of bounded size, and a large component is not sent to itself."""
    block, comp_of = 10, [c for c, n in enumerate(sizes) for _ in range(n)]
    held = len(comp_of)
    members = spark.createDataFrame([(7, i, c, held) for i, c in enumerate(comp_of)], "sig long, tid long, comp long, held long")
    met, sent, groups = set(), 0, defaultdict(list)
    for r in jaccard.meetings(members, block).collect():
        groups[r.group].append((r.half, r.tid))
        sent += 1
    for rows in groups.values():
        assert len(rows) <= 6 * block  # blocks are cut by hash
        met |= {(a, b) for s, a in rows for t, b in rows if a < b and (s < 0 or s != t)}
    assert {(a, b) for a in range(held) for b in range(a + 1, held) if comp_of[a] != comp_of[b]} <= met
    few, many = held - max(sizes), max(sizes)
    assert sent <= (held if held <= block else many * -(-few // block) + few * (-(-many // block) + -(-few // block)))


def test_one_of_each(docs, empty):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 3 in ids and 7 not in ids and 9 not in ids and 30 in ids and 31 in ids
    assert jaccard.one_of_each(empty).count() == 0


# 7 and 9


def left_over(symbols_of, length, within):
    """Removed places of every distinct row, by comparing all windows."""
    rows = {(key(i), t): symbols_of(t) for i, t, _ in BASE_ROWS}
    first = {}
    for (doc, _), s in rows.items():
        for at in range(len(s) - length + 1):
            w = tuple(s[at : at + length])
            place = (doc, at) if within else (doc, 0)
            first[w] = min(first.get(w, place), place)
    out = {}
    for (doc, t), s in rows.items():
        gone = np.zeros(len(s), bool)
        for at in range(len(s) - length + 1):
            if first[tuple(s[at : at + length])] < ((doc, at) if within else (doc, 0)):
                gone[at : at + length] = True
        out[doc, t] = gone
    return out


@pytest.mark.parametrize("hot", [1000, 1])
def test_substring_dedup(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_LEAST", hot)
    gone = left_over(lambda t: utf8(t).split(), 20, True)
    want = []
    for i, t, _ in BASE_ROWS:
        words, mask = utf8(t).split(), gone[key(i), t]
        left = b" ".join(w for w, g in zip(words, mask, strict=True) if not g)
        want.append((i, len(words), int(mask.sum()), hashlib.sha256(left).hexdigest(), left))
    found = substrings.substring_dedup(docs, text=True).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256, bytes(r.text)) for r in found], key=repr) == sorted(want, key=repr)
    assert substrings.substring_dedup(empty).count() == 0


@pytest.mark.parametrize("hot", [1000, 1])
def test_byte_dedup(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_LEAST", hot)
    gone = left_over(utf8, 50, False)
    want = []
    for i, t, _ in BASE_ROWS:
        mask = gone[key(i), t]
        left = bytes(np.frombuffer(utf8(t), np.uint8)[~mask])
        starts = int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum())
        want.append((i, len(mask), int(mask.sum()), starts, hashlib.sha256(left).hexdigest()))
    found = bwt.byte_dedup(docs)
    assert collected(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)
    assert bwt.byte_dedup(empty).count() == 0


def test_resolvers_agree_with_search():
    random = np.random.default_rng(0)
    contents = []
    for _ in range(60):
        base = bytes(random.choice([97, 98, 99, 0, 255], random.integers(6, 40)).astype(np.uint8))
        contents.append(base)
    contents += [b"ab" * 40, b"ab" * 40 + b"c", contents[3] + contents[4]]
    contents = list(dict.fromkeys(contents))
    count, src, _ = bwt.first_strings(contents, np.zeros(len(contents)), 6)
    want = [min(j for j, c in enumerate(contents) if x[i : i + 6] in c) for x in contents for i in range(len(x) - 5)]
    assert count.tolist() == [len(c) - 5 for c in contents] and src.tolist() == want
    lines = [" ".join(random.choice(["a", "b", "c"], random.integers(4, 30))).encode() for _ in range(40)]
    lines = list(dict.fromkeys(lines))
    count, src, offset = substrings.first_windows(lines, np.zeros(len(lines)), 4)
    seen, want = {}, []
    for j, line in enumerate(lines):
        w = line.split()
        for i in range(len(w) - 3):
            want.append(seen.setdefault(tuple(w[i : i + 4]), (j, i)))
    assert list(zip(src.tolist(), offset.tolist(), strict=True)) == want


# 8


def test_sharding(docs, empty):
    rows = sharding.shard_documents(docs, 7).collect()
    size = {t: len(utf8(t)) + 16 for _, t, _ in BASE_ROWS}
    crc = {t: zlib.crc32(utf8(t)) for _, t, _ in BASE_ROWS}
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, size[t], crc[t]) for i, t, _ in BASE_ROWS)
    total, at = sum(r["size"] for r in rows), 0
    slots = defaultdict(list)
    for r in sorted(rows, key=lambda r: (key(r.doc_id), r.shard, r.slot)):
        assert r.shard == min(6, (2 * at + r["size"]) * 7 // (2 * total)), "contiguous in doc_id"
        at += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    assert sharding.shard_documents(empty).count() == 0


# 10


@pytest.mark.parametrize("bits", [1, 7, 15, 16, 17, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype(np.uint32)
    data = binary.pack(ids, bits)
    assert len(data) == (1000 * bits + 7) // 8
    assert np.array_equal(binary.unpack(data, bits, 1000), ids)


@pytest.mark.parametrize("bits", [16, 17])
def test_file_of_ids(tmp_path, bits):
    from pyarrow import fs

    random, files = np.random.default_rng(1), fs.LocalFileSystem()
    docs = [random.integers(0, 1 << 16, n).astype(np.uint32) for n in (1, 0, 5000, 4096, 300_000, 3)]
    writer = binary.Writer(files.open_output_stream(str(tmp_path / "x.ids")), bits)
    for i, ids in enumerate(docs):
        writer.add(i, ids)
    writer.close()
    with files.open_input_file(str(tmp_path / "x.ids")) as source:
        reader = binary.Reader(source)
        assert all(np.array_equal(reader.document(i), ids) for i, ids in enumerate(docs))
        whole = np.concatenate(docs)
        assert np.array_equal(reader.range(4000, 9000), whole[4000:9000])
    (tmp_path / "part.ids").write_bytes((tmp_path / "x.ids").read_bytes()[:-5])
    with files.open_input_file(str(tmp_path / "part.ids")) as source, pytest.raises(ValueError, match="packed ids"):
        binary.Reader(source)


def test_token_files(docs, empty, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(binary, "FILE_IDS", 50_000)
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, _ in BASE_ROWS]
    rows = binary.token_files(docs, path).collect()
    got = Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows)
    assert got == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [key(r.doc_id) for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order) and len({r.file for r in rows}) > 1
    assert binary.token_files(empty, path).count() == 0


def test_encoder_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [
        "", " ", "  a", "a  b", "a \n b", "x<|endoftext|> y <|endoftext|>", "it's 's 'S don't", " x y  z", "Ġ Ġx", "1 22 a1 !!! ?? 日本 語", "a\tb c\x85 d",
        "é è", "tab \t", "\n\n a", " lead", "trail ", "a\x1c b", "a b  c", "word. word, (word) word's. x.' ...", "é ñ. ́. á!",
    ]
    tokenizer, encoder = Tokenizer.from_file(path), binary.Encoder(path)
    for _ in range(2):
        got = [e.tolist() for e in encoder.encode(texts)]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        encoder._keep_frequent()
    assert encoder.encode([]) == [] and encoder.encode([None])[0].tolist() == []
