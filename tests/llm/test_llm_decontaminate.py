"""Decontamination beside a plain version, and on the cases where one reading or one assignment is not enough."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from stitchrank.llm import decontaminate as d

SCHEMA = "doc_id long, text string, rid string, hash string"


def plain_word(word):
    bare = re.sub(r"^[^\w%]+|[^\w%]+$", "", word)
    return (
        bare.lower(), any(c.isdigit() for c in bare), len(bare) > 1 and bare[0].isupper() and bare[1:].islower(),
        word.rstrip("\"')]")[-1:] in (".", "!", "?", ":"), bare.lower() in d.UNITS,
    )


def plain_readings(text, item):
    """Lists of (symbol, value or None), one per reading, and which of their windows count."""
    words = [plain_word(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    out = []
    for names, first in ((True, False), (False, False), *([(True, True)] if item else [])):
        row = []
        for i, (bare, number, capital, _, unit) in enumerate(words):
            begins = (i == 0 and not first) or (i > 0 and words[i - 1][3])
            kind = "number" if number else "name" if names and capital and not begins else "unit" if unit and i and words[i - 1][1] else None
            row.append((f"<{kind}>" if kind else bare, bare if kind else None))
        out.append((row, first))
    return out


def plain_score(doc, item, size=8):
    """Best share of the item's words that consistent windows of one instance cover, over all pairs of windows."""
    n = len(re.findall(r"[^\x20\x09-\x0D]+", item or ""))
    if not n:
        return 0.0
    wide, lines = min(size, n), set()
    for mine, only_first in plain_readings(item, True):
        for i in range(1 if only_first else n - wide + 1):
            a = mine[i : i + wide]
            for theirs, _ in plain_readings(doc, False):
                for j in range(len(theirs) - wide + 1):
                    b = theirs[j : j + wide]
                    if [x[0] for x in a] == [x[0] for x in b]:
                        lines.add((j - i, i, tuple((x[1], y[1], k) for k, (x, y) in enumerate(zip(a, b)) if x[1] is not None)))
    width, groups = max(1, n // 4), defaultdict(list)
    for diagonal, i, pairs in lines:
        groups["one", diagonal].append((i, pairs))
        for k in (0, 1):
            groups[k, (diagonal + width * k // 2) // width].append((i, pairs))
    best = 0
    for group in groups.values():
        votes = defaultdict(Counter)
        for _, pairs in group:
            for own, other in {p[:2] for p in pairs}:
                votes[own][other] += 1
        pick = {own: min(c, key=lambda v: (-c[v], v)) for own, c in votes.items()}
        good = [(i, pairs) for i, pairs in group if all(pick[o] == v for o, v, _ in pairs)]
        covered = {i + k for i, _ in good for k in range(wide)}
        unlike = {i + k for i, pairs in good for o, v, k in pairs if o != v}
        if 4 * len(covered - unlike) >= len(covered):
            best = max(best, len(covered))
    return best / n


ITEMS = [
    "in town Alice sold 12 eggs and Eve bought 7 more eggs",
    "What is the capital of France?",
    "of 12 7 9 Alice 40 kg Bob has 3 9 17 and 22 apples",
    "Yesterday the farmer Alice sold 12 kg of apples to her neighbour and then Alice bought 3 cows from the market",
    "short one", "word", "", None, "Is é “Paris” in 3 km or 4 miles from Rome",
    "31 41 59 26 53 58 97 93 23 84 62 64", "extraordinarily extraordinary extraordinariness misunderstanding misunderstandings internationally internationalised counterproductive",
]
VARIANT = "in town Bob sold 10 eggs and Zoe bought 9 more eggs"
TEXTS = [
    ITEMS[0], f"{ITEMS[0]} {VARIANT}", f"{VARIANT} {ITEMS[0]} {VARIANT}", VARIANT, ITEMS[3].replace("farmer Alice", "farmer Bob").replace("then Alice", "then Eve"),
    "Question 4\nWhat is the capital of France?", "what is the capital of france", "Heading\nWHAT IS THE CAPITAL OF FRANCE", "What is the capital of Spain?",
    "x. " + ITEMS[2], "of 1 2 3 Carol 4 kg Dave has 5 3 6 and 8 apples", "1 2 3 4 5 6 7 8 9 10 11 12 13", ITEMS[3].lower(), ITEMS[3].replace("Alice", "Carol").replace("12", "90"),
    ITEMS[3].replace("sold", "gladly sold"), "a word here", "short  one\t", "", None, " \n", "so is é “Paris” in 3 km or 4 miles from Rome", "is é paris in 9 feet or 2 m from Berlin",
    "see 31 41 59 26 53 58 97 93 23 84 62 64", "extraordinarily extraordinary extraordinariness misunderstanding misunderstandings internationally internationalised counterproductive too",
    "extraordinary extraordinarily extraordinariness misunderstandings misunderstanding internationalised internationally counterproductively",
]


@pytest.fixture(scope="module")
def wide_texts():
    rng = random.Random(3)
    parts = [p for p in " ".join(t for t in [*ITEMS, VARIANT] if t).split(" ")]
    noise = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    return TEXTS + noise + [" ".join([noise[0], ITEMS[3], noise[1], VARIANT, ITEMS[0]])]


@pytest.mark.parametrize("cover", [0.5, 0.9])
def test_equals_all_pairs_of_windows(spark, wide_texts, cover):
    items = spark.createDataFrame([(f"i{n}", t) for n, t in enumerate(ITEMS)], "item_id string, text string")
    docs = spark.createDataFrame([(n, t, "r", "h") for n, t in enumerate(wide_texts)], SCHEMA).repartition(3)
    got = {(r.doc_id, r.item_id): round(r.score, 9) for r in d.contaminated(docs, items, cover=cover).collect()}
    want = {(n, f"i{m}"): round(plain_score(t, i), 9) for n, t in enumerate(wide_texts) for m, i in enumerate(ITEMS)}
    assert got == {k: v for k, v in want.items() if v >= cover}


def test_named_cases(spark):
    items = spark.createDataFrame([(n, t) for n, t in enumerate(ITEMS)], "item_id int, text string")
    docs = spark.createDataFrame([(n, t, "r", "h") for n, t in enumerate(TEXTS)], SCHEMA)
    got = {(r.doc_id, r.item_id): r.score for r in d.contaminated(docs, items).collect()}
    # The item, the item beside variants, and a variant alone; a value of the item stands for one value only.
    assert [got.get((n, 0), 0) for n in range(4)] == [1.0] * 4 and got.get((4, 3), 0) < 1
    # A short item behind a heading, and in lower and upper case.
    assert [got.get((n, 1)) for n in (5, 6, 7)] == [1.0] * 3
    # Dense with placeholders: word for word and asked again, but no table of numbers.
    assert got.get((9, 2)) == 1.0 and got.get((10, 2)) == 1.0 and not {(11, 2), (11, 9)} & set(got) and got.get((22, 9)) == 1.0
    assert got.get((23, 10)) == 1.0 and (24, 10) not in got
    assert got.get((12, 3)) == 1.0 and got.get((13, 3)) == 1.0 and got.get((14, 3), 0) >= 0.8
    kept = {r.doc_id for r in d.clean(docs, items).collect()}
    assert kept == set(range(len(TEXTS))) - {n for n, _ in got}


def test_ids_of_any_kind_and_repeats(spark):
    items = spark.createDataFrame([("x", ITEMS[3]), (None, ITEMS[0])], "item_id string, text string")
    rows = [("a", ITEMS[3]), ("a", ITEMS[3]), (None, ITEMS[0]), (None, ITEMS[0]), ("a", "clean text"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = d.contaminated(docs, items).select("doc_id", "item_id").collect()
    assert sorted(map(tuple, found), key=repr) == sorted([("a", "x"), (None, None)], key=repr)
    assert sorted(map(tuple, d.clean(docs, items).collect()), key=repr) == sorted([("a", "clean text"), (None, None)], key=repr)


def test_words_of_a_block_are_those_of_each_text():
    texts = ["", "one", " two  three\n", None, "é“x” \x0b 日本 ", "no\x85break", "end", "a" * 5000 + " b"]
    blocks = d.Blocks()
    for array in (pa.array(texts), pa.array(["skip me", *texts]).slice(1)):
        raw, text, start, end, codes = blocks.words(array)
        want = [(n, w) for n, t in enumerate(texts) for w in (t or "").encode().split()]
        assert [(int(n), raw[a:b]) for n, a, b in zip(text, start, end)] == want
        kinds = d.Kinds()
        assert codes.tolist() == [kinds[w] for _, w in want]
    assert blocks.words(pa.array(["", None]))[1].tolist() == []
    assert [(i, len(b)) for i, b in d.cut_blocks(pa.array(["x" * (3 << 20), "y" * (3 << 20), None, "z"]))] == [(0, 1), (1, 3)]
