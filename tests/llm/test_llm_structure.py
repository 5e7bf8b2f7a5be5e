"""Conversation repair, URL verdicts and the Merkle manifest beside plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from stitchrank.llm import conversations, merkle, urls

# 11


def all_audits(rows, most_inserts=2):
    """Every audit with few insertions: (cost, audit, lines), by trying all edits of all rows."""
    out = [(0, "", "", ())]
    for i, (role, text, fault) in enumerate([*rows, (None, None, None)]):
        grown = []
        for cost, audit, roles, lines in out:
            for n in range(most_inserts + 1):
                for added in itertools.product(("user", "assistant"), repeat=n):
                    base = (cost + 5 * n, audit + "I" * n, roles + "".join(a[0] for a in added), lines + tuple(f"{a}:" for a in added))
                    if role is None:
                        grown.append(base)
                        continue
                    edits = [(2, "D", "", ())]
                    if fault not in ("blank", "duplicate"):
                        extra = 5 if fault == "truncated" else 0
                        edits += [(extra, "K", role[:1] or "?", (f"{role}:{text}",))]
                        edits += [(extra + 1, "R", r[0], (f"{r}:{text}",)) for r in ("user", "assistant")]
                    grown += [(base[0] + c, base[1] + a, base[2] + r, base[3] + line) for c, a, r, line in edits]
        # Only beginnings that can still become legal, the best of each last role.
        best = {}
        for g in grown:
            legal = all(pair in ("su", "ua", "au") for pair in map("".join, zip(g[2][-4:], g[2][-4:][1:]))) and "s" not in g[2][1:] and g[2][:1] in ("", "s", "u")
            if legal and (g[2][-1:] not in best or g[:2] < best[g[2][-1:]][:2]):
                best[g[2][-1:]] = g
        out = list(best.values())
    legal = [g for g in out if re.fullmatch(r"(s?(ua)+)?", g[2])]
    return min(legal, key=lambda g: g[:2])


def plain_report(rows):
    """``rows``: (turn, role, text) after damage."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], hashlib.md5(r[2].encode()).hexdigest()))
    seen, faults, judged = set(), Counter(), []
    for turn, role, text in rows:
        body = text.encode().rstrip(b" \t\n\x0b\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1:] in b".!?" else "truncated"
        seen.add((role, text))
        faults[fault] += 1
        judged.append((role, text, fault))
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit, _, lines = all_audits(judged)
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest


TEXTS = ["Yes.", "Yes.", "No", "", " \t\n", None, "Why?", "é\x85", "x. \r", "long " * 30 + "end!", "long " * 30 + "End!"]


@pytest.fixture(scope="module")
def talks():
    rng, rows = random.Random(4), []
    for conv in [*range(60), None]:
        for turn in range(rng.choice((0, 1, 1, 2, 3, 5, 9, 14))):
            turn = None if rng.random() < 0.1 else turn + rng.choice((0, 0, 0, 1, 7))
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None, "User"))
            rows.append((conv, turn, role, rng.choice(TEXTS), True, "x"))
    rows += [(61, 3, "user", "gone", False, "x"), (62, None, None, None, True, "x")]
    return rows


TALK = "conv_id long, turn long, role string, text string, present boolean, kind string"


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_repair_is_the_cheapest(spark, talks, size):
    groups = defaultdict(list)
    for conv, turn, role, text, present, _ in talks:
        groups[conv] += [(turn, role, text)] if present else []
    found = conversations.repaired(spark.createDataFrame(talks, TALK).repartition(3), size).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == {c: plain_report(rows) for c, rows in groups.items()}
    assert len(found) == len(groups)


def test_one_long_conversation_in_pieces(spark):
    rng = random.Random(9)
    rows = [(1, t // 2, rng.choice(("user", "assistant", "tool")), rng.choice(("a.", "b", "c!", f"d{t}.", f"e{t}?")), True, "x") for t in range(700)]
    (got,) = conversations.repaired(spark.createDataFrame(rows, TALK).repartition(7), 16).collect()
    assert tuple(got)[1:] == plain_report([r[1:4] for r in rows])


def test_division_equals_one_pass():
    rng, vectors = random.Random(2), conversations.Vectors()
    for _ in range(300):
        codes = bytes(rng.randrange(16) for _ in range(rng.randrange(12)))
        ways = {s: ((0, "") if s == 0 else None) for s in range(4)}
        for code in codes:
            grown = {}
            for (p, c), (cost, audit) in conversations.MOVES[code].items():
                if ways.get(p) is not None:
                    way = (ways[p][0] + cost, ways[p][1] + audit)
                    grown[c] = min(grown.get(c, way), way)
            ways = grown
        parts = [codes[i : i + 3] for i in range(0, len(codes), 3)]
        cost, found = conversations.states([conversations.summary(p, vectors) for p in parts])
        audit = "".join(conversations.repair(p, a, b, vectors) for p, a, b in zip(parts, found, found[1:]))
        want = min((w[0] + conversations.TRAIL[s], w[1], s) for s, w in ways.items() if w is not None)
        assert (cost, audit, found[-1]) == want


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two? Three!") for c in (1, 2, None) for t in (*range(40), None)]
    got = Counter(tuple(r) for r in conversations.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    want = Counter()
    for c, t, role, text in rows:
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        want[c, t, "user" if draw == 4 else role, text, draw != 0] += 1 + (draw == 3)
    assert got == want


def test_no_conversations(spark):
    assert conversations.repaired(spark.createDataFrame([], TALK)).collect() == []


# 12


URLS = [
    "https://www.spam-farm.example.net/en/12/", "http://freecasinobets.example.com/a", "http://news.example.net/casino/poker?x=1", "https://news.example.net/en/4#top",
    "https://garden.example.net/en/17", "http://GardenNews.example.com/de/1", "x://example.org/en/15", "x://example.org/en/2", "x://a.example.org/es/", "x://notexample.org/es/",
    "x://org", "x://org/", "http://a.com/fr/", "http://a.com/fr", "http://a.com:80/fr/", "no scheme", "", None, "://", "a://b://c/d?e", "https://host?x=/y", "http://h#/de/",
    "http://user@x.com/de/1", "https://日本.example/é/1", "https://garden.example.net/en/17", "//x", "http://-.-/", "http://a.com/de/" + "x/" * 3000, "http://" + "ab" * 400 + ".net/",
]
HTML = ["<p>garden news and news</p> Garden the <b class='poker'>farm</b>", None, "", "the news spam"]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i if i != 3 else None, u, HTML[i % 4], "h", "p", "r") for i, u in enumerate(URLS)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, path string, row string").repartition(3)


def plain_parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    name = re.match(r"[^/?#]*", rest).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in name), re.match(r"[^?#]*", rest[len(name) :]).group()


def plain_rule(name, way):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (name == h or name.endswith("." + h)) and way.startswith(p)]
    return max(fits)[1:] if fits else None


def plain_split(name, counts, total):
    """Best split by trying every cut of a short name."""
    best = None
    for cuts in itertools.product((0, 1), repeat=len(name) - 1):
        words, start = [], 0
        for i, cut in enumerate(cuts, 1):
            if cut:
                words.append(name[start:i])
                start = i
        words.append(name[start:])
        p = sum(math.log10(counts[w] / total) if w in counts else 1 - math.log10(total) - len(w) for w in words)
        best = max(best or (-math.inf, []), (p, words), key=lambda b: b[0])
    return best[1]


def test_names_split_as_by_every_cut(spark):
    texts = spark.createDataFrame([("Spam farm farm <b>x</b> the theme me men men", 0)], "html string, n int")
    counts = {r[0]: r[1] for r in urls.word_counts(texts, "html").collect()}
    assert counts == {"spam": 1, "farm": 2, "x": 1, "the": 1, "theme": 1, "me": 1, "men": 2}
    names = ["spamfarm", "themen", "thefarmmen", "freecasino", "qqq", "a", "cheappills"]
    got = {r[0]: r[1] for r in urls.split_names(spark.createDataFrame([(n,) for n in names], "name string"), urls.word_counts(texts, "html")).collect()}
    total = sum(counts.values()) + len(set(urls.UNWANTED))
    counts |= {w: max(counts.get(w, 0) + 1.0, total * urls.RARE) for w in urls.UNWANTED}
    assert got == {n: plain_split(n, counts, total) for n in names}


def test_verdicts(pages):
    found = [r.asDict(recursive=True) for r in urls.judge(pages).collect()]
    assert Counter(r["row"]["url"] for r in found) == Counter(URLS)
    lex = Counter(w.lower() for i in range(len(URLS)) for w in re.findall(r"[^\W\d_]+", re.sub("<[^<>]*>", " ", HTML[i % 4] or "")))
    total = sum(lex.values()) + len(set(urls.UNWANTED))
    names = dict(lex) | {w: max(lex.get(w, 0) + 1.0, total * urls.RARE) for w in urls.UNWANTED}
    tokens, seeded = {}, {}
    for url in set(URLS):
        name, way = plain_parse(url)
        parts = lambda t: [x if not x.isdigit() else "0" for x in re.findall(r"[^\W\d_]+|\d+", t)]
        words = [w for p in parts(name) for w in (["0"] if p == "0" else urls.best_split(p, names, total))]
        steps = parts("".join(c.lower() if "A" <= c <= "Z" else c for c in way))
        seeded[url] = bool(set(urls.UNWANTED) & {*words, *steps})
        tokens[url] = {w if w in urls.UNWANTED else m + w for m, ws in (("host:", words), ("path:", steps)) for w in ws}
    block, allow = Counter({w: 1 for w in urls.UNWANTED}), Counter()
    for url in URLS:
        (block if seeded[url] else allow).update(tokens[url])
    kinds = len({*block, *allow})
    p = lambda c, t: (c[t] + 0.01) / (sum(c.values()) + 0.01 * kinds)
    for r in found:
        url = r["row"]["url"]
        rule = plain_rule(*plain_parse(url))
        score = sum(math.log(0.9 + 0.1 * p(block, t) / p(allow, t)) for t in tokens[url])
        assert (r["host"], r["path"]) == plain_parse(url)
        assert r["score"] == pytest.approx(score, abs=1e-6), url
        assert (r["rule"], r["verdict"]) == (rule or (None, "block" if score > 0 else "allow")), url
    verdict = {r["row"]["url"]: r["verdict"] for r in found}
    assert [verdict[u] for u in URLS[:6]] == ["block", "block", "block", "allow", "allow", "block"]


def test_no_pages(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# 13


def plain_field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, fanout):
    """Root and the siblings of every leaf, level by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for leaf, node in enumerate(at):
            run, slot = runs[node // fanout], node % fanout
            paths[leaf].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        at, level = [n // fanout for n in at], [plain_h(*run) for run in runs]
    return level[0], paths


def plain_manifest(rows, fanout):
    sources = defaultdict(list)
    for row in rows:
        doc_id, source, lang, n_chars, text = row[:5]
        head = "".join(map(plain_field, (doc_id, source, lang, n_chars)))
        sources[source].append((doc_id, plain_h(head, plain_field(text)), plain_h(head, plain_field(row[5]))))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
        trees[s] = plain_tree([r[1] for r in sources[s]], fanout)
    root, above = plain_tree([trees[s][0] for s in order], fanout)
    out = []
    for s, upper in zip(order, above):
        for (doc_id, leaf, claimed), path in zip(sources[s], trees[s][1]):
            path, claim = path + upper, claimed
            for ahead, behind in path:
                claim = plain_h(ahead, claim, behind)
            out.append((doc_id, leaf, trees[s][0], root, [tuple(p) for p in path], claimed, claim))
    return sorted(out, key=repr)


MANIFEST = "doc_id long, source string, lang string, n_chars long, text string, claimed_text string, tree string, node string, place string, digest string"


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest(spark, fanout):
    rng, rows = random.Random(1), []
    for source, n in ((None, 3), ("", 1), ("a", 40), ("é", 17), ("\U0001f600", 1), ("z", 16), ("B", 2)):
        for i in range(n):
            text = rng.choice(("Ab", "", None, "é" * 9, "x" * 5000))
            doc_id = None if i == 2 else rng.randrange(30)
            rows.append((doc_id, source, rng.choice(("en", None)), None if text is None else len(text), text, text if i % 3 else "other", *"pqrs"))
    rows += [rows[10]] * 9
    got = merkle.manifest(spark.createDataFrame(rows, MANIFEST).repartition(4), fanout).collect()
    plain = [(r[0], r[1], r[2], r[3], [tuple(p) for p in r[4]], r[5], r[6]) for r in got]
    assert sorted(plain, key=repr) == plain_manifest(rows, fanout)


def test_single_and_empty_manifest(spark):
    (one,) = merkle.manifest(spark.createDataFrame([(1, "a", "en", 1, "x", "x", *"pqrs")], MANIFEST)).collect()
    assert one.leaf == one.subroot == one.root == one.root_claimed and one.path == []
    assert merkle.manifest(spark.createDataFrame([], MANIFEST)).collect() == []
