"""Operator 12: verdicts on URLs by rules, else by naive Bayes over the words of hosts and paths."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stitchrank.llm.common import bounded, table, written

RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
# Examples of the class to block: words of names and paths that the classifier is given as seeds.
UNWANTED = (
    "adult escort nude porn sex xxx bet bets betting bingo casino gambling jackpot poker slots cheap diet pharmacy pills viagra "
    "ads adserver banner clicks doubleclick popup track tracker tracking spam scam phishing malware warez crack keygen torrent "
    "free win winner prize loan loans payday replica"
).split()
LONGEST = 20  # letters of a word in a name
# Of the words of a page to block, the share that is unwanted; its other words are like those of any page.
SHARE = 0.1
SMALL = 0.01  # added to every count
RARE = 1e-6  # smallest share of the corpus's words that a seed counts for when names are split
MOST_WEIGHTS = 1_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: str = "url") -> Column:
    """What is between the first ``://`` and ``/ ? #`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"\A(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: str = "url") -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"\A(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def decided(rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits ``host`` and ``path``, else null.

    A rule fits its host and every subdomain, if the path starts with the rule's.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def letters(text: Column) -> Column:
    """Runs of letters and runs of digits of a text, the latter as ``0``."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}+|\p{Nd}+)"), 1), lambda x: F.when(x.rlike(r"\A\p{L}"), x).otherwise(F.lit("0")))


# Names


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """(word, n): the lower-cased words of at most ``LONGEST`` letters in all texts; markup is left out."""
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"<[^<>]*>", " "))
    words = texts.select(F.explode(F.regexp_extract_all(plain, F.lit(r"(\p{L}+)"), 1)).alias("word"))
    return words.where(F.length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n"))


def best_split(name: str, counts: dict[str, float], total: float) -> list[str]:
    """The words whose product of unigram probabilities is largest (Viterbi); a run that is no word of l letters has 10 / (total * 10^l).

    Of equal splits the one whose last word is longest.
    """
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        ways = []
        for start in range(max(0, end - LONGEST), end):
            word = name[start:end]
            n = counts.get(word)
            p = math.log10(n / total) if n else 1 - math.log10(total) - len(word)
            ways.append((best[start][0] + p, -start))
        top = max(ways)
        best.append((top[0], -top[1]))
    words, end = [], len(name)
    while end:
        start = best[end][1]
        words.append(name[start:end])
        end = start
    return words[::-1]


def _splits(total: float):
    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            names, lists = batch.column("name").to_pylist(), batch.column("known").to_pylist()
            words = [best_split(n, {x["word"]: x["n"] for x in known if x["word"]}, total) for n, known in zip(names, lists)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(words, pa.list_(pa.string()))], ["name", "words"])

    return run


def split_names(names: DataFrame, counts: DataFrame, seeds: Sequence[str] = tuple(UNWANTED)) -> DataFrame:
    """(name, words) of distinct names of letters.

    The lexicon grows with the corpus and is not broadcast: each name's runs of letters (at most ``LONGEST`` a letter)
    are joined with it, and the words found go to the name. Seeds count as words of the lexicon.
    """
    spark = names.sparkSession
    names = names.where("name <> ''").distinct()
    seed = spark.createDataFrame([(w,) for w in sorted(set(seeds))], "word string").withColumn("seed", F.lit(1))
    # One row of two numbers.
    total = float(counts.agg(F.sum("n")).first()[0] or 0) + len(set(seeds))
    lexicon = counts.join(F.broadcast(seed), "word", "left").where("seed is null").select("word", F.col("n").cast("double").alias("n")).unionByName(
        seed.join(counts, "word", "left").select("word", F.greatest(F.coalesce("n", F.lit(0)) + F.lit(1.0), F.lit(total * RARE)).alias("n"))
    )
    runs = F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.length("name")),
        lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("name") - i + 1)), lambda n: F.substr(F.col("name"), i, n)),
    )))
    found = names.select("name", F.explode(runs).alias("word")).join(lexicon, "word")
    # Names without any known word keep an empty list.
    known = names.select("name", F.lit(None).cast("string").alias("word"), F.lit(None).cast("double").alias("n")).unionByName(found.select("name", "word", "n"))
    return known.groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known")).mapInArrow(_splits(total), "name string, words array<string>")


def host_words(hosts: DataFrame, counts: DataFrame, seeds: Sequence[str] = tuple(UNWANTED)) -> DataFrame:
    """(host, words) of distinct hosts: their runs of letters split into words, digits as ``0``, in order."""
    parts = hosts.select("host", F.posexplode(letters(F.col("host"))).alias("at", "part"))
    split = split_names(parts.select(F.col("part").alias("name")).where("part <> '0'"), counts, seeds)
    each = parts.join(split, parts["part"] == split["name"], "left").select("host", "at", F.coalesce("words", F.array("part")).alias("words"))
    lists = each.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("lists"))
    return lists.select("host", F.flatten(F.transform("lists", lambda x: x["words"])).alias("words"))


# Verdicts


def weights(tokens: DataFrame, seeds: Sequence[str] = tuple(UNWANTED), share: float = SHARE) -> DataFrame:
    """(token, weight): log odds of a multinomial naive Bayes model.

    ``tokens`` (token, n, seeded) counts the tokens of all pages, apart for pages that hold a seed (class block) and others (class
    allow); a seed counts once more for block. A token of a page to block comes from the block counts with
    probability ``share`` and else from the allow counts, so ordinary words weigh next to nothing on either side. A page counts a
    token once, so that no endless URL decides what all others are compared with.
    """
    spark = tokens.sparkSession
    examples = spark.createDataFrame([(w, 1, True) for w in sorted(set(seeds))], "token string, n long, seeded boolean")
    sums = tokens.unionByName(examples).groupBy("token").agg(
        F.coalesce(F.sum(F.when(F.col("seeded"), F.col("n"))), F.lit(0)).alias("block"), F.coalesce(F.sum(F.when(~F.col("seeded"), F.col("n"))), F.lit(0)).alias("allow")
    )
    sums = written(sums)
    # One row of three numbers.
    block, allow, kinds = sums.agg(F.sum("block"), F.sum("allow"), F.count("*")).first()
    blocked = (F.col("block") + SMALL) / (block + SMALL * kinds)
    allowed = (F.col("allow") + SMALL) / (allow + SMALL * kinds)
    return sums.select("token", F.log(F.lit(1 - share) + F.lit(share) * blocked / allowed).alias("weight"))


def judge(pages: DataFrame, corpus: DataFrame | None = None, column: str = "html", rules=RULES, seeds: Sequence[str] = tuple(UNWANTED)) -> DataFrame:
    """``row`` (all columns of ``pages``), host, path, rule, verdict, score and words of every row.

    The longest rule that fits decides; other URLs are blocked where the sum of their tokens' log odds is above 0,
    and allowed else (also null, empty and unparsable ones, which have no tokens: score 0). Names are split by the
    words of ``corpus`` (default: ``pages``), text ``column``. Rows may repeat; an empty table gives no rows.
    """
    spark = pages.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row")
    parsed = pages.select(row, host().alias("host"), path().alias("path")).withColumn("shape", F.array_join(letters(F.translate("path", UPPER, LOWER)), " "))
    # Pages of one host and form of path are counted before anything is shuffled by host.
    kinds = written(parsed.groupBy("host", "shape").agg(F.count("*").alias("n")))
    counts = written(word_counts(pages if corpus is None else corpus, column))
    named = host_words(kinds.select("host").distinct(), counts, seeds)
    tokens = kinds.join(named, "host", "left").select(
        "host", "shape", "n", F.coalesce("words", F.array().cast("array<string>")).alias("words"),
        F.filter(F.split("shape", " "), lambda x: x != "").alias("steps"),
    )
    # A word of a name and the same word of a path are tokens of their own; the seeds are words of either.
    wanted = F.array(*[F.lit(w) for w in seeds])
    marked = lambda words, mark: F.transform(words, lambda w: F.when(F.array_contains(wanted, w), w).otherwise(F.concat(F.lit(mark), w)))
    tokens = written(tokens.select(
        "host", "shape", "n", "words", F.array_distinct(F.concat(marked(F.col("words"), "host:"), marked(F.col("steps"), "path:"))).alias("tokens"),
        F.arrays_overlap(F.concat("words", "steps"), wanted).alias("seeded"),
    ))
    model = bounded(written(weights(tokens.select(F.explode("tokens").alias("token"), "n", F.coalesce("seeded", F.lit(False)).alias("seeded")), seeds)), MOST_WEIGHTS)
    scores = tokens.select("host", "shape", F.explode("tokens").alias("token")).join(model, "token").groupBy("host", "shape").agg(F.sum("weight").alias("score"))
    scored = tokens.select("host", "shape", "words").join(scores, ["host", "shape"], "left")
    scored = scored.select("host", "shape", "words", F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))
    found = parsed.join(bounded(written(scored), MOST_WEIGHTS // 10), ["host", "shape"], "left").withColumn("decided", decided(rules))
    method = F.when(F.col("score") > 0, "block").otherwise("allow")
    return found.select("row", "host", "path", F.col("decided.rule").alias("rule"), F.coalesce("decided.verdict", method).alias("verdict"), "score", "words")


def op12_url_filter(spark, sf_dir):
    found = judge(table(spark, sf_dir, "pages"))
    return found.select("row.page_id", "host", "path", "rule", "verdict", "score")
