"""Text, URL and time columns on hand-made values."""

import pytest
from pyspark.sql import functions as F

from stitchrank import fixed_values
from stitchrank.functions import text, urltime, vectors


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(make(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize("value,want", [(None, None), (" \tNaN\n", None), ("none", None), ("", None), (" a b ", "a b")])
def test_null_like(spark, value, want):
    assert one(spark, value, text.null_like) == want


@pytest.mark.parametrize(
    "value,want",
    [
        ('["a","b"]', ["a", "b"]), ("[1, 2]", ["1", "2"]), ("a|b,c", ["a", "b,c"]), ("a, b", ["a", "b"]), ("a;b", ["a", "b"]),
        ("a b", ["a", "b"]), ("solo", ["solo"]), (None, []), ("nan", []), ("|||", ["|||"]), ('["nan", " "]', []), ("[broken", ["[broken"]),
        ("a||none|b", ["a", "b"]),
    ],
)
def test_parse_id_list(spark, value, want):
    assert one(spark, value, text.parse_id_list) == want


def test_parse_id_array(spark):
    assert one(spark, ["a", " ", None, "nan", "b "], lambda c: text.parse_id_list(c, is_array=True), "array<string>") == ["a", "b"]


@pytest.mark.parametrize(
    "value,want",
    [
        ("Shawl/Foulard_x--y", ["shawl", "foulard x y"]), ("  A\tB ,, c;|d ", ["a b", "c", "d"]), (None, []), (" /-_/ ", []),
        ("a, a", ["a", "a"]),
    ],
)
def test_clean_labels(spark, value, want):
    assert one(spark, value, text.clean_labels) == want


def test_drop_excluded(spark):
    got = one(spark, ["perfume", "dress", "matches"], lambda c: text.drop_excluded(c, fixed_values.EXCLUDED_LABELS), "array<string>")
    assert (got["kept"], got["removed"]) == (["dress"], 2)


def test_parse_ks():
    assert text.parse_ks("10, 5,,5") == [5, 10]
    assert text.parse_ks("0,3", positive_only=True) == [3]
    with pytest.raises(ValueError):
        text.parse_ks(" , ")


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://h/a.jpg?ts=&ts=5", 5), ("https://h/a.jpg?ts=abc", None), ("https://h/a.jpg?x=1&ts=17#f", 17), ("https://h/ts=3", None),
        ("https://h/a#?ts=9", None), ("https://h/a?ts=%2B7", 7), ("https://h/a?pts=4", None), (None, None), ("  ", None),
        ("https://h/a?ts=1.5", None), ("https://h/a?ts=-3&ts=4", -3), ("https://h/a?ts=99999999999999999999", None),
    ],
)
def test_url_ts(spark, url, want):
    assert one(spark, url, urltime.url_ts) == want


def test_seconds_and_millis(spark):
    assert one(spark, 1_000_000_000_000, urltime.ts_seconds, "bigint") == 1_000_000_000.0
    assert one(spark, 999_999_999_999, urltime.ts_seconds, "bigint") == 999_999_999_999.0


def test_calendar_keys_do_not_follow_the_session_zone(spark):
    # 2024-12-31 23:30 UTC, session zone New York
    utc = one(spark, 1735687800000, urltime.calendar_keys, "bigint")
    assert tuple(utc) == ("2024-12-31T23:30:00+00:00", "2024-12-31", "2024-12", "2024-Q4")
    madrid = one(spark, 1735687800123, lambda c: urltime.calendar_keys(c, "Europe/Madrid"), "bigint")
    assert tuple(madrid) == ("2025-01-01T00:30:00.123000+01:00", "2025-01-01", "2025-01", "2025-Q1")
    early = one(spark, 1735687800, lambda c: urltime.calendar_keys(c, "America/New_York"), "bigint")
    assert early["datetime"] == "2024-12-31T18:30:00-05:00"
    assert tuple(one(spark, None, urltime.calendar_keys, "bigint")) == (None,) * 4
    assert tuple(one(spark, 946684800000, urltime.calendar_keys, "bigint")) == (None,) * 4  # seconds, far too late


@pytest.mark.parametrize(
    "url,want",
    [("https://h/x/0287-p/0287-p.jpg?ts=1", "0287"), ("https://h/1-e1.jpg/view", "1"), ("https://h/none.png", None), (None, None), ("https://h/-p.jpg", "")],
)
def test_article_code(spark, url, want):
    assert one(spark, url, urltime.article_code) == want


def test_stable_seed_is_the_digest_prefix(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"42||bundle||x||3").digest()[:8], "big")
    got = spark.range(1).select(text.stable_seed(F.lit(42), F.lit("bundle"), F.lit("x"), F.lit(3)).alias("s")).first()["s"]
    assert int(got) == want


def test_vectors(spark):
    assert one(spark, [3.0, 4.0], vectors.l2_normalize, "array<float>") == [0.6, 0.8]
    assert one(spark, [0.0, 0.0], vectors.l2_normalize, "array<float>") == [0.0, 0.0]
    f = one(spark, [1.0, 2.0], lambda c: vectors.pair_features(c, F.reverse(c), sq_diff=True, raw=True), "array<float>")
    assert f == [4.0, 1.0, 1.0, 2.0, 2.0, 1.0, 1.0, 1.0, 2.0, 2.0, 1.0]
    assert len(f) == vectors.feature_dim(2, sq_diff=True, raw=True)


def test_fixed_tables_have_no_double_entries():
    for mapping in (fixed_values.DETECTOR_CLASSES, fixed_values.GARMENT_GROUPS):
        words = [w for group in mapping.values() for w in group]
        assert len(words) == len(set(words))
    assert len(fixed_values.EXCLUDED_LABELS) == len(set(fixed_values.EXCLUDED_LABELS)) == 23
