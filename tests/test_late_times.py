from pyspark.sql import functions as F

from stitchrank.functions import urltime


def test_late_times_have_keys_for_callers_that_want_them(spark):
    t = [9_223_372_037, 9_300_000_000_000, 520_104_805_200_123, None, 946_684_800_000]
    df = spark.createDataFrame([(x,) for x in t], "t long")
    got = [r["k"]["datetime"] for r in df.select(urltime.calendar_keys(F.col("t"), last=urltime.LAST_SECONDS).alias("k")).collect()]
    assert got == ["2262-04-11T23:47:17+00:00", "2264-09-14T21:20:00+00:00", "18451-06-19T13:00:00.123000+00:00", None, "31969-04-01T00:00:00+00:00"]
    narrow = [r["k"]["quarter"] for r in df.select(urltime.calendar_keys(F.col("t")).alias("k")).collect()]
    assert narrow == [None] * 5
