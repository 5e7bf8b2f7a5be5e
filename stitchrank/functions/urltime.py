"""URL and timestamp columns (P8-P12). Independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stitchrank.functions.text import strip

MILLIS_FROM = 10**12  # a larger epoch value counts milliseconds, a smaller one seconds
# Seconds a nanosecond timestamp can hold (years 1677-2262); others have no calendar keys.
MAX_ABS_SECONDS = 9_223_372_036
# Seconds a microsecond timestamp can hold (to year 294247), for callers that want later times too.
LAST_SECONDS = 9_223_372_036_854


def url_ts(url: Column) -> Column:
    """First non-blank ``ts`` value of the query string as a bigint, else NULL."""
    before_fragment = F.substring_index(strip(url), "#", 1)
    query = F.regexp_extract(before_fragment, r"\?(.*)$", 1)
    raw = F.regexp_extract(query, r"(?:^|&)ts=([^&]+)", 1)
    text = strip(F.coalesce(F.try_url_decode(raw), raw))
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def ts_seconds(ts: Column) -> Column:
    """Epoch value in seconds as a double."""
    return F.when(ts >= MILLIS_FROM, ts.cast("double") / F.lit(1000.0)).otherwise(ts.cast("double"))


def ts_timestamp(ts: Column, tz: str = "UTC", last: int = MAX_ABS_SECONDS) -> Column:
    """Wall-clock TIMESTAMP_NTZ in ``tz``; NULL outside the supported range, which ends ``last`` seconds after 1970."""
    thousand = F.lit(1000).cast("bigint")
    millis = F.when(ts >= MILLIS_FROM, ts).when(ts.between(-MAX_ABS_SECONDS, last), ts * thousand)
    millis = F.when(millis.between(-MAX_ABS_SECONDS * 1000, last * 1000), millis)
    day = F.lit(86_400_000).cast("bigint")
    seconds = (F.pmod(millis, day).cast("decimal(20,0)") / F.lit(1000)).cast("decimal(18,6)")
    utc = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(F.floor(millis / day).cast("int"), secs=seconds)
    if tz.upper() == "UTC":
        return utc
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def calendar_keys(ts: Column, tz: str = "UTC", last: int = MAX_ABS_SECONDS) -> Column:
    """P10: struct ``datetime`` (ISO), ``date``, ``month`` (YYYY-MM), ``quarter`` (YYYY-Qn); years after 9999 have more digits."""
    local = ts_timestamp(ts, tz, last)
    day = local.cast("date")
    number = F.year(day).cast("string")
    year = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    date = F.concat_ws("-", year, _two(F.month(day)), _two(F.dayofmonth(day)))
    date = F.when(day.isNotNull(), date)
    micros = F.when(ts >= MILLIS_FROM, F.pmod(ts, F.lit(1000).cast("bigint"))).otherwise(F.lit(0))
    fraction = F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 3, "0"), F.lit("000")))
    if tz.upper() == "UTC":
        offset = F.lit("+00:00")
    else:
        utc = ts_timestamp(ts, last=last)
        minutes = F.timestamp_diff("MINUTE", utc, local)
        offset = F.concat(
            F.when(minutes < 0, "-").otherwise("+"),
            _two(F.floor(F.abs(minutes) / 60)),
            F.lit(":"),
            _two(F.abs(minutes) % 60),
        )
    clock = F.concat_ws(":", _two(F.hour(local)), _two(F.minute(local)), _two(F.second(local)))
    iso = F.concat(date, F.lit("T"), clock, F.coalesce(fraction, F.lit("")), offset)
    return F.struct(
        iso.alias("datetime"),
        date.alias("date"),
        F.concat(year, F.lit("-"), _two(F.month(day))).alias("month"),
        F.concat(year, F.lit("-Q"), F.quarter(day).cast("string")).alias("quarter"),
    )


def delta_hours(a: Column, b: Column) -> Column:
    """Absolute distance of two epoch values in hours; NULL if either is missing."""
    return F.abs(ts_seconds(a) - ts_seconds(b)) / F.lit(3600.0)


def article_code(url: Column) -> Column:
    """Article code of the last path segment naming a ``.jpg``; NULL if there is none."""
    images = F.filter(F.reverse(F.split(url, "/")), lambda part: F.contains(part, F.lit(".jpg")))
    last = F.try_element_at(images, F.lit(1))
    return F.substring_index(F.substring_index(last, ".jpg", 1), "-", 1)
