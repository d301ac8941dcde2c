"""Column helpers: calendar keys, durations, buckets, safe ratios, rounding."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = [
    "month_start", "day_of", "hours_between", "month_index", "weekday_index",
    "ratio", "interval_bucket", "clipped_log1p", "logit", "great_circle_km",
    "nan_to_null", "rounded", "same_text", "log_mean", "zero_date",
]

EARTH_RADIUS_KM = 6371.0


def month_start(ts) -> Column:
    """First day of the month as DATE; works for zoned and zone-free timestamps."""
    return F.trunc(F.col(ts).cast("date") if isinstance(ts, str) else ts.cast("date"), "MM")


def day_of(ts) -> Column:
    return (F.col(ts) if isinstance(ts, str) else ts).cast("date")


def hours_between(start, end) -> Column:
    """Whole hours from start to end, truncated toward zero (30 min late is 0)."""
    return F.timestamp_diff("HOUR", F.col(start) if isinstance(start, str) else start,
                            F.col(end) if isinstance(end, str) else end)


def month_index(d, base_year: int = 2017) -> Column:
    d = F.col(d) if isinstance(d, str) else d
    return (F.year(d) - F.lit(base_year)) * 12 + F.month(d)


def weekday_index(ts) -> Column:
    """Monday = 0 (the base is our choice)."""
    return F.weekday(F.col(ts) if isinstance(ts, str) else ts)


def ratio(num: Column, den: Column) -> Column:
    """num / den as DOUBLE, NULL when the denominator is zero or NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def interval_bucket(value: Column, bounds) -> Column:
    """Left-open, right-closed buckets given as (code, low, high); None is unbounded."""
    def inside(lo, hi):
        tests = ([value > lo] if lo is not None else []) + ([value <= hi] if hi is not None else [])
        return reduce(lambda a, b: a & b, tests, value.isNotNull())
    out = F.lit(None).cast("string")
    for code, lo, hi in reversed(list(bounds)):
        out = F.when(inside(lo, hi), F.lit(code)).otherwise(out)
    return out


def clipped_log1p(x: Column) -> Column:
    return F.when(x.isNotNull(), F.log1p(F.greatest(x.cast("double"), F.lit(0.0))))  # greatest skips NULL


def logit(p: Column, eps: float = 1e-9) -> Column:
    q = F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps)))
    return F.log(q / (F.lit(1.0) - q))


def log_mean(a: Column, b: Column) -> Column:
    """Logarithmic mean of two positive numbers; the common value when they are equal."""
    return F.when(a == b, a).otherwise((a - b) / F.log(a / b))


def great_circle_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    r = math.pi / 180
    h = (F.pow(F.sin((lat2 - lat1) * r / 2), 2)
         + F.cos(lat1 * r) * F.cos(lat2 * r) * F.pow(F.sin((lng2 - lng1) * r / 2), 2))
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.when(h.isNotNull(), F.least(h, F.lit(1.0)))))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL differ in Spark; results are stored with NULL only."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select([F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c)
                      for c in df.columns])


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round for presentation only, named columns to the given digits (half up)."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), n) + F.lit(0.0)
                           for c, n in digits.items()})


def same_text(a: Column, b: Column) -> Column:
    """Equality that ignores case and accents."""
    return F.collate(a, "UNICODE_CI_AI") == F.collate(b, "UNICODE_CI_AI")


def zero_date(ts: Column) -> Column:
    """Zero dates are found by range, never by equality."""
    return ts < F.lit("1000-01-01").cast("timestamp_ntz")
