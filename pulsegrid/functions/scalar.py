"""Scalar expressions: null in, null out, no exception on a zero divisor."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "UNKNOWN"


def safe_divide(n: Column, d: Column) -> Column:
    """``n / d``; null where the divisor is zero or not finite."""
    d = d.cast("double")
    finite = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf")) & (d != 0)
    return F.when(finite, n / F.when(finite, d))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def clip_low(c: Column, low: float = 0.0) -> Column:
    """At least ``low``; null stays null."""
    return F.when(c < low, F.lit(low)).otherwise(c)


def log_compress(c: Column) -> Column:
    """``log1p(max(v, 0))``; null stays null."""
    return F.log1p(clip_low(c))


def row_mean(cols: list[Column]) -> Column:
    """Mean across columns, passing over nulls; null where all are."""
    filled = [F.coalesce(c, F.lit(0.0)) for c in cols]
    count = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1).otherwise(0) for c in cols])
    return F.when(count > 0, reduce(lambda a, b: a + b, filled) / F.greatest(count, F.lit(1)))


def logistic(score: Column, healthy: Column, failure: Column) -> Column:
    """Falls from about 0.95 at the healthy anchor to about 0.05 at the failure anchor."""
    z = (score - (healthy + failure) / 2) / ((failure - healthy) / 6.0)
    bounded = F.when(z > 700, 700.0).when(z < -700, -700.0).otherwise(z)
    return 1.0 / (1.0 + F.exp(bounded))


def phm_score(percent_error: Column) -> Column:
    """Challenge score: 1 for no error; late predictions (negative) fall off faster."""
    return F.when(percent_error <= 0, F.pow(F.lit(2.0), percent_error / 5)).otherwise(F.pow(F.lit(2.0), -percent_error / 20))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds between two timestamps as a double."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def seconds_of_day(hour: Column, minute: Column, second: Column) -> Column:
    return hour * 3600 + minute * 60 + second


def hours(seconds: Column) -> Column:
    return seconds / 3600.0


def corr_or_null(a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate; null where either side is constant."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 0, F.covar_pop(a, b) / F.when(spread > 0, spread))


def posix_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(posix_path(path), "/"), -1)


def condition_of(label: Column) -> Column:
    """The first number of a ``BearingC_N`` label."""
    return F.regexp_extract(label, r"Bearing(\d+)_", 1).try_cast("int")
