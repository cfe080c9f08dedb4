"""Stability arithmetic: how many of n attempts must succeed, and how likely that is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_mean(x: Column | str) -> Column:
    """The mean of a group's doubles as the decimals they are printed as, in any order of the rows.

    A sum of doubles depends on its order in the last digits, which decides where
    the mean lies on a bound.  Digits past the 18th decimal are rounded; where a
    value or the sum has no such decimal, as NaN and infinities, it is the plain mean.
    """
    x = F.col(x) if isinstance(x, str) else x
    decimal = x.try_cast("decimal(38,18)")
    total = F.when(F.count(decimal) == F.count(x), F.try_sum(decimal))
    return F.coalesce(total.cast("double") / F.nullif(F.count(x), F.lit(0)), F.avg(x))


def whole(x: Column) -> Column:
    """The floor as a double; floor() gives a long, which turns NaN to 0 and cuts what is beyond a long."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def required_successes(n: Column) -> Column:
    """Two thirds, rounded up; fewer than one attempt raises an error."""
    return F.when(n < 1, F.raise_error(F.lit("at least one attempt is required")).cast("int")).otherwise(F.floor((n * 2 + 2) / 3).cast("int"))


def threshold_strictness(n: Column) -> Column:
    return required_successes(n) / n


def reporting_probability(rate: Column, n: Column) -> Column:
    """The chance of reaching the required successes: the upper tail of the binomial distribution.

    A rate outside 0 to 1 raises an error.
    """
    rate = F.when((rate < 0) | (rate > 1) | F.isnan(rate), F.raise_error(F.lit("a rate lies between 0 and 1")).cast("double")).otherwise(rate)
    start = F.struct(F.lit(1.0).alias("ways"), F.lit(0.0).alias("sum"))
    need = required_successes(n)

    def step(acc: Column, k: Column) -> Column:
        term = F.when(k >= need, acc["ways"] * F.pow(rate, k) * F.pow(1 - rate, n - k)).otherwise(0.0)
        return F.struct((acc["ways"] * (n - k) / (k + 1)).alias("ways"), (acc["sum"] + term).alias("sum"))

    return F.aggregate(F.sequence(F.lit(0), n), start, step, lambda acc: F.least(acc["sum"], F.lit(1.0)))
