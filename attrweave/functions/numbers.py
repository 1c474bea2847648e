"""Numbers: ratios, logarithms and Bayes' rule as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Log-odds beyond which a probability is 0 or 1.
CLAMP = 50.0


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def safe_log(x: Column, least: float = 1e-100) -> Column:
    return F.log(F.greatest(x, F.lit(least)))


def bayes(prior: Column, log_odds: Column, clamp: float = CLAMP) -> Column:
    """The posterior of a prior and a difference of log-likelihoods."""
    return F.when(log_odds > clamp, 1.0).when(log_odds < -clamp, 0.0).otherwise(1 / (1 + F.exp(-log_odds) * (1 - prior) / prior))


def pairs_of(n: Column) -> Column:
    return n * (n - 1) / 2


def significant(x: Column, digits: int = 3) -> Column:
    """x rounded to so many significant digits."""
    power = F.floor(F.log10(F.abs(x)))
    return F.when(x == 0, 0.0).otherwise(F.round(x * F.pow(F.lit(10.0), digits - 1 - power)) / F.pow(F.lit(10.0), digits - 1 - power))


def f_measure(p: Column, r: Column) -> Column:
    return F.when((p < 0) | (r < 0), -1.0).when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
