"""Intervals, exact tests and agreement, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def wilson(hits: Column, n: Column, upper: bool) -> Column:
    """An end of the 95 % interval of a rate, within 0 and 1; (0, 1) where n is 0."""
    p, z2 = hits / F.nullif(n, F.lit(0)), Z * Z
    mid, wide = p + z2 / (2 * n), Z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)
    edge = (mid + wide if upper else mid - wide) / (1 + z2 / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), edge))).otherwise(float(upper))


def log_choose(n: Column, k: Column) -> Column:
    """ln of n over k by Stirling's series with shifted argument: constant work at any n."""
    return _ln_fact(n) - _ln_fact(k) - _ln_fact(n - k)


def _ln_fact(n: Column) -> Column:
    x = n + F.lit(11.0)  # ln n! = ln gamma(n + 1); gamma is shifted up by ten, where the series is exact to 1e-14
    series = (x - 0.5) * F.ln(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    shift = F.ln(n + 1.0)
    for i in range(2, 11):
        shift = shift + F.ln(n + float(i))
    return series - shift


#: Terms of the tail that are added; later ones are below 1e-17 of the largest by then, or there are none.
TERMS_SPAN = 12.0


def fisher_at_least(hits: Column, n: Column, other_hits: Column, other_n: Column) -> Column:
    """One-sided exact p: that `hits` of n or more come from the pooled hits; 1 where a margin is empty.

    Terms fall off at both sides of the mode at least as fast as a normal curve's, so those
    within some TERMS_SPAN deviations of it (and of `hits`, if that is further out) are all that
    count. That is a few times the square root of n, which memory holds at any n.
    """
    pooled, total = hits + other_hits, n + other_n
    log_p = lambda x: log_choose(n, x) + log_choose(other_n, pooled - x) - log_choose(total, pooled)
    mean = n.cast("double") * pooled / total
    spread = F.sqrt(mean * (1 - pooled / total) * (other_n.cast("double") / F.greatest(total - 1, F.lit(1)))) * TERMS_SPAN + 50
    most = F.least(n, pooled, F.ceil(F.greatest(mean, hits.cast("double")) + spread).cast("long"))
    least = F.greatest(hits, F.floor(mean - spread).cast("long"))
    tail = F.aggregate(F.sequence(least, F.greatest(least, most)), F.lit(0.0), lambda acc, x: acc + F.exp(log_p(x)))
    empty = (n == 0) | (other_n == 0) | (pooled == 0) | (pooled == total)
    return F.when(empty, 1.0).otherwise(F.least(F.lit(1.0), tail))


def kappa_reading(k: Column) -> Column:
    """Words for Cohen's kappa."""
    out = F.when(k > 0.80, "almost perfect").when(k > 0.60, "substantial").when(k > 0.40, "moderate")
    return out.when(k > 0.20, "fair").otherwise("poor")
