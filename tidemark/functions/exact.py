"""Sums, quotients and deviations that don't depend on the order in which rows meet.

A sum of doubles differs in its last digits with the number of tasks, and so does a sum in SQL. Groups of equal values are no ties then, and a mean
halfway between two rounded values falls either way. Here a double counts as the decimal that it prints as, and decimals add up exactly. Groups
with a value that the decimals can't hold (NaN, more places, too large) are summed as doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Places of a value in sums, and of one that is squared.
PLACES, SQUARED = 20, 6
N = "decimal(12,0)"
WHOLE = "decimal(38,0)"


def _printed(x: Column, digits: int, places: int) -> Column:
    """x as the decimal that it prints as, NULL where that has no room."""
    d = x.try_cast(f"decimal({digits},{places})")
    return F.when(d.cast("double") == x, d)


def _units(x: Column, digits: int, places: int) -> Column:
    """How many 10 ** -places x is, a whole number."""
    return (_printed(x, digits, places) * F.lit(10**places)).cast(f"decimal({digits},0)")


def total(x: Column) -> Column:
    """An aggregate: the sum as a double, NULL without values."""
    x = x.cast("double")
    d = _printed(x, 38, PLACES)
    return F.coalesce(F.when(F.count(d) == F.count(x), F.try_sum(d)).cast("double"), F.sum(x))


def total_squares(x: Column) -> Column:
    """An aggregate: the sum of squares as a double, NULL without values."""
    x = x.cast("double")
    d = _printed(x, 18, SQUARED)
    return F.coalesce(F.when(F.count(d) == F.count(x), F.try_sum(d * d)).cast("double"), F.sum(x * x))


def stddev_samp(x: Column) -> Column:
    """An aggregate: the sample deviation, NULL for fewer than two values. Equal variances give equal doubles."""
    x = x.cast("double")
    u = _units(x, 18, SQUARED)
    n = F.count(u).cast(WHOLE)
    squares = F.try_subtract(F.try_multiply(n, F.try_sum(u * u).cast(WHOLE)), F.try_multiply(F.try_sum(u).cast(WHOLE), F.try_sum(u).cast(WHOLE)))  # n times the sum of squares around the mean
    by = n * (n - 1).cast(N)
    rest = F.try_mod(squares, by)
    variance = ((squares - rest) / by).cast("double") + rest.cast("double") / by.cast("double")
    return F.coalesce(F.when((F.count(u) == F.count(x)) & (F.count(u) > 1), F.sqrt(variance) / 10**SQUARED), F.stddev_samp(x))


def quotient(total: Column, n: Column) -> Column:
    """total / n as the double next to it, for a total that prints as at most eight places."""
    exact = F.try_divide(_printed(total, 28, 8), n.cast(N))
    return F.coalesce(exact.cast("double"), F.try_divide(total, n))


def variance(n: Column, total: Column, squares: Column) -> Column:
    """Population variance from additive sums, exact where the total prints as at most four places and the squares as eight."""
    k, t, s = n.cast(WHOLE), _units(total, 28, 4).cast(WHOLE), _units(squares, 28, 8).cast(WHOLE)
    exact = F.try_subtract(F.try_multiply(k, s), F.try_multiply(t, t)).cast("double") / (n.cast("double") * n.cast("double") * 1e8)
    mean = F.try_divide(total, n)
    return F.when(n > 0, F.coalesce(exact, F.greatest(F.try_divide(squares, n) - mean * mean, F.lit(0.0))))
