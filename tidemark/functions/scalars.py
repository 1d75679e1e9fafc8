"""Column helpers that keep one null discipline: a missing value is NULL, a predicate on it is false, arithmetic on it is NULL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "__MISSING__"


def require(df: DataFrame, columns: Iterable[str], what: str) -> None:
    """Raises ValueError that lists the columns that df lacks."""
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{what}: missing columns {lacking}")


def number(c: Column) -> Column:
    """Safe DOUBLE: what can't be parsed, NaN and infinities are NULL."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def identifier(c: Column) -> Column:
    """Text form of an id, without the '.0' that a detour over floats leaves."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def composite_key(*columns: Column) -> Column:
    """One text of several columns, joined by '|'; a missing part is 'nan'."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("nan")) for c in columns])


def flag(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False)).cast("int")


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds a value; NULL stays NULL."""
    x = c
    if low is not None:
        x = F.greatest(x, F.lit(low))
    if high is not None:
        x = F.least(x, F.lit(high))
    return F.when(c.isNotNull(), x)


def probability(c: Column) -> Column:
    """NULL outside [0, 1]."""
    return F.when(c.between(0, 1), c)


def logit(p: Column, eps: float = 1e-5) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def share(n: Column, strength: float) -> Column:
    """n / (n + strength), with n at least 0."""
    x = clip(n.cast("double"), 0.0)
    return x / (x + strength)


def smoothed(total: Column, n: Column, prior: Column, m: float) -> Column:
    """Empirical-Bayes rate; NULL without observations."""
    return F.when(n > 0, F.try_divide(total + m * prior, n + m))


def finalize(df: DataFrame, categorical: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Categoricals to strings with the missing literal, all else (but `keep`) to FLOAT without infinities."""
    names, kept = set(categorical), set(keep)
    return df.select(*[F.col(c) if c in kept else F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) if c in names else number(F.col(c)).cast("float").alias(c) for c in df.columns])
