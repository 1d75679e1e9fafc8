"""Exact quantiles of large groups, without a buffer that holds a group's values.

`percentile` keeps all distinct values of a group in one buffer. Beyond HELD rows an approximate summary of fixed size brackets each
quantile's place first; then the rows below the bracket are counted, and only the values inside it, a few in ten thousand, are put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import EARLIER_RANGES, null_safe_join

C = F.col
#: Rows up to which `percentile` may hold a group's values, some 50 MB.
HELD = 1_000_000
ACCURACY = 10_000
MARGIN = 4 / ACCURACY


def quantiles(df: DataFrame, by: list[str], columns: list[str], shares: list[float], held: int | None = None) -> DataFrame:
    """(by, and per column an array with the quantile of each share, linear between neighbours): NULLs don't count, and a column without a value in its group is NULL."""
    if not by:
        return quantiles(df.withColumn("_all", F.lit(0)), ["_all"], columns, shares, held).drop("_all")
    rows = df.select(*by, *[C(c).cast("double").alias(c) for c in columns])
    if rows.count() <= (HELD if held is None else held):
        return rows.groupBy(*by).agg(*[F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in columns])
    ends = F.array(*[F.lit(x) for q in shares for x in (max(q - MARGIN, 0.0), min(q + MARGIN, 1.0))], F.lit(0.0), F.lit(1.0))
    near = rows.groupBy(*by).agg(*[x for i, c in enumerate(columns) for x in (F.count(c).alias(f"_n{i}"), F.percentile_approx(c, ends, F.lit(ACCURACY)).alias(f"_b{i}"))])
    at = null_safe_join(rows, near, by)
    places = [(i, j) for i in range(len(columns)) for j in range(len(shares))]
    few = lambda i: C(f"_n{i}") <= ACCURACY  # noqa: E731  # all of a small group lies inside
    low = lambda i, j: F.when(few(i), C(f"_b{i}")[2 * len(shares)]).otherwise(C(f"_b{i}")[2 * j])
    high = lambda i, j: F.when(few(i), C(f"_b{i}")[2 * len(shares) + 1]).otherwise(C(f"_b{i}")[2 * j + 1])
    below = at.groupBy(*by).agg(*[F.count_if(C(columns[i]) < low(i, j)).alias(f"_below{i}_{j}") for i, j in places])
    inside = F.array(*[F.when(C(columns[i]).between(low(i, j), high(i, j)), F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), C(columns[i]).alias("v"))) for i, j in places])
    values = at.select(*by, F.explode(F.filter(inside, lambda x: x.isNotNull())).alias("x")).groupBy(*by, "x.i", "x.j", "x.v").agg(F.count("*").alias("k"))
    w = Window.partitionBy(*by, "i", "j").orderBy("v").rowsBetween(*EARLIER_RANGES)
    values = values.withColumn("before", F.coalesce(F.sum("k").over(w), F.lit(0)))
    facts = null_safe_join(near.drop(*[f"_b{i}" for i in range(len(columns))]), below, by)
    found = null_safe_join(values, facts, by).groupBy(*by)

    def value(i: int, j: int):
        rank = (C(f"_n{i}") - 1) * shares[j]
        first = C(f"_below{i}_{j}") + C("before")
        holds = lambda r: F.max(F.when((C("i") == i) & (C("j") == j) & (first <= r) & (r < first + C("k")), C("v")))
        a, b = holds(F.floor(rank)), holds(F.ceil(rank))
        return a + (b - a) * F.max(rank - F.floor(rank))

    out = found.agg(*[value(i, j).alias(f"_q{i}_{j}") for i, j in places])
    whole = null_safe_join(near.select(*by, *[f"_n{i}" for i in range(len(columns))]), out, by)
    missed = F.raise_error(F.lit("a quantile lies outside its bracket"))
    sure = lambda i, j: F.when(C(f"_q{i}_{j}").isNull(), missed.cast("double")).otherwise(C(f"_q{i}_{j}"))
    return whole.select(*by, *[F.when(C(f"_n{i}") > 0, F.array(*[sure(i, j) for j in range(len(shares))])).alias(c) for i, c in enumerate(columns)])

