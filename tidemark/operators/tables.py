"""Joins with checks, de-duplication, set checks and column summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .history import null_safe_join
from .ranges import running


def assert_unique(df: DataFrame, keys: list[str], what: str) -> None:
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"{what}: duplicate keys in {keys}")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that raises where either side repeats a key."""
    assert_unique(left, keys, "left side")
    assert_unique(right, keys, "right side")
    return left.join(right, keys)


def matched(left: DataFrame, right: DataFrame, keys: dict[str, str], unique: bool = True) -> DataFrame:
    """Inner join on keys with different names (left to right); the right ones go. unique: raises where either side repeats a key."""
    if unique:
        assert_unique(left, list(keys), "left side")
        assert_unique(right, list(keys.values()), "right side")
    other = right.select(*[F.col(c).alias(f"_{c}") if c in keys.values() else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for a, b in keys.items():
        condition = condition & (F.col(a) == F.col(f"_{b}"))
    return left.join(other, condition).drop(*[f"_{b}" for b in keys.values()])


def members(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose value is one of those given; NULL is none of them."""
    return df.filter(F.coalesce(F.col(column).isin(values), F.lit(False)))


def described(df: DataFrame, column: str) -> DataFrame:
    """n, mean, sample deviation, extremes and quartiles of a column, as (statistic, value) rows."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    at = df.agg(F.count(column).cast("double").alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).cast("double").alias("min"), F.max(column).cast("double").alias("max"), q.alias("q"))
    values = {"count": F.col("count"), "mean": F.col("mean"), "std": F.col("std"), "min": F.col("min"), "25%": F.col("q")[0], "50%": F.col("q")[1], "75%": F.col("q")[2], "max": F.col("max")}
    return at.select(F.inline(F.array(*[F.struct(F.lit(n).alias("statistic"), v.alias("value")) for n, v in values.items()])))


def ordered(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Sorted by the columns, and by all others so that the order is total."""
    named = {c for c in columns if isinstance(c, str)}
    return df.orderBy(*columns, *[c for c in df.columns if c not in named])


def top(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first n rows of a total order."""
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, group: list[str], n: int, *order: str | Column) -> DataFrame:
    """The first n rows of each group; tasks keep n of a group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in the order given, which should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def only_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs once and has no NULL."""
    known = df.dropna(subset=keys)
    return known.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter("_n = 1").drop("_n")


def recode(c: Column, codes: dict[str, str]) -> Column:
    """Dictionary lookup; what the dictionary lacks is NULL."""
    pairs = [F.lit(x) for kv in codes.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def missing_profile(df: DataFrame, literal: str = "__MISSING__") -> DataFrame:
    """(name, missing, rate) per column in one pass; the missing literal counts as missing."""
    gone = [F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == literal)).alias(c) for c in df.columns]
    counts = df.agg(F.count("*").alias("_n"), *gone)
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("missing"), F.try_divide(F.col(c), F.col("_n")).alias("rate")) for c in df.columns])
    return counts.select(F.inline(rows))


def sample_per_group(df: DataFrame, group: str, key: str, limit: int | None, seed: int) -> DataFrame:
    """At most `limit` rows of each group in the order of their key, the same for the same seed whatever the partitioning; all rows without a limit."""
    if limit is None:
        return df
    return top_per_group(df, [group], limit, F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string"))), key).orderBy(key)


def percent_ranks(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Adds the rank of the value in its group with ties averaged, over the group's number of values; NULL for NULL. Groups are ranked in ranges of the value."""
    at = running(df.filter(F.col(value).isNotNull()), by, value, {"_below": F.lit(1)})
    totals = at.groupBy(*by).agg(F.sum("_below_here").alias("_total"))
    ranks = null_safe_join(at, totals, by).select(*by, value, ((F.col("_below") + (F.col("_below_here") + 1) / 2) / F.col("_total")).alias(name))
    return null_safe_join(df, ranks, [*by, value])  # a NULL has no rank to meet
