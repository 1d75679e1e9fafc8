"""Entity resolution between two logs without a shared key: sessions, sequence fingerprints, votes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import EARLIER_RANGES, UP_TO_HERE, null_safe_join, numbered, over_ranges, ranged, within
from .tables import only_unique

C = F.col


def differs(a: Column, b: Column) -> Column:
    """Inequality to which a missing side counts as different."""
    return F.coalesce(a != b, F.lit(True))


def falls(a: Column, b: Column) -> Column:
    """a < b, false where either is missing."""
    return F.coalesce(a < b, F.lit(False))


def sessions(log: DataFrame, period: str, order: str, change: list[str], fall: list[str], rows: int | None = None) -> DataFrame:
    """Adds `session` (counted from 1 within the period) and `place` (from 1 within the session).

    A session starts with a period, where a `change` column differs from the row before, or where a `fall` column gets smaller. A period
    is cut into ranges of its order where it is large; a row per range then tells whether the next one opens a session, how many came
    before it and where the last one began."""
    state = list(dict.fromkeys([*change, *fall]))

    def starts(now, before) -> Column:
        out = F.lit(False)
        for c in change:
            out = out | differs(now(c), before(c))
        for c in fall:
            out = out | falls(now(c), before(c))
        return out

    w = within([period], [order])
    local, parts = ranged(log, [period], [order], rows)
    local = local.withColumn("_rn", F.row_number().over(w))
    local = local.withColumn("_start", F.when(F.col("_rn") > 1, starts(F.col, lambda c: F.lag(c).over(w))).otherwise(F.lit(False)).cast("int"))
    if parts == 1:
        at = local.withColumns({"_rows": F.lit(0), "_before": F.lit(1), "_since": F.lit(1)})
    else:
        at = null_safe_join(local, _opening(local, period, order, state, starts), [period, "_range"])
    here = F.max(F.when(F.col("_start") == 1, F.col("_rows") + F.col("_rn"))).over(w.rowsBetween(*UP_TO_HERE))
    found = at.withColumn("session", F.col("_before") + F.sum("_start").over(w.rowsBetween(*UP_TO_HERE)))
    found = found.withColumn("place", (F.col("_rows") + F.col("_rn") - F.greatest("_since", here) + 1).cast("int"))
    return found.drop("_range", "_rn", "_start", "_rows", "_before", "_since")


def _opening(local: DataFrame, period: str, order: str, state: list[str], starts: Callable) -> DataFrame:
    """Per range: rows and sessions of the period before it, its own first session included if it opens one, and where the last of these began."""
    row = F.struct(*state)
    each = local.groupBy(period, "_range").agg(
        F.count("*").alias("_n"), F.sum("_start").alias("_inside"), F.max(F.when(F.col("_start") == 1, F.col("_rn"))).alias("_last"), F.min_by(row, order).alias("_head"), F.max_by(row, order).alias("_tail")
    )
    o = over_ranges([period])
    each = each.withColumn("_tail_before", F.lag("_tail").over(o))
    opens = F.when(F.row_number().over(o) == 1, F.lit(True)).otherwise(starts(lambda c: F.col("_head")[c], lambda c: F.col("_tail_before")[c]))
    each = each.withColumn("_opens", opens.cast("int")).withColumn("_rows", F.coalesce(F.sum("_n").over(o.rowsBetween(*EARLIER_RANGES)), F.lit(0)))
    each = each.withColumn("_before", F.coalesce(F.sum(F.col("_inside") + F.col("_opens")).over(o.rowsBetween(*EARLIER_RANGES)), F.lit(0)) + F.col("_opens"))
    latest = F.greatest(F.col("_rows") + F.col("_last"), F.when(F.col("_opens") == 1, F.col("_rows") + 1))
    each = each.withColumn("_since", F.greatest(F.max(latest).over(o.rowsBetween(*EARLIER_RANGES)), F.when(F.col("_opens") == 1, F.col("_rows") + 1)))
    return each.select(period, "_range", "_rows", "_before", "_since")


def sequence_text(states: list[str], order: str) -> Column:
    """An aggregate: the group's rows in order, their states joined by '|' and ';'. A missing state is 'nan', which no empty one equals."""
    state = F.concat_ws("|", *[F.coalesce(F.col(s).cast("string"), F.lit("nan")) for s in states])
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), state.alias("s"))))
    return F.array_join(F.transform(rows, lambda r: r["s"]), ";")


def fingerprints(rows: DataFrame, by: list[str], states: list[str], order: str, name: str = "fingerprint", place: str | None = None) -> DataFrame:
    """(by, fingerprint) of each group's sequence of states: equal for equal sequences.

    A row's hash covers its place in the group and its state, and the group's fingerprint is the sum of its rows' hashes in five pieces of 32
    bits, with their number. Sums merge, so no group's rows are collected, and a hot group is added up by many tasks. place: the column that
    already has the row's place, else rows are numbered (in ranges). A missing state is no empty one."""
    at = rows if place else numbered(rows.select(*by, *states, order), by, [order], "_place")
    text = F.concat_ws("|", *[F.coalesce(F.concat(F.length(C(s).cast("string")).cast("string"), F.lit(":"), C(s).cast("string")), F.lit("nan")) for s in states])
    at = at.select(*by, F.sha2(F.concat(C(place or "_place").cast("string"), F.lit("/"), text), 256).alias("_h"))
    pieces = [F.sum(F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("long")).cast("string") for i in range(5)]
    return at.groupBy(*by).agg(F.concat_ws("-", F.count("*").cast("string"), *pieces).alias(name))


def with_both(df: DataFrame, group: list[str], column: str, values: list) -> DataFrame:
    """Rows of groups in which the column takes all of the values."""
    full = df.groupBy(*group).agg(*[F.bool_or(F.col(column) == v).alias(f"_h{i}") for i, v in enumerate(values)])
    for i in range(len(values)):
        full = full.filter(f"_h{i}")
    return df.join(full.select(*group), group, "left_semi")


def most_common(rows: DataFrame, group: list[str], column: str) -> DataFrame:
    """The group's most frequent value, the smallest of equals."""
    return rows.groupBy(*group).agg(F.mode(column, True).alias(column))


def seed_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of the rows whose key occurs once on each side and has no missing part."""
    return only_unique(left, keys).join(only_unique(right, keys), keys)


def matched_groups(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id) of groups whose keys, a sequence fingerprint among them, occur once on each side."""
    return only_unique(left, keys).join(only_unique(right, keys), keys).select(left_id, right_id)


def votes(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """(source, target, votes, total, purity) per pair of ids that rows put together."""
    counted = pairs.groupBy(source, target).agg(F.count("*").alias("votes"))
    total = F.sum("votes").over(Window.partitionBy(source))
    return counted.withColumn("total", total).withColumn("purity", F.col("votes") / F.col("total"))


def winners(voted: DataFrame, source: str, target: str) -> DataFrame:
    """Per source the target with most votes, the larger id of equals."""
    best = F.max_by(F.struct(target, "votes", "purity"), F.struct("votes", target))
    return voted.groupBy(source).agg(best.alias("b")).select(source, f"b.{target}", "b.votes", "b.purity")
