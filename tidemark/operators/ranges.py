"""Order-dependent values over groups that are too large for one task.

Rows are cut into ranges of (group, order) of about ROWS rows each, so the number of ranges follows the number of rows, and a group that
holds a third of them lies in many. Each range is worked on by itself; a table of one row per range and group in it then carries on what
the group's earlier ranges add. The ranged rows are a table in the shared folder: a lost task gives the same rows again. A NULL comes
first, NULL group keys are a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col
UP_TO_HERE = (Window.unboundedPreceding, 0)
EARLIER_RANGES = (Window.unboundedPreceding, -1)
#: Rows of a range, some 100 MB.
ROWS = 1_000_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys where NULL equals NULL; the keys come from the left."""
    right = right.select(*[C(k).alias(f"_{k}") if k in keys else C(k) for k in right.columns])
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[f"_{k}"])
    return left.join(right, condition, how).drop(*[f"_{k}" for k in keys])


def ranged(df: DataFrame, by: list[str], order: list[str], rows: int | None = None) -> tuple[DataFrame, int]:
    """df with `_range`, which ascends with (by, order), and the number of ranges. Equal (by, order) lie in one range, so order should be total."""
    from ..sources.files import written

    parts = -(-df.count() // (rows or ROWS))
    if parts <= 1:
        return df.withColumn("_range", F.lit(0)), 1
    return written(df.repartitionByRange(parts, *by, *order).withColumn("_range", F.spark_partition_id())), parts


def within(by: list[str], order: list[str]) -> Window:
    return Window.partitionBy("_range", *by).orderBy(*order)


def over_ranges(by: list[str]) -> Window:
    """Over the table of ranges: for each group as many rows as it has ranges."""
    return Window.partitionBy(*by).orderBy("_range")


def carried(rows: DataFrame, parts: int, by: list[str], each: dict[str, Column], later: dict[str, Column]) -> DataFrame:
    """Adds to rows what earlier ranges of their group give, NULL where there are none: `each` is aggregated per range, `later` are expressions over
    the group's earlier ranges (see EARLIER_RANGES). Only the first group of a range can have earlier ones, so that table has a row a range."""
    per = rows.groupBy("_range", *by).agg(*[v.alias(n) for n, v in each.items()])
    per = per.withColumns({"_nth": F.row_number().over(over_ranges(by))} | later).filter("_nth > 1")
    return null_safe_join(rows, F.broadcast(per.select("_range", *by, *later)), ["_range", *by])


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, sums: dict[str, Column] | None = None, rows: int | None = None) -> DataFrame:
    """Adds the row's number within its group, from 1, by a total order, and the `sums` of the group's rows up to and with the row."""
    at, parts = ranged(df, by, order, rows)
    w, values = within(by, order), {name: F.lit(1), **(sums or {})}
    at = at.withColumns({f"_v{i}": v for i, v in enumerate(values.values())})
    here = at.withColumns({n: F.row_number().over(w).cast("long") if i == 0 else F.sum(f"_v{i}").over(w.rowsBetween(*UP_TO_HERE)) for i, n in enumerate(values)})
    gone = ["_range", *[f"_v{i}" for i in range(len(values))]]
    if parts > 1:
        over = over_ranges(by).rowsBetween(*EARLIER_RANGES)
        each = {f"_s{i}": F.sum(f"_v{i}") for i in range(len(values))}
        here = carried(here, parts, by, each, {f"_b{i}": F.sum(f"_s{i}").over(over) for i in range(len(values))})
        here = here.withColumns({n: F.when(C(f"_b{i}").isNull(), C(n)).otherwise(F.coalesce(C(n), F.lit(0)) + C(f"_b{i}")) for i, n in enumerate(values)})
        gone += [f"_b{i}" for i in range(len(values))]
    return here.drop(*gone)


def running(df: DataFrame, by: list[str], order: str, values: dict[str, Column], rows: int | None = None) -> DataFrame:
    """(by, order, and for each of values its sum over the group's rows of a smaller order, and as `<name>_here` over those of this one), a row per distinct order: a tie costs one row however large it is."""
    points = df.groupBy(*by, order).agg(*[F.sum(v).alias(f"{n}_here") for n, v in values.items()])
    at, parts = ranged(points, by, [order], rows)
    w = within(by, [order]).rowsBetween(*EARLIER_RANGES)
    here = at.withColumns({n: F.coalesce(F.sum(f"{n}_here").over(w), F.lit(0)) for n in values})
    if parts > 1:
        over = over_ranges(by).rowsBetween(*EARLIER_RANGES)
        here = carried(here, parts, by, {f"_s_{n}": F.sum(f"{n}_here") for n in values}, {f"_b_{n}": F.coalesce(F.sum(f"_s_{n}").over(over), F.lit(0)) for n in values})
        here = here.withColumns({n: C(n) + F.coalesce(f"_b_{n}", F.lit(0)) for n in values}).drop(*[f"_b_{n}" for n in values])
    return here.drop("_range")


def last_before(df: DataFrame, by: list[str], order: list[str], value: str, name: str, rows: int | None = None) -> DataFrame:
    """Adds the latest value of the group's rows before the row that isn't NULL."""
    at, parts = ranged(df, by, order, rows)
    found = at.withColumn(name, F.last(value, ignorenulls=True).over(within(by, order).rowsBetween(*EARLIER_RANGES)))
    if parts > 1:
        latest = F.max_by(value, F.when(C(value).isNotNull(), F.struct(*order)))
        found = carried(found, parts, by, {"_latest": latest}, {"_carried": F.last("_latest", ignorenulls=True).over(over_ranges(by).rowsBetween(*EARLIER_RANGES))})
        found = found.withColumn(name, F.coalesce(name, "_carried")).drop("_carried")
    return found.drop("_range")
