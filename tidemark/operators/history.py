"""Point-in-time aggregates: a row of a period sees only rows of earlier periods.

The visible past comes from one aggregation per key and period and a RANGE window over the periods, not from a join of rows to
earlier rows. A spine of all keys and periods keeps periods in which a key has no rows of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact
from ..functions.scalars import smoothed
from .ranges import last_before, null_safe_join, numbered

BEFORE = (Window.unboundedPreceding, -1)
LAST = (-1, -1)
EARLIER = (Window.unboundedPreceding, -2)


def period_values(rows: DataFrame, period: str) -> list:
    """The distinct periods, few by nature (seasons), in order."""
    return sorted(r[0] for r in rows.select(period).distinct().collect() if r[0] is not None)


def spine_of(rows: DataFrame, keys: list[str], period: str, periods: list) -> DataFrame:
    """Each distinct key at each period."""
    kind = rows.schema[period].dataType
    each = F.explode(F.array(*[F.lit(p).cast(kind) for p in periods]).cast(f"array<{kind.simpleString()}>")).alias(period)
    return (rows.select(*keys).distinct() if keys else rows.sparkSession.range(1)).select(*keys, each)


def past_sums(rows: DataFrame, keys: list[str], period: str, values: dict[str, Column], frame=BEFORE, periods: list | None = None, frames: dict[str, tuple] | None = None) -> DataFrame:
    """(keys, period, sums of values over the frame's periods) for each key at each of `periods` (those of rows, where not given).

    A value over no rows is NULL. NULL keys form a key. frames: the frames of values that have another one; all share one aggregate and window."""
    per = rows.groupBy(*keys, period).agg(*[F.sum(v).alias(n) for n, v in values.items()])
    spine = spine_of(per, keys, period, period_values(rows, period) if periods is None else periods)
    at = null_safe_join(spine, per, [*keys, period])
    w = Window.partitionBy(*keys).orderBy(period)
    return at.select(*keys, period, *[F.sum(n).over(w.rangeBetween(*(frames or {}).get(n, frame))).alias(n) for n in values])


def smoothed_rates(rows: DataFrame, keys: list[str], period: str, label: str, m: float = 50.0, prior_keys: list[str] = (), frame=BEFORE, periods: list | None = None) -> DataFrame:
    """(keys, period, rate, n): the label's mean over the visible past, drawn by m towards the mean of the prior keys' past, or of all.

    The log is aggregated once, by all keys; the prior's and the whole log's sums are rolled up from that."""
    every = list(dict.fromkeys([*keys, *prior_keys]))
    per = rows.groupBy(*every, period).agg(F.sum(F.col(label).cast("double")).alias("total"), F.count(label).alias("n"))
    periods = period_values(per, period) if periods is None else periods
    sums = lambda prefix: {f"{prefix}total": F.col("total"), f"{prefix}n": F.col("n")}
    own = past_sums(per, list(keys), period, sums(""), frame, periods).filter("n > 0")
    world = past_sums(per, [], period, sums("g_"), frame, periods)
    at = own.join(F.broadcast(world), period, "left")  # a row a period
    prior = F.try_divide(F.col("g_total"), F.col("g_n"))
    if prior_keys:
        at = null_safe_join(at, past_sums(per, list(prior_keys), period, sums("s_"), frame, periods), [*prior_keys, period])
        prior = F.coalesce(F.try_divide(F.col("s_total"), F.col("s_n")), prior)
    return at.select(*keys, period, smoothed(F.col("total"), F.col("n"), prior, m).alias("rate"), "n")


def recent_rates(rows: DataFrame, key: str, period: str, label: str, order: str, last: int, m: float = 20.0) -> DataFrame:
    """(key, period, rate, total, n) over the last rows of the key before the period, in the order given; rows without key are out.

    Prefix sums at two places of a key's rows give the sum between them, so no row meets more than one other, and a hot key's are taken in
    ranges. Periods ascend in that order, which is total within a key."""
    known = rows.filter(F.col(key).isNotNull())
    prefix = numbered(known.select(key, period, order, label), [key], [period, order], "place", {"so_far": F.col(label)})
    visible = past_sums(known, [key], period, {"n_before": F.lit(1).cast("long")}).filter("n_before > 0")
    at = visible.withColumn("low", F.greatest(F.col("n_before") - last, F.lit(0)))
    upper = prefix.select(F.col(key).alias("_k"), F.col("place").alias("_p"), F.col("so_far").alias("high_sum"))
    lower = prefix.select(F.col(key).alias("_k2"), F.col("place").alias("_p2"), F.col("so_far").alias("low_sum"))
    got = at.join(upper, (F.col(key) == F.col("_k")) & (F.col("n_before") == F.col("_p"))).join(lower, (F.col(key) == F.col("_k2")) & (F.col("low") == F.col("_p2")), "left")
    world = past_sums(rows, [], period, {"g_total": F.col(label).cast("double"), "g_n": F.lit(1).cast("long")})
    total, n = F.col("high_sum") - F.coalesce("low_sum", F.lit(0)), F.col("n_before") - F.col("low")
    return got.join(F.broadcast(world), period).select(key, period, smoothed(total, n, F.col("g_total") / F.col("g_n"), m).alias("rate"), total.alias("total"), n.alias("n"))


def last_seen(rows: DataFrame, key: str, period: str) -> DataFrame:
    """(key, period, last_period, gap): the last earlier period in which the key has rows."""
    known = rows.filter(F.col(key).isNotNull()).select(key, period).distinct()
    at = spine_of(known, [key], period, period_values(known, period)).join(known.withColumn("here", F.col(period)), [key, period], "left")
    w = Window.partitionBy(key).orderBy(period).rangeBetween(*BEFORE)
    found = at.select(key, period, F.max("here").over(w).alias("last_period"))
    return found.filter("last_period is not null").withColumn("gap", F.col(period) - F.col("last_period"))


def moments(n: Column, total: Column, squares: Column) -> tuple[Column, Column]:
    """Mean and population deviation from additive sums."""
    mean = F.try_divide(total, n)
    return mean, F.sqrt(F.greatest(F.try_divide(squares, n) - mean * mean, F.lit(0.0)))


def exact_moments(n: Column, total: Column, squares: Column) -> tuple[Column, Column]:
    """Mean and population deviation from exact sums."""
    return exact.quotient(total, n), F.sqrt(exact.variance(n, total, squares))


def sensor_summary(readings: DataFrame, key: str, period: str, metrics: list[str], group: str, groups: list[str], exactly: bool = False) -> DataFrame:
    """Additive summary per key and period: rows, readings of each group (all others as one), and n, sum, squares of each metric. `exactly`: the
    sums are those of the decimals that the readings print as, whatever the order of the rows."""
    add, squared = (exact.total, exact.total_squares) if exactly else (F.sum, lambda x: F.sum(x * x))
    cols = [F.count("*").alias("n_rows"), *[F.count_if(F.col(group) == g).alias(f"usage_{g}") for g in groups], F.count_if(~F.coalesce(F.col(group).isin(groups), F.lit(False))).alias("usage_other")]
    for m in metrics:
        cols += [F.count(m).alias(f"{m}_n"), F.coalesce(add(F.col(m)), F.lit(0.0)).alias(f"{m}_sum"), F.coalesce(squared(F.col(m)), F.lit(0.0)).alias(f"{m}_squares")]
    return readings.filter(F.col(key).isNotNull() & F.col(period).isNotNull()).groupBy(key, period).agg(*cols)


def sensor_history(summary: DataFrame, key: str, period: str, metric: str) -> DataFrame:
    """(key, period, career and previous mean, previous less earlier mean): three frames of one window over one additive summary."""
    n, total = F.col(f"{metric}_n"), F.col(f"{metric}_sum")
    value = {"c_n": n, "c_sum": total, "c_squares": F.col(f"{metric}_squares"), "p_n": n, "p_sum": total, "e_n": n, "e_sum": total}
    at = past_sums(summary, [key], period, value, frames={"p_n": LAST, "p_sum": LAST, "e_n": EARLIER, "e_sum": EARLIER})
    mean, std = moments(F.col("c_n"), F.col("c_sum"), F.col("c_squares"))
    before = F.try_divide(F.col("p_sum"), F.col("p_n"))
    return at.filter("c_n > 0").select(key, period, mean.alias("career_mean"), std.alias("career_std"), before.alias("prev_mean"), (before - F.try_divide(F.col("e_sum"), F.col("e_n"))).alias("delta_mean"))


def sensor_profiles(readings: DataFrame, key: str, period: str, metrics: list[str], first: str, order: str) -> DataFrame:
    """Per key and period: rows, mean and sample deviation of each metric (one reading has none), and the first value of `first` in the order given."""
    cols = [c for m in metrics for c in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))]
    known = F.when(F.col(first).isNotNull(), F.col(order))
    return readings.groupBy(key, period).agg(F.count("*").alias("n"), *cols, F.min_by(first, known).alias(f"first_{first}"))


def mix_shares(readings: DataFrame, keys: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """Per key the share of each of the kinds among its readings of these kinds, 0 for those it lacks; keys without any are absent."""
    known = readings.filter(F.col(kind).isin(kinds))
    return known.groupBy(*keys).agg(*[(F.count_if(F.col(kind) == k) / F.count("*")).alias(f"mix_{k}") for k in kinds])


def coverage(rows: DataFrame, period: str, column: str) -> DataFrame:
    """Per period the share of rows that have a value."""
    return rows.groupBy(period).agg(F.avg(F.col(column).isNotNull().cast("int")).alias("coverage"))


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], tie: str) -> DataFrame:
    """Adds to left the values of the latest right row of its key with a strictly smaller time; of equal times, the row with the largest tie.

    One union, then the last value before each row, carried over ranges of (key, time): no row meets more than its neighbours, and a hot key
    is many tasks' work. Right rows come after left rows of their time."""
    names = left.columns
    best = right.groupBy(key, time).agg(F.max_by(F.struct(*values), tie).alias("_v"))
    rows = left.select(*names, F.lit(0).alias("_side"), F.lit(None).cast(best.schema["_v"].dataType).alias("_v")).unionByName(best.select(key, time, F.lit(1).alias("_side"), "_v"), allowMissingColumns=True)
    found = last_before(rows.withColumn("_at", F.xxhash64(*names)), [key], [time, "_side", "_at"], "_v", "_found").filter("_side = 0").drop("_v").withColumnRenamed("_found", "_v")
    return found.select(*names, *[F.when(F.col(key).isNotNull(), F.col("_v")[v]).alias(v) for v in values])
