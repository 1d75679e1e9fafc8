"""Priors for entities without history: nearest neighbours in sensor space, then rookies, then the league, then a constant."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import written
from .quantiles import quantiles
from .ranges import null_safe_join
from .tables import first_per_key


@dataclass(frozen=True)
class ColdStart:
    neighbours: int = 20
    min_rows: int = 50
    floor: float = 1e-6
    min_rookies: int = 3
    constant: float = 0.49


def outcomes(rows: DataFrame, entity: str, period: str, label: str, counter: str) -> DataFrame:
    """Per entity and period: rate, rows, and whether its own counter started at 0."""
    return rows.groupBy(entity, period).agg(F.avg(label).alias("rate"), F.count(label).alias("n"), (F.min(counter) == 0).alias("rookie"))


def fallbacks(found: DataFrame, period: str, config: ColdStart = ColdStart()) -> DataFrame:
    """Per following period the median rate of all and of rookies; too few rookies take the league's."""
    middle = quantiles(found.withColumn("_rookie", F.when(F.col("rookie"), F.col("rate"))), [period], ["rate", "_rookie"], [0.5])
    at = null_safe_join(middle, found.groupBy(period).agg(F.count_if("rookie").alias("k")), [period])
    league = F.col("rate")[0]
    return at.select((F.col(period) + 1).alias(period), league.alias("league"), F.when(F.col("k") >= config.min_rookies, F.col("_rookie")[0]).otherwise(league).alias("rookie_prior"))


def robust_scores(profiles: DataFrame, period: str, metrics: list[str]) -> DataFrame:
    """Metrics less their period's median, over its interquartile range (0 counts as 1); a missing metric is the median, and NULL if none has it."""
    stats = quantiles(profiles, [period], metrics, [0.25, 0.5, 0.75])
    at = profiles.join(stats.select(period, *[F.col(m).alias(f"_{m}") for m in metrics]), period)
    width = lambda m: F.when(F.col(f"_{m}")[2] == F.col(f"_{m}")[0], 1.0).otherwise(F.col(f"_{m}")[2] - F.col(f"_{m}")[0])
    return at.withColumns({m: (F.coalesce(F.col(m), F.col(f"_{m}")[1]) - F.col(f"_{m}")[1]) / width(m) for m in metrics}).drop(*[f"_{m}" for m in metrics])


def slices_of(cells: int, dimensions: int) -> list[int]:
    """Into how many slices each dimension is cut, one after the other, so that at least `cells` cells come out."""
    out = []
    for left in range(dimensions, 0, -1):
        n = max(1, ceil(round(cells ** (1 / left), 9)))
        out.append(n)
        cells = -(-cells // n)
    return out


def in_cells(points: DataFrame, period: str, metrics: list[str], cell: int) -> tuple[DataFrame, list[int]]:
    """Adds `_cell` to points with `_candidate`: a k-d partition that cuts each cell of more than `cell` candidates along one metric after the
    other, at quantiles of its candidates. Also the numbers of slices: a cell's number has them as its digits."""
    most = points.filter("_candidate").groupBy(period).count().agg(F.max("count")).first()[0] or 0
    parts = slices_of(max(1, -(-most // cell)), len(metrics))
    at = points.withColumn("_cell", F.lit(0).cast("long"))
    for m, n in zip(metrics, parts):
        if n > 1:
            shares = F.array(*[F.lit(i / n) for i in range(1, n)])
            edges = at.filter("_candidate").groupBy(period, "_cell").agg(F.count("*").alias("_n"), F.percentile_approx(m, shares, F.lit(1000)).alias("_edges"))
            at = null_safe_join(at, edges, [period, "_cell"])
            slice_ = F.when(F.col("_n") > cell, F.size(F.filter("_edges", lambda e: e < F.col(m)))).otherwise(0)
            at = at.withColumn("_cell", F.col("_cell") * n + slice_).drop("_n", "_edges")
    return at, parts


def _apart(low: list[Column], high: list[Column], to_low: list[Column], to_high: list[Column]) -> Column:
    """Squared distance of two boxes."""
    return sum((F.greatest(c - b, a - d, F.lit(0.0)) ** 2 for a, b, c, d in zip(low, high, to_low, to_high)), F.lit(0.0))


def near_pairs(points: DataFrame, entity: str, period: str, metrics: list[str], value: str, k: int, cell: int | None = None) -> DataFrame:
    """(period, entity, _other, d, _value): pairs among which are each point's k nearest; d is the root mean square.

    Points lie in cells of a k-d partition over all metrics. The k-th distance within a point's own cell bounds how far nearer ones can be. Cells
    descend the partition a level at a time to the cells within their points' bounds, and a point meets only those that its own bound reaches,
    so pairs grow with the points. Of candidates with equal metrics only the first k + 1 ids can be among the nearest of anyone; the others
    are no candidates, so copies don't crowd a cell."""
    known = points.select(period, entity, *metrics, F.col(value).alias("_v")).filter(F.col(period).isNotNull())
    for m in metrics:
        known = known.filter(F.col(m).isNotNull() & ~F.isnan(m))
    copies = Window.partitionBy(period, *metrics, F.col("_v").isNull()).orderBy(entity)
    known = written(known.withColumn("_candidate", F.col("_v").isNotNull() & (F.row_number().over(copies) <= k + 1)))
    at, parts = in_cells(known, period, metrics, cell or 4 * (k + 1))
    at = written(at)
    other = at.filter("_candidate").select(F.col(period).alias("_period"), F.col("_cell").alias("_at"), F.col(entity).alias("_other"), F.col("_v").alias("_value"), *[F.col(m).alias(f"_{m}") for m in metrics])
    square = sum(((F.col(m) - F.col(f"_{m}")) ** 2 for m in metrics[1:]), (F.col(metrics[0]) - F.col(f"_{metrics[0]}")) ** 2)
    mine = at.drop("_v", "_candidate")

    own = mine.join(other, (F.col(period) == F.col("_period")) & (F.col("_cell") == F.col("_at")) & (F.col(entity) != F.col("_other"))).select(period, entity, square.alias("_d"))
    own = own.withColumn("_rn", F.row_number().over(Window.partitionBy(period, entity).orderBy("_d"))).filter(F.col("_rn") == k)
    bound = own.select(F.col(period).alias("_p"), F.col(entity).alias("_e"), (F.col("_d") * (1 + 1e-9)).alias("_bound"))
    mine = mine.join(bound, (F.col(period) == F.col("_p")) & (F.col(entity) == F.col("_e")), "left").drop("_p", "_e").withColumn("_bound", F.coalesce("_bound", F.lit(float("inf"))))
    mine = written(mine)

    box = lambda names, prefix: [f(m).alias(f"{prefix}{i}{x}") for i, m in enumerate(names) for x, f in (("a", F.min), ("z", F.max))]
    side = lambda prefix, x: [F.col(f"{prefix}{i}{x}") for i in range(len(metrics))]
    front = mine.groupBy(period, "_cell").agg(F.max("_bound").alias("_most"), *box(metrics, "_q")).withColumn("_node", F.lit(0).cast("long"))
    boxes = other.groupBy("_period", "_at").agg(*box([f"_{m}" for m in metrics], "_c"))
    for level in range(len(parts) if max(parts) > 1 else 1):
        rest = prod(parts[level + 1 :])
        if parts[level] > 1 or max(parts) == 1:
            children = boxes.withColumn("_child", F.expr(f"_at div {rest}")).groupBy("_period", "_child").agg(*[f(f"_c{i}{x}").alias(f"_c{i}{x}") for i in range(len(metrics)) for x, f in (("a", F.min), ("z", F.max))])
            children = children.withColumn("_parent", F.expr(f"_child div {parts[level]}"))
            front = front.drop(*[c for c in front.columns if c.startswith("_c") and c != "_cell"]).join(children, (F.col(period) == F.col("_period")) & (F.col("_node") == F.col("_parent")))
            front = front.filter(_apart(side("_q", "a"), side("_q", "z"), side("_c", "a"), side("_c", "z")) <= F.col("_most")).withColumn("_node", F.col("_child")).drop("_period", "_child", "_parent")
    targets = front.select(F.col(period).alias("_tp"), F.col("_cell").alias("_tc"), F.col("_node").alias("_to"), *[c for c in front.columns if c.startswith("_c") and c != "_cell"])
    place = [F.col(m) for m in metrics]
    reached = mine.join(targets, (F.col(period) == F.col("_tp")) & (F.col("_cell") == F.col("_tc"))).filter(_apart(place, place, side("_c", "a"), side("_c", "z")) <= F.col("_bound"))
    pairs = reached.select(period, entity, *metrics, "_bound", "_to").join(other, (F.col(period) == F.col("_period")) & (F.col("_to") == F.col("_at")) & (F.col(entity) != F.col("_other")))
    return pairs.filter(square <= F.col("_bound")).select(period, entity, "_other", F.sqrt(square / len(metrics)).alias("d"), "_value")


def nearest(points: DataFrame, entity: str, period: str, metrics: list[str], value: str, k: int, cell: int | None = None) -> DataFrame:
    """(period, entity, _other, d, _value): each point's k nearest of those of its period that have a value, itself excluded, by root mean square; ties by the other's id."""
    pairs = near_pairs(points, entity, period, metrics, value, k, cell)
    return pairs.withColumn("_rn", F.row_number().over(Window.partitionBy(period, entity).orderBy("d", "_other"))).filter(F.col("_rn") <= k).drop("_rn")


def lookup(rows: DataFrame, profiles: DataFrame, entity: str, period: str, label: str, counter: str, metrics: list[str], size: str, order: str, config: ColdStart = ColdStart()) -> DataFrame:
    """(entity, next period, prior, distance, neighbours) from the nearest entities of the same period that have a rate."""
    kept = first_per_key(profiles.filter(F.col(size) >= config.min_rows), [entity, period], F.col(order).desc())
    scored = robust_scores(kept.join(outcomes(rows, entity, period, label, counter), [entity, period]), period, metrics)
    near = nearest(scored, entity, period, metrics, "rate", config.neighbours)
    w = 1 / F.greatest("d", F.lit(config.floor))
    found = near.groupBy(entity, period).agg((F.sum(w * F.col("_value")) / F.sum(w)).alias("prior"), (F.sum(w * F.col("d")) / F.sum(w)).alias("distance"), F.count("*").alias("neighbours"))
    return found.withColumn(period, F.col(period) + 1)


def attach(rows: DataFrame, found: DataFrame, back: DataFrame, entity: str, period: str, counter: str, rate: str, config: ColdStart = ColdStart(), replace: bool = True) -> DataFrame:
    """Adds is_cold, cold_prior and cold_source; with replace, cold rows take the prior as their rate."""
    at = rows.join(found.select(entity, period, "prior"), [entity, period], "left").join(back, period, "left")
    cold = (F.coalesce(F.col(counter), F.lit(0)) <= 0) | F.col(rate).isNull()
    source = F.when(~cold, "self_history").when(F.col("prior").isNotNull(), "knn").when(F.col("rookie_prior").isNotNull(), "rookie").when(F.col("league").isNotNull(), "league").otherwise("constant")
    value = F.coalesce("prior", "rookie_prior", "league", F.lit(config.constant))
    out = at.withColumns({"is_cold": cold, "cold_prior": value, "cold_source": source}).drop("prior", "rookie_prior", "league")
    return out.withColumn(rate, F.when(F.col("is_cold"), F.col("cold_prior")).otherwise(F.col(rate))) if replace else out
