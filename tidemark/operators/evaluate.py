"""Evaluation of probability forecasts, and tables that compare experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip
from .ranges import running

#: Edges of ten bins as IEEE sums give them, so that 0.3 lies in the third bin.
EDGES = [i * 0.1 for i in range(1, 10)]


def metrics(df: DataFrame, label: str, p: str, by: list[str] = (), eps: float = 1e-6, clamp: bool = False) -> DataFrame:
    """Per group: n, Brier, log loss, target rate, mean and population deviation of p, and the Brier skill score times 1e5."""
    y, raw = F.col(label).cast("double"), F.col(p)
    q = clip(raw, eps, 1 - eps)
    base = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((q - y) ** 2).alias("brier"), F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("logloss"), F.avg(y).alias("target_rate"),
        F.avg(q).alias("prediction_mean"), F.stddev_pop(q).alias("prediction_std"),
    )
    reference = F.col("target_rate") * (1 - F.col("target_rate"))
    skill = F.when(reference == 0, 0.0).otherwise(100000.0 * (1 - F.col("brier") / reference))
    return base.withColumn("skill", F.greatest(skill, F.lit(0.0)) if clamp else skill)


def auc(df: DataFrame, label: str, p: str, by: list[str]) -> DataFrame:
    """Area under the ROC curve by mid-ranks; NULL with one class. Rows reduce to one per distinct forecast, and these are ordered in ranges of the forecast."""
    y = F.col(label).cast("long")
    scored = running(df, by, p, {"pos": y, "neg": 1 - y}).withColumn("wins", F.col("pos_here") * (F.col("neg") + F.col("neg_here") / 2.0))
    return scored.groupBy(*by).agg(F.try_divide(F.sum("wins"), (F.sum("pos_here") * F.sum("neg_here")).cast("double")).alias("auc"))


def bin_of(p: Column) -> Column:
    return sum(((p >= e).cast("int") for e in EDGES[1:]), (p >= EDGES[0]).cast("int"))


def calibration(df: DataFrame, label: str, p: str, by: list[str] = ()) -> DataFrame:
    """Per bin (and group): n, mean forecast and outcome, smallest and largest forecast, gap."""
    rows = df.groupBy(*by, bin_of(F.col(p)).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(label).alias("mean_y"), F.min(p).alias("min_p"), F.max(p).alias("max_p"))
    return rows.withColumn("gap", F.abs(F.col("mean_p") - F.col("mean_y")))


def calibration_error(df: DataFrame, label: str, p: str, by: list[str] = ()) -> DataFrame:
    return calibration(df, label, p, by).groupBy(*by).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def all_metrics(df: DataFrame, label: str, p: str, by: list[str]) -> DataFrame:
    """Per group Brier score, log loss, skill, AUC, calibration error and the means: a row a group."""
    return metrics(df, label, p, by).join(auc(df, label, p, by), by).join(calibration_error(df, label, p, by), by)


def paired_deltas(board: DataFrame, name: str, reference: str, value: str) -> DataFrame:
    """Each row against the row of the same table that it names: difference and improvement in percent; NULL without that row."""
    other = board.select(F.col(name).alias("_name"), F.col(value).alias("_value"))
    at = board.join(other, F.col(reference) == F.col("_name"), "left")
    return at.select(name, value, (F.col(value) - F.col("_value")).alias("delta"), F.try_divide((F.col("_value") - F.col(value)) * 100.0, F.col("_value")).alias("improvement_pct"))


def compare_tables(candidate: DataFrame, baseline: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Candidate less baseline per key, and a row 'mean'; both must have the same keys."""
    a, b = candidate.select(key), baseline.select(key)
    if not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()):
        raise ValueError(f"the tables differ in {key}")
    other = baseline.select(F.col(key).alias("_k"), *[F.col(v).alias(f"_{v}") for v in values])
    rows = candidate.join(other, F.col(key) == F.col("_k")).select(F.col(key).cast("string").alias(key), *[(F.col(v) - F.col(f"_{v}")).alias(v) for v in values])
    return rows.unionByName(rows.agg(F.lit("mean").alias(key), *[F.avg(v).alias(v) for v in values]))


def latest(history: DataFrame, keys: list[str], finished: str, *ties: str) -> DataFrame:
    """The latest row of each key; of rows that finish together the one with the largest `ties`."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in (finished, *ties)])
    return history.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def leaderboard(history: DataFrame, same: dict[str, object]) -> DataFrame:
    """Successful runs that are comparable in all of `same`, the latest of each experiment, best first."""
    rows = history.filter(F.col("status") == "success")
    for c, v in same.items():
        rows = rows.filter(F.col(c) == v)
    return latest(rows, ["experiment"], "finished_at", "brier").orderBy("brier", "experiment")
