"""Stability scores: how steady an entity's readings are among its peers, drawn to the middle where readings are few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact
from .history import asof_join
from .tables import percent_ranks

C = F.col


def shrunk_score(rank: Column, n: Column, strength: float = 100.0) -> Column:
    """A percent rank of deviations as a score from 0 to 100, high for small ones, drawn to 50 by n readings against `strength`."""
    return 50 + ((1 - rank) * 100 - 50) * n / (n + strength)


def ranked_deviations(readings: DataFrame, entity: str, period: str, kind: str, metric: str, least: int = 50) -> DataFrame:
    """Per entity, period and kind: n, the sample deviation (NULL below `least` readings) and its percent rank among the entities of that period and kind."""
    per = readings.groupBy(entity, period, kind).agg(F.count("*").alias("n"), exact.stddev_samp(C(metric)).alias("s")).withColumn("s", F.when(C("n") >= least, C("s")))
    return percent_ranks(per, "s", [period, kind], "pct")


def weighted_scores(ranked: DataFrame, entity: str, period: str) -> DataFrame:
    """Per entity and period the kinds' scores weighted by their readings, and all readings. Weights aren't spread anew over missing scores; no score at all is 0."""
    weight = C("n") / F.sum("n").over(Window.partitionBy(entity, period))
    scored = ranked.withColumns({"w": weight, "score": shrunk_score(C("pct"), C("n"))})
    return scored.groupBy(entity, period).agg(F.coalesce(F.sum(C("w") * C("score")), F.lit(0.0)).alias("score"), F.sum("n").alias("n"))


def attach_scores(rows: DataFrame, scores: DataFrame, entity: str, period: str, graded: str, good: float) -> DataFrame:
    """Each row's score of the last earlier period, -1 where there is none, and its grade: D without a score, A where `graded` is at least `good`, else B."""
    at = asof_join(rows, scores, entity, period, ["score", graded], graded)
    grade = F.when(C("score").isNull(), "D").when(C(graded) >= good, "A").otherwise("B")
    return at.select(*rows.columns, F.coalesce("score", F.lit(-1.0)).alias("score"), grade.alias("grade"))
