"""Validation forward in time: train on earlier periods, choose on the one before, judge on the next."""

from __future__ import annotations

from dataclasses import dataclass
from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip
from ..sources.files import written
from .evaluate import all_metrics
from .models import GROWTHS, Fitted, boost_folds, fit_configured

C = F.col


@dataclass
class Split:
    train: DataFrame
    valid: DataFrame
    train_n: int
    valid_n: int


def split(rows: DataFrame, period: str, valid: int, label: str) -> Split:
    """Labelled rows of periods before `valid` and of it; raises ValueError where either has none."""
    known = rows.filter(C(label).isNotNull())
    parts = known.filter(C(period) < valid), known.filter(C(period) == valid)
    n = known.agg(F.count_if(C(period) < valid), F.count_if(C(period) == valid)).first()
    if not all(n):
        raise ValueError(f"no split at {period} = {valid}: {n[0]} rows before it, {n[1]} in it")
    return Split(*parts, *n)


def tune_refit_evaluate(rows: DataFrame, config: dict, features: list[str], categorical: list[str], period: str, valid: int, label: str) -> tuple[Fitted, DataFrame, dict]:
    """Chooses on the period before `valid` (where the configuration says `refit_after_tuning`), fits to all before `valid`, forecasts it.

    Gives the model, the forecasts and the metrics. The judged period never has a say in the choice."""
    at = split(rows, period, valid, label)
    before = split(rows, period, valid - 1, label) if config.get("refit_after_tuning") else None
    model = fit_configured(config, at.train, features, categorical, label, (before.train, before.valid) if before else None)
    forecast = written(model.predict(at.valid))
    found = all_metrics(forecast, label, "p", [period]).drop(period).first().asDict() | {"train_n": at.train_n, "valid_n": at.valid_n, "best_iteration": model.rounds}
    return model, forecast, found | ({"tuning_period": valid - 1, "tuning_train_n": before.train_n, "tuning_valid_n": before.valid_n} if before else {})


def in_folds(rows: DataFrame, period: str, valids: list[int], label: str) -> DataFrame:
    """Labelled rows once for each fold (a judged period) that they train or are judged in: `_fold` is that period, `_train` says which."""
    fold = F.explode(F.filter(F.array(*[F.lit(v) for v in valids]), lambda v: v >= C(period)))
    return rows.filter(C(label).isNotNull()).withColumn("_fold", fold).withColumn("_train", C(period) < C("_fold"))


def forward_folds(rows: DataFrame, config: dict, features: list[str], categorical: list[str], period: str, valids: list[int], label: str) -> tuple[DataFrame, DataFrame]:
    """Forecasts of every fold (train before, judge on each of `valids`) as one table, and a table of each fold's metrics, train_n and
    best_iteration. Periods without labelled rows are skipped; none left, or none before one, is an error.

    The needed columns are read once. Constant and boosted models of all folds are learned side by side from one table; a fold's boosted model
    stops at the best number of trees of its own judged period, as early stopping does; use tune_refit_evaluate for an unbiased figure."""
    log = written(rows.filter(C(label).isNotNull()))
    sizes = dict(sorted((r[0], r[1]) for r in log.groupBy(period).count().collect() if r[0] is not None))  # periods, few by nature
    judged = [v for v in valids if v in sizes]
    if not judged:
        raise ValueError(f"none of {valids} has labelled rows")
    before = {v: sum(n for p, n in sizes.items() if p < v) for v in judged}
    if lacking := [v for v in judged if not before[v]]:
        raise ValueError(f"no labelled rows before {lacking}")
    if config["type"] in GROWTHS:
        models = boost_folds(config, in_folds(log, period, judged, label), features, categorical, label)
    elif config["type"] == "constant":
        rates = in_folds(log, period, judged, label).filter("_train").groupBy("_fold").agg(F.avg(label).alias("rate")).collect()  # a row a fold
        models = {r["_fold"]: Fitted(lambda x, rate=r["rate"]: x.withColumn("p", F.lit(rate)), None, None) for r in rates}
    else:
        models = {}
        for v in judged:
            parts = log.filter(C(period) < v), log.filter(C(period) == v)
            models[v] = fit_configured(config, parts[0], features, categorical, label, parts if config["type"] == "boosted" else None)
    forecasts = None
    for v in judged:
        forecast = models[v].predict(log.filter(C(period) == v))
        forecasts = forecast if forecasts is None else forecasts.unionByName(forecast)
    forecasts = written(forecasts)
    facts = F.create_map(*[F.lit(x) for v in judged for x in (v, before[v])]), F.create_map(*[x for v in judged for x in (F.lit(v), F.lit(models[v].rounds).cast("int"))])
    return forecasts, all_metrics(forecasts, label, "p", [period]).withColumns({"train_n": facts[0][C(period)].cast("long"), "best_iteration": facts[1][C(period)]})


def final_fit(rows: DataFrame, config: dict, features: list[str], categorical: list[str], label: str, folds: DataFrame, least: int = 50) -> Fitted:
    """The model of all labelled rows, with the median of the folds' numbers of trees, `least` at least."""
    found = [r[0] for r in folds.select("best_iteration").collect() if r[0]]  # a row a fold
    params = dict(config.get("params", {})) | ({"rounds" if config["type"] in GROWTHS else "maxIter": max(least, int(median(found)))} if found else {})
    return fit_configured(config | {"params": params}, rows.filter(C(label).isNotNull()), features, categorical, label)


def submission(forecast: DataFrame, row_id: str, p: str = "p", eps: float = 1e-5) -> DataFrame:
    """(row_id, p) with the forecasts kept off 0 and 1."""
    return forecast.select(row_id, clip(C(p), eps, 1 - eps).alias(p))
