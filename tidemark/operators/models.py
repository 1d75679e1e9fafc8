"""Encoders and learners on public pyspark.ml estimators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MISSING, logit
from ..sources.files import drop_written, written, written_tables
from .quantiles import quantiles
from .ranges import null_safe_join
from .trees import Boosted, Forest, Growth, boost, extra_trees, ordered_statistics, with_statistics

C = F.col
#: Boosted learners and how they grow unless a configuration says otherwise. `leaf_wise` takes categories as they are, `second_order` their
#: frequencies, `ordered` label rates over the rows before; all take missing numbers as they are.
GROWTHS = {
    "second_order": Growth(rounds=200, rate=0.03, depth=7, l1=0.2, l2=3.0, least_weight=50.0, rows_share=0.85, features_share=0.85, patience=100),
    "leaf_wise": Growth(rounds=200, rate=0.025, depth=24, leaves=31, l2=0.0, least_rows=20, patience=100),
    "ordered": Growth(rounds=200, rate=0.035, depth=8, l2=5.0, symmetric=True, patience=100),
}


def frequencies(train: DataFrame, column: str) -> DataFrame:
    """(_v, the share of the training rows with the value)."""
    n = train.count()
    return train.groupBy(C(column).alias("_v")).agg((F.count("*") / F.lit(float(n))).alias(f"{column}_freq"))


def with_frequencies(rows: DataFrame, shares: DataFrame, column: str) -> DataFrame:
    return rows.join(shares, C(column).eqNullSafe(C("_v")), "left").drop("_v").fillna(0.0, [f"{column}_freq"])


def frequency_encode(train: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """Adds the share of the training rows with the value, 0 for unseen ones."""
    return with_frequencies(other, frequencies(train, column), column)


def medians(train: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians of the training rows, 0 where all are missing."""
    row = quantiles(train, [], columns, [0.5]).first()
    return {c: float(row[c][0]) if row[c] else 0.0 for c in columns}


def constant_rate(train: DataFrame, label: str) -> float:
    return train.agg(F.avg(label)).first()[0]


def fit(train: DataFrame, features: list[str], label: str, kind: str = "logistic", **params) -> PipelineModel:
    """kind: logistic, boosted or forest. A missing feature takes the training median; a feature without any value is 0."""
    empty = train.agg(*[F.count(f).alias(f) for f in features]).first()
    known = [f for f in features if empty[f]]
    rows = train.withColumns({f: C(f).cast("double") for f in features})
    stages = [Imputer(inputCols=known, outputCols=[f"_known_{f}" for f in known], strategy="median")] if known else []
    stages.append(VectorAssembler(inputCols=[f"_known_{f}" for f in known], outputCol="_features"))
    if kind == "logistic":
        c = params.pop("C", 1.0)
        learner = LogisticRegression(featuresCol="_scaled", labelCol=label, regParam=1.0 / (c * max(train.count(), 1)), elasticNetParam=0.0, standardization=False, **params)
        stages += [StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True), learner]
    else:
        stages.append((GBTClassifier if kind == "boosted" else RandomForestClassifier)(featuresCol="_features", labelCol=label, **params))
    return Pipeline(stages=stages).fit(rows)


def _prepared(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """The rows with their features as doubles."""
    used = next((s.getInputCols() for s in model.stages if s.hasParam("missingValue")), [])
    return rows.withColumns({f: C(f).cast("double") for f in used}) if used else rows


def _but(rows: DataFrame, name: str) -> list[str]:
    """The columns of the rows but one: a forecast replaces a feature of its name, as withColumn does."""
    return [c for c in rows.columns if c.lower() != name.lower()]


def predict(model: PipelineModel, rows: DataFrame, name: str = "p") -> DataFrame:
    keep = _but(rows, name)
    return model.transform(_prepared(model, rows)).withColumn(name, vector_to_array("probability")[1]).select(*keep, name)


def importances(model: PipelineModel, features: list[str], top: int | None = None) -> list[tuple[str, float]]:
    """(feature, weight), the largest first: impurity gains of trees, absolute coefficients of linear models."""
    learner = model.stages[-1]
    weights = learner.featureImportances if hasattr(learner, "featureImportances") else learner.coefficients
    used = next((s.getInputCols() for s in model.stages if s.hasParam("missingValue")), features)
    found = dict.fromkeys(features, 0.0) | {f: abs(float(w)) for f, w in zip(used, weights.toArray())}
    return sorted(found.items(), key=lambda x: (-x[1], x[0]))[:top]


def staged_brier(model: PipelineModel, rows: DataFrame, label: str) -> list[float]:
    """Brier score of each prefix of the boosted trees, in one pass over the rows."""
    learner = model.stages[-1]
    at = _prepared(model, rows)
    for stage in model.stages[:-1]:
        at = stage.transform(at)
    margins, total = [], F.lit(0.0)
    for i, (tree, weight) in enumerate(zip(learner.trees, learner.treeWeights)):
        at = tree.setPredictionCol(f"_t{i}").transform(at)
        total = total + C(f"_t{i}") * F.lit(float(weight))
        margins.append(total)
    score = lambda m: F.avg((1 / (1 + F.exp(-2 * m)) - C(label)) ** 2)
    return list(at.agg(*[score(m).alias(f"b{i}") for i, m in enumerate(margins)]).first())


def tuned_rounds(train: DataFrame, tuning: DataFrame, features: list[str], label: str, rounds: int, **params) -> int:
    """How many boosted trees give the least Brier score on the tuning rows, from the prefixes of one fit; the fewest of equals."""
    found = staged_brier(fit(train, features, label, "boosted", maxIter=rounds, **params), tuning, label)
    return found.index(min(found)) + 1


@dataclass
class Fitted:
    """A model of one configuration: how it predicts, its trees where it has any, and what it was made of."""

    predict: Callable[[DataFrame], DataFrame]
    rounds: int | None
    model: PipelineModel | Boosted | Forest | None


def growth_of(config: dict) -> Growth:
    """The learner's growth with the configuration's `params`, whose names are Growth's; `early_stopping_rounds` is its patience."""
    params = dict(config.get("params", {}))
    if "early_stopping_rounds" in params:
        params["patience"] = params.pop("early_stopping_rounds")
    if unknown := set(params) - set(Growth.__dataclass_fields__):
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    return replace(GROWTHS[config["type"]], **params)


def encode_folds(kind: str, frame: DataFrame, categorical: list[str], label: str, seed: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], dict[str, str]]:
    """The frame (rows with `_fold` and `_train`) with its categoricals encoded by each fold's training rows, the same for other rows with
    `_fold`, and the new names. Tables of categories stay tables: they grow with the data and are joined."""
    if kind == "leaf_wise" or not categorical:
        return frame, lambda rows: rows, {}
    tables = {}
    for c in categorical:
        if kind == "ordered":
            before = written_tables()
            at, tables[c] = ordered_statistics(frame, c, label, f"{c}_rate", seed)
            frame = written(at)  # several passes read it
            drop_written(frame.sparkSession, before, written_tables() - 2)  # the ranges; the categories' table and the frame stay
            if len(tables) > 1:
                drop_written(frame.sparkSession, before - 1, before)  # the frame before
        else:
            sizes = frame.filter("_train").groupBy("_fold").agg(F.count("*").alias("_all"))  # a row a fold
            counted = frame.filter("_train").groupBy("_fold", c).agg(F.count("*").alias("_n")).join(sizes, "_fold")
            tables[c] = written(counted.select("_fold", c, (C("_n") / C("_all")).alias(f"{c}_freq")))

    def apply(rows: DataFrame) -> DataFrame:
        for c, found in tables.items():
            rows = with_statistics(rows, found, c, f"{c}_rate") if kind == "ordered" else null_safe_join(rows, found, ["_fold", c]).fillna(0.0, [f"{c}_freq"])
        return rows

    return frame if kind == "ordered" else apply(frame), apply, {c: f"{c}_rate" if kind == "ordered" else f"{c}_freq" for c in categorical}


def boost_folds(config: dict, frame: DataFrame, features: list[str], categorical: list[str], label: str) -> dict[int, Fitted]:
    """A boosted model per fold of rows with `_fold` and `_train`, all grown side by side from one encoded table."""
    growth = growth_of(config)
    frame, apply, renamed = encode_folds(config["type"], frame, categorical, label, growth.seed)
    names = [renamed.get(f, f) for f in [*(f for f in features if f not in categorical), *categorical]]
    found = boost(frame, names, [c for c in categorical if c not in renamed], label, growth)

    def forecaster(k: int, model: Boosted) -> Callable[[DataFrame], DataFrame]:
        return lambda rows: model.predict(apply(rows.withColumn("_fold", F.lit(k)))).drop(*renamed.values())

    return {k: Fitted(forecaster(k, m), m.rounds, m) for k, m in found.items()}


def one_fold(train: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    rows = train.withColumns({"_fold": F.lit(0), "_train": F.lit(True)})
    return rows if valid is None else rows.unionByName(valid.withColumns({"_fold": F.lit(0), "_train": F.lit(False)}))


def fit_configured(config: dict, train: DataFrame, features: list[str], categorical: list[str], label: str, tuning: tuple[DataFrame, DataFrame] | None = None) -> Fitted:
    """config: `type` (constant, ridge, logistic, boosted, forest, extra_trees, or one of GROWTHS) and `params`. Categoricals are frequency encoded by
    the training rows, but see GROWTHS. A boosted model with tuning rows (train, valid) takes as many trees as are best there and is then
    fitted to `train`."""
    kind, params = config["type"], dict(config.get("params", {}))
    spark, used = train.sparkSession, list(dict.fromkeys([label, *features, *categorical]))
    if kind in GROWTHS:
        own = written_tables()
        train = written(train.select(*used))  # the columns it needs, computed once
        tuning = tuple(x.select(*used) for x in tuning) if tuning else None
        if tuning:
            growth_of(config)
            params = {k: v for k, v in params.items() if k not in ("early_stopping_rounds", "patience")} | {"patience": None}
            params["rounds"] = max(1, boost_folds(config, one_fold(*tuning), features, categorical, label)[0].rounds)
        model = boost_folds(config | {"params": params}, one_fold(train), features, categorical, label)[0]
        drop_written(spark, own, own + 1)
        return model
    if kind == "constant":
        rate = constant_rate(train, label)
        return Fitted(lambda rows: rows.withColumn("p", F.lit(rate)), None, None)
    if kind not in ("logistic", "ridge", "boosted", "forest", "extra_trees"):
        raise ValueError(f"unknown model type {kind}")
    names = [*(f for f in features if f not in categorical), *(f"{c}_freq" for c in categorical)]

    def shares(by: DataFrame) -> dict[str, DataFrame]:
        return {c: written(frequencies(by, c)) for c in categorical}

    def encoded(found: dict[str, DataFrame], rows: DataFrame) -> DataFrame:
        for c, each in found.items():
            rows = with_frequencies(rows, each, c)
        return rows

    def needed(found: dict[str, DataFrame], rows: DataFrame) -> DataFrame:
        return written(encoded(found, rows).select(label, *names))

    own = written_tables()
    base = written(train.select(*used))  # the columns it needs, computed once
    known = shares(base)
    at = needed(known, base)
    drop_written(spark, own, own + 1)
    if kind in ("extra_trees", "ridge"):
        middle = medians(at, names)
        if kind == "ridge":
            line = ridge(at.fillna(middle, names), names, label, params.pop("alpha", 1.0))
            drop_written(spark, written_tables() - 1)
            value = F.least(F.greatest(line.correction(), F.lit(0.0)), F.lit(1.0))
            return Fitted(lambda rows: encoded(known, rows).fillna(middle, names).withColumn("p", value).select(*_but(rows, "p"), "p"), None, None)
        forest = extra_trees(at.fillna(middle, names), names, label, **params)
        drop_written(spark, written_tables() - 1)
        return Fitted(lambda rows: forest.predict(encoded(known, rows).fillna(middle, names)).select(*_but(rows, "p"), "p"), len(forest.trees), forest)

    rounds = None
    if kind == "boosted":
        rounds = params.pop("maxIter", 20)
        if tuning:
            since = written_tables()
            first, judged = (written(x.select(*used)) for x in tuning)
            by = shares(first)
            rounds = tuned_rounds(needed(by, first), needed(by, judged), names, label, rounds, **params)
            drop_written(spark, since)
        params["maxIter"] = rounds
    model = fit(at, names, label, kind, **params)
    drop_written(spark, written_tables() - 1)

    def forecast(rows: DataFrame) -> DataFrame:
        return predict(model, encoded(known, rows)).drop(*[f"{c}_freq" for c in categorical])

    return Fitted(forecast, rounds, model)


@dataclass
class Ridge:
    features: list[str]
    coefficients: list[float]
    intercept: float

    def correction(self) -> Column:
        out = F.lit(self.intercept)
        for f, c in zip(self.features, self.coefficients):
            out = out + C(f) * F.lit(c)
        return out


def ridge(train: DataFrame, features: list[str], residual: str, alpha: float) -> Ridge:
    """Least squares with alpha times the squared coefficients; the intercept is free. The estimator divides its objective by the
    rows and by the label's deviation, so the penalty is scaled by both."""
    n, std = train.agg(F.count("*"), F.stddev_pop(residual)).first()
    if not std:
        return Ridge(features, [0.0] * len(features), float(train.agg(F.coalesce(F.avg(residual), F.lit(0.0))).first()[0]))
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(train)
    model = LinearRegression(featuresCol="_x", labelCol=residual, solver="normal", standardization=False, elasticNetParam=0.0, regParam=alpha / n * std).fit(rows)
    return Ridge(features, [float(c) for c in model.coefficients], float(model.intercept))


@dataclass
class ResidualDesign:
    """What the design of a residual model takes from its training rows: medians, the values of each categorical, and each column's mean and deviation."""

    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float]
    values: dict[str, list[str]]
    scale: dict[str, tuple[float, float]]

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *(f"{c}_{v}" for c in self.categorical for v in self.values[c])]

    def raw(self) -> dict[str, Column]:
        """Columns before scaling: numbers with the median for a missing one, and an indicator per value; an unseen value has none."""
        out = {c: F.coalesce(C(c).cast("double"), F.lit(self.medians[c])) for c in self.numeric}
        text = lambda c: F.coalesce(C(c).cast("string"), F.lit(MISSING))
        return out | {f"{c}_{v}": (text(c) == v).cast("double") for c in self.categorical for v in self.values[c]}

    def columns(self, p: str) -> dict[str, Column]:
        """The scaled columns, the base forecast and its logit."""
        scaled = {f"z_{n}": (x - F.lit(self.scale[n][0])) / F.lit(self.scale[n][1]) for n, x in self.raw().items()}
        return scaled | {"z_p": F.least(F.greatest(C(p), F.lit(1e-5)), F.lit(1 - 1e-5)), "z_logit": logit(C(p))}


def residual_design(train: DataFrame, numeric: list[str], categorical: list[str]) -> ResidualDesign:
    """Categoricals have few values by nature; their lists, and two numbers a column, are all that leaves the executors. A column that hardly varies is not scaled."""
    text = lambda c: F.coalesce(C(c).cast("string"), F.lit(MISSING))
    found = train.agg(*[F.array_sort(F.collect_set(text(c))).alias(c) for c in categorical]).first() if categorical else {}
    out = ResidualDesign(numeric, categorical, medians(train, numeric) if numeric else {}, {c: list(found[c]) for c in categorical}, {})
    raw = out.raw()
    if raw:
        row = train.agg(*[f(x).alias(f"{k}{i}") for i, x in enumerate(raw.values()) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        for i, n in enumerate(raw):
            out.scale[n] = (row[f"m{i}"] or 0.0, row[f"s{i}"] if row[f"s{i}"] and row[f"s{i}"] >= 1e-6 else 1.0)
    return out


@dataclass
class ResidualModel:
    design: ResidualDesign
    ridge: Ridge
    alpha: float
    weight: float

    def correction(self, p: str) -> Column:
        """The ridge's value for a row; `weight` goes with the model and is applied by its caller."""
        out, columns = F.lit(self.ridge.intercept), self.design.columns(p)
        for n, c in zip(self.ridge.features, self.ridge.coefficients):
            out = out + columns[n] * F.lit(c)
        return out


def residual_model(train: DataFrame, numeric: list[str], categorical: list[str], p: str, label: str, alpha: float, weight: float = 1.0) -> ResidualModel:
    design = residual_design(train, numeric, categorical)
    columns = design.columns(p)
    rows = train.select((C(label) - C(p)).alias("_residual"), *[x.alias(n) for n, x in columns.items()])
    return ResidualModel(design, ridge(rows, list(columns), "_residual", alpha), alpha, weight)
