"""The model matrix as files: rows with their ids, label and features, a schema with missing counts, and a summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MISSING
from ..sources.files import write_csv, write_features, write_json

C = F.col


@dataclass
class Bundle:
    """rows: row_id, period, label (NULL for scoring rows), `is_train` and the features."""

    rows: DataFrame
    features: list[str]
    categorical: list[str]
    row_id: str = "row_id"
    label: str = "y"
    is_train: str = "is_train"

    def part(self, train: bool) -> DataFrame:
        return self.rows.filter(C(self.is_train) == train)


def export_matrix(bundle: Bundle, train: bool) -> DataFrame:
    """The id, for training rows the label, and the features in order; a training row without a label is an error."""
    rows = bundle.part(train)
    if not train:
        return rows.select(bundle.row_id, *bundle.features)
    if not rows.filter(C(bundle.label).isNull()).isEmpty():
        raise ValueError("training rows without a label")
    return rows.select(bundle.row_id, C(bundle.label).cast("int").alias(bundle.label), *bundle.features)


def feature_schema(bundle: Bundle) -> DataFrame:
    """Per feature its position, type, whether it is categorical, and how many training and scoring rows miss it, from one pass over the rows."""
    kinds = dict(bundle.rows.dtypes)
    gone = lambda f: C(f).isNull() | (C(f).cast("string") == MISSING) if kinds[f] == "string" else C(f).isNull()
    counts = [F.count_if(gone(f) & (C(bundle.is_train) == train)).alias(f"{part}_{f}") for f in bundle.features for part, train in (("train", True), ("test", False))]
    found = bundle.rows.agg(F.count_if(C(bundle.is_train)).alias("_train"), F.count_if(~C(bundle.is_train)).alias("_test"), *counts)

    def one(i: int, f: str):
        rate = lambda part: F.try_divide(C(f"{part}_{f}").cast("double"), C(f"_{part}")).alias(f"{part}_missing_rate")
        return F.struct(
            F.lit(i).alias("position"), F.lit(f).alias("feature"), F.lit(kinds[f]).alias("dtype"), F.lit(f in bundle.categorical).alias("is_categorical"),
            C(f"train_{f}").alias("train_missing_n"), rate("train"), C(f"test_{f}").alias("test_missing_n"), rate("test"),
        )

    return found.select(F.inline(F.array(*[one(i, f) for i, f in enumerate(bundle.features, 1)])))


def export(bundle: Bundle, folder: str, preview: int = 200, facts: dict | None = None) -> dict:
    """Writes the matrices, previews in the order of the ids, the schema and a summary below folder; gives the summary."""
    out, rows = {}, {}
    for name, train in (("train", True), ("test", False)):
        matrix = export_matrix(bundle, train)
        rows[name] = matrix.count()
        if train or rows[name]:
            write_features(matrix, f"{folder}/{name}_features")
            write_csv(matrix, f"{folder}/{name}_features_preview", preview, bundle.row_id)
            out[f"{name}_output"] = f"{folder}/{name}_features"
    write_csv(feature_schema(bundle), f"{folder}/feature_schema")
    summary = (facts or {}) | out | {
        "train_rows": rows["train"], "test_rows": rows["test"], "model_feature_count": len(bundle.features), "categorical_feature_count": len(bundle.categorical),
        "numeric_feature_count": len(bundle.features) - len(bundle.categorical), "categorical_features": bundle.categorical, "output_format": "parquet", "parquet_compression": "zstd",
    }
    write_json(bundle.rows.sparkSession, summary, f"{folder}/preprocessing_summary")
    return summary
