"""Readers and writers: CSV with an explicit schema, Parquet, JSON, cached aggregates, append-only history."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import numbered



def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """All columns of the schema, or those asked for; only these are parsed. A byte order mark is dropped."""
    rows = spark.read.schema(schema).csv(path, header=True, encoding="UTF-8")
    return rows.select(*columns) if columns else rows


def read_mapping(spark: SparkSession, path: str, schema: str, target: str, grade: str, accepted: list[str]) -> DataFrame:
    """A crosswalk with `accepted`: its grade is one of those given and its target is known."""
    return read_csv(spark, path, schema).withColumn("accepted", F.coalesce(F.col(grade).isin(accepted) & F.col(target).isNotNull(), F.lit(False)))


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def write_features(df: DataFrame, path: str, row_group_bytes: int = 128 << 20) -> None:
    df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", str(row_group_bytes)).parquet(path)


def write_csv(df: DataFrame, path: str, rows: int | None = None, order: str | None = None) -> None:
    out = first_rows(df, order, rows) if rows and order else df
    out.write.mode("overwrite").csv(path, header=True, compression="gzip")


def work_folder(spark: SparkSession) -> str:
    """A new folder for results that a query writes: below spark.checkpoint.dir, which all executors share; a local session without it takes a temporary one, a cluster raises."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return f"{found.rstrip('/')}/work-{uuid.uuid4().hex}"
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-")


_written: list[str] = []


def written_tables() -> int:
    """How many tables `written` has made in this process that are still there."""
    return len(_written)


def drop_written(spark: SparkSession, since: int = 0, upto: int | None = None) -> None:
    """Deletes the tables that `written` made from number `since` on. Results that still read them can't be computed any more, so write those first."""
    upto = len(_written) if upto is None else upto
    for name in _written[since:upto]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _written[since:upto] = []


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, for what several later steps read: computed once, and a lost executor costs no recomputation."""
    path = work_folder(df.sparkSession)
    _written.append(path)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One text file below path."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def write_json(spark: SparkSession, value: object, path: str) -> None:
    write_text(spark, to_json(value), path)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # the one small file that write_text made


def read_json(spark: SparkSession, path: str) -> object:
    return json.loads(read_text(spark, path))


def file_signature(spark: SparkSession, path: str | None) -> list[list] | None:
    """Path, size and time of change of the file, or of each file of the folder; the contents aren't read."""
    if path is None:
        return None
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return sorted([r[0], r[1], r[2].isoformat()] for r in found.select("path", "length", "modificationTime").collect())  # a row a file


def save_model(spark: SparkSession, model, path: str, facts: dict | None = None) -> None:
    """A fitted pipeline, or the plain values of trees, with a note of what it is; a constant model is the note alone."""
    if hasattr(model, "bundle"):
        write_json(spark, model.bundle(), f"{path}/bundle")
    elif model is not None:
        model.write().overwrite().save(f"{path}/pipeline")
    write_json(spark, (facts or {}) | {"fitted": model is not None}, f"{path}/facts")


def to_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, default=str)


def signature(value: object) -> str:
    """A short digest of a configuration; the same for the same content in any order."""
    return hashlib.sha256(to_json(value).encode()).hexdigest()[:16]


def cached(spark: SparkSession, folder: str, key: object, make: Callable[[], DataFrame], *sources: str) -> DataFrame:
    """The table that an earlier call with the same key and unchanged source files published, or else make(), published.

    A call writes to a folder of its own and publishes by renaming a finished marker file that names it. A write that broke off has no marker and
    is never a hit; of calls at the same time the first to rename wins, and all give its table."""
    path = f"{folder.rstrip('/')}/{signature([key, [file_signature(spark, s) for s in sources]])}"
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    marker = Path(f"{path}/published")
    fs = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(marker):
        name = uuid.uuid4().hex
        make().write.parquet(f"{path}/{name}")
        write_text(spark, name, f"{path}/marker-{name}")
        if not fs.rename(Path(f"{path}/marker-{name}"), marker):
            fs.delete(Path(f"{path}/marker-{name}"), True)
            fs.delete(Path(f"{path}/{name}"), True)
        elif fs.exists(nested := Path(f"{path}/published/marker-{name}")):  # another call's marker was there: a rename onto a folder moves into it
            fs.delete(nested, True)
            fs.delete(Path(f"{path}/{name}"), True)
    return spark.read.parquet(f"{path}/{read_text(spark, f'{path}/published').strip()}")


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All runs; columns that older runs lack are NULL there."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def with_row_order(df: DataFrame, *order: str) -> DataFrame:
    """Numbers rows by a total order, which a log without a sequence column needs once. A large log is numbered in ranges of that order."""
    return numbered(df, [], list(order), "_row_order")
