"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java and as a Python pattern.
SPACE = r"[\x20\x09-\x0D]+"

_own_dir: list[str] = []
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets one temporary folder; a cluster raises."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-"))
    return _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, for an intermediate table."""
    _written.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def intermediate() -> int:
    """How many intermediate tables this process has written and not deleted."""
    return len(_written)


def drop_intermediate(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the intermediate tables from number `since` on, but the last `keep`. Results that still read them can't be computed any more, so write those first."""
    for name in _written[since : len(_written) - keep]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _written[since : len(_written) - keep] = []


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again, so that a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, a null text as the empty one; further columns can't clash then."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches, column: str = "text", max_bytes: int = 4 << 20):
    """Cuts record batches into runs of rows with about max_bytes of text (one row at least), so that memory doesn't follow the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(lengths(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def release() -> None:
    """Gives what many small allocations (of tokenizers, or of a trie) leave behind in this worker back to the machine, 100 MB and more. Only some C libraries offer that."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def offsets(column) -> np.ndarray:
    """Byte offsets of a string or binary array without nulls."""
    width = np.int64 if str(column.type).startswith("large") else np.int32
    return np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def lengths(column) -> np.ndarray:
    return np.diff(offsets(column))


def raw(column) -> list[bytes]:
    """The values of a string array as UTF-8 bytes."""
    at, data = offsets(column), column.buffers()[2]
    if not data:
        return [b""] * len(column)
    view = memoryview(data)[at[0] : at[-1]].tobytes()
    cuts = (at - at[0]).tolist()
    return [view[a:b] for a, b in zip(cuts, cuts[1:])]


def joined_ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] of them), start[1], ..."""
    total = int(count.sum())
    return np.arange(total) + np.repeat(start - np.cumsum(count) + count, count)
