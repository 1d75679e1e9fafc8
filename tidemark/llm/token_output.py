"""Token ids as Parquet list columns.

The file format: one directory of Parquet files whose rows ascend by doc_id, over the files too. A row has doc_id, `part` (the
number of the file's range), `local_start` (ids before it in its range), n_tokens and `ids`, a list of int. Ids are dictionary
encoded, and delta encoded where a column chunk outgrows its dictionary; row groups and pages have set sizes, and the writer's
page indexes let a reader that asks for some doc_ids or for the metadata alone skip all other pages.

Defined results: a null text counts as empty and gives the end id alone; rows with equal doc_id stand next to each other,
ordered by a hash of the text; a null doc_id comes first; very long texts are encoded whole, one at a time; an empty table gives an empty one; only
doc_id and text are read, so further columns of any name don't matter. Ranges are cut by doc_id and text, so that many rows of one
doc_id, or without one, are still several ranges; only equal rows share a range whatever their number.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, offsets, shuffle_partitions, slices, texts
from .tokens import RUN_BYTES, encoder

FILE = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
#: Row groups of 32 MB with pages of 256 KB keep a selective read small without many footers.
WRITER = {
    "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20),
    "parquet.writer.version": "PARQUET_2_0", "parquet.column.index.enabled": "true", "compression": "zstd",
}


def _encoder(path: str, end: int):
    def encode(batches):
        from pyspark import TaskContext

        words, part, start = encoder(path, True), TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", RUN_BYTES):
            ids, counts = words.encode(batch.column("text"), end)
            ends = np.cumsum(counts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(counts), part, np.int32)), pa.array(start + ends - counts), pa.array(counts), lists], schema=ARROW)
            start += int(ends[-1])

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 2) -> None:
    """Encodes every text, appends end and writes the files at path."""
    rows = texts(docs)
    n = shuffle_partitions(docs.sparkSession)
    key = F.xxhash64("text")
    ranged = rows.repartitionByRange(n, "doc_id", key).sortWithinPartitions("doc_id", key, "text")
    ranged.mapInArrow(_encoder(tokenizer, end), FILE).write.options(**WRITER).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T._parse_datatype_string(FILE)).parquet(path)


def _crc(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        lists = batch.column("ids")
        at = offsets(lists)
        data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
        found = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), pa.array(found, pa.int64())], schema=schema)


def token_index(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row of the files. Only one row a range is summed up in order."""
    sums = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select(F.col("part").alias("_part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rows = tokens.mapInArrow(_crc, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(before, rows["part"] == before["_part"]).select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_index(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end)
    return token_index(read_tokens(spark, path))
