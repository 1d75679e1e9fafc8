"""Exact dedup by Patricia tries.

Rows go to the owner of their length and content hash. An owner inserts the full byte strings into a compressed radix trie
whose terminal nodes keep the smallest identifier and the number of copies. Each input task first runs the same trie over its
own rows, so that a text which holds a third of all rows crosses the network once per flush, not once per row.

Defined results: a null text counts as empty; empty texts form one group; rows with equal doc_id and equal text count as two
rows of one group, and both stay if theirs is the smallest doc_id; a null doc_id sorts after all others, so such a
row stays only if all its copies lack a doc_id, and then all of them stay. Very long texts are inserted whole. An empty table gives an
empty result. Further columns of any name pass through `exact_dedup`. Subtrees spill to a file of the task's own, which is read by that
task alone and made anew where the task runs again.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, raw, release, slices, texts

LAST = (1 << 63) - 1


class Node:
    __slots__ = ("edges", "low", "count", "spilled")

    def __init__(self, low=LAST, count=0):
        self.edges, self.low, self.count, self.spilled = {}, low, count, None


class PatriciaTrie:
    """A compressed radix trie over byte strings; beyond max_bytes it moves whole subtrees under the root to disk and reads them back one at a time."""

    def __init__(self, max_bytes: int = 64 << 20):
        self.root, self.max_bytes, self.held = Node(), max_bytes, 0
        self.weights: dict[int, int] = {}

    def insert(self, text: bytes, low: int, count: int) -> None:
        self._insert(text, low, count)
        if self.held > self.max_bytes:
            self._spill(max(self.weights, key=self.weights.get))

    def _insert(self, text: bytes, low: int, count: int) -> None:
        if text and (top := self.root.edges.get(text[0])) and top[1].spilled:
            pickle.dump((text, low, count), top[1].spilled)
            return
        node, at = self.root, 0
        while at < len(text):
            edge = node.edges.get(text[at])
            if edge is None:
                self._grow(text, len(text) - at)
                node.edges[text[at]] = (text[at:], Node(low, count))
                return
            label, child = edge
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            shared = self._shared(label, text, at)
            middle = Node()
            middle.edges[label[shared]] = (label[shared:], child)
            node.edges[text[at]] = (label[:shared], middle)
            self._grow(text, len(text) - at - shared)
            node, at = middle, at + shared
        node.low, node.count = min(node.low, low), node.count + count

    @staticmethod
    def _shared(label: bytes, text: bytes, at: int) -> int:
        """Length of the common prefix of label and text[at:], which is shorter than label; found by halving."""
        low, high = 0, min(len(label), len(text) - at)
        while low < high:
            middle = (low + high + 1) // 2
            if text.startswith(label[:middle], at):
                low = middle
            else:
                high = middle - 1
        return low

    def _grow(self, text: bytes, n: int) -> None:
        self.held += n + 200
        self.weights[text[0]] = self.weights.get(text[0], 0) + n + 200

    def _spill(self, first: int) -> None:
        label, top = self.root.edges[first]
        file = tempfile.TemporaryFile()
        for text, low, count in self._walk(top, label):
            pickle.dump((text, low, count), file)
        kept = Node()
        kept.spilled = file
        self.root.edges[first] = (bytes([first]), kept)
        self.held -= self.weights.pop(first)

    def _walk(self, node: Node, prefix: bytes):
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            if node.count:
                yield prefix, node.low, node.count
            stack += [(child, prefix + label) for label, child in node.edges.values()]

    def groups(self):
        """(text, smallest identifier, copies) of each distinct text."""
        if self.root.count:
            yield b"", self.root.low, self.root.count
        for label, top in self.root.edges.values():
            if not top.spilled:
                yield from self._walk(top, label)
        for _, top in self.root.edges.values():
            if top.spilled:
                yield from self._read_back(top.spilled)

    def _read_back(self, file):
        """The groups of a spilled subtree, by a trie of its own below the texts' common prefix."""
        prefix = None
        for text, _, _ in self._entries(file):
            prefix = text if prefix is None else os.path.commonprefix((prefix, text))
        inner = PatriciaTrie(self.max_bytes)
        for text, low, count in self._entries(file):
            inner.insert(text[len(prefix) :], low, count)
        file.close()
        for text, low, count in inner.groups():
            yield prefix + text, low, count

    @staticmethod
    def _entries(file):
        file.seek(0)
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


GROUP = "text string, text_sha256 string, low long, copies long"
ARROW = pa.schema([("text", pa.string()), ("text_sha256", pa.string()), ("low", pa.int64()), ("copies", pa.int64())])


def _trie_groups(batches, trie_bytes: int):
    """Inserts (text, low, copies) rows; gives each distinct text once."""
    release()  # what earlier tasks of this worker left
    trie = PatriciaTrie(trie_bytes)
    for part in slices(batches):
        for text, low, copies in zip(raw(part.column("text")), part.column("low").to_pylist(), part.column("copies").to_pylist()):
            trie.insert(text, low, copies)
    rows, held = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), ARROW.types)], schema=ARROW)

    for text, low, count in trie.groups():
        rows.append((text.decode(), sha256(text).hexdigest(), low, count))
        held += len(text)
        if held > 4 << 20:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()
    del trie, rows
    release()


def exact_groups(docs: DataFrame, trie_bytes: int = 96 << 20) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. trie_bytes bounds the memory of a task's trie; beyond it subtrees go to disk."""
    rows = texts(docs).withColumn("text", F.regexp_replace("text", SPACE, " ")).withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    local = rows.select("text", F.coalesce("doc_id", F.lit(LAST)).alias("low"), F.lit(1).cast("long").alias("copies")).mapInArrow(lambda it: _trie_groups(it, trie_bytes), GROUP)
    owned = local.repartition(F.octet_length("text"), "text_sha256").mapInArrow(lambda it: _trie_groups(it, trie_bytes), GROUP)
    heads = owned.select("text_sha256", F.when(F.col("low") < LAST, F.col("low")).alias("keep_id"), F.col("copies").alias("group_size"))
    return (
        rows.select("doc_id", "text_sha256")
        .join(heads, "text_sha256")
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text a row with a smaller doc_id has; all columns stay."""
    sha = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " ").cast("binary"), 256)
    kept = exact_groups(docs).filter("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept_id"]) & (sha == kept["_kept_sha"]), "left_semi")
