"""SimHash near-dedup with pigeonring filtering.

A fingerprint takes, per bit, the majority over the XXH64 values of a document's word shingles. The 64 bits form a ring of six
segments. If two fingerprints differ in at most two bits, some chain of consecutive segments keeps its running sum of differences
within length * 2/6: its first two segments are equal, and of the next three two are equal as well. So a pair that links shares
four segments, in one of 15 choices of them; each distinct fingerprint goes to its 15 keys. Below a key, a pair must have such a
chain before its full Hamming distance is taken. A key with many fingerprints enumerates the values within two flips of each in
the two free segments (22 bits at most) instead of comparing pairs, and gives only a spanning forest of links.

Defined results: very long texts are read whole, their hashes a part at a time; an empty table gives an empty one; only doc_id and text
are read, so further columns of any name don't matter; equal fingerprints meet once as one node; a text without words (null, empty, white space) has fingerprint zero
and links like any other; rows with equal doc_id stay separate rows of one node; a null doc_id is never a group's smallest
unless the group has no other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, raw, slices, texts
from .components import components

WIDTHS = (11, 11, 11, 11, 10, 10)
SEGMENTS, BUDGET = len(WIDTHS), 2
SHIFTS = tuple(sum(WIDTHS[:i]) for i in range(SEGMENTS))
MASKS = tuple(((1 << w) - 1) << s for w, s in zip(WIDTHS, SHIFTS))
#: The two segments that a key leaves free.
FREE = tuple(combinations(range(SEGMENTS), 2))
SMALL = 16
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> list[int]:
    """XXH64 of each run of `shingle` words of the lower-cased text, repeats included; of the whole sequence where there are fewer words."""
    words = text.translate(LOWER).split()
    line = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(line, seed)] if words else []
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0] + [e + 1 for e in ends]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :])]


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    hashes = shingle_hashes(text, shingle, seed)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[i : i + (1 << 14)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches):
        for part in slices(batches):
            found = np.array([fingerprint(t, shingle) for t in raw(part.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def has_chain(x: np.ndarray, length: int = SEGMENTS - 1) -> np.ndarray:
    """Whether the differences x (as xor) have a start on the ring whose first `length` running sums keep to their share of the budget."""
    per = np.stack([_bits(x & np.uint64(m)) for m in MASKS])
    found = np.zeros(x.shape, bool)
    for start in range(SEGMENTS):
        total, good = np.zeros(x.shape, np.int64), np.ones(x.shape, bool)
        for n in range(length):
            total += per[(start + n) % SEGMENTS]
            good &= total * SEGMENTS <= (n + 1) * BUDGET
        found |= good
    return found


def _find(parent: np.ndarray, i: np.ndarray) -> np.ndarray:
    i = parent[i]
    while True:
        up = parent[i]
        if (up == i).all():
            return i
        i = up


def _connect(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        a, b = _find(parent, a), _find(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _forest(group: np.ndarray, choice: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """parent index of each row, for rows sorted by group; links join rows of one group only."""
    parent = np.arange(len(fp))
    sizes = np.bincount(group)
    few = sizes[group] <= SMALL
    at = np.flatnonzero(few)
    for step in range(1, SMALL):
        i = at[at + step < len(fp)]
        i = i[group[i] == group[i + step]]
        if not len(i):
            break
        x = fp[i] ^ fp[i + step]
        i, x = i[has_chain(x)], x[has_chain(x)]
        i = i[_bits(x) <= BUDGET]
        _connect(parent, i, i + step)
    many = np.flatnonzero(~few)
    if len(many):
        free, shift = np.array(FREE), np.array(SHIFTS, np.uint64)
        width = np.array([(1 << w) - 1 for w in WIDTHS], np.uint64)
        p, q = free[choice[many], 0], free[choice[many], 1]
        value = (((fp[many] >> shift[p]) & width[p]) << np.uint64(11)) | ((fp[many] >> shift[q]) & width[q])
        place = (group[many].astype(np.uint64) << np.uint64(22)) | value
        order = np.argsort(place, kind="stable")
        place, many = place[order], many[order]
        flips = [1 << i for i in range(22)]
        for flip in [*flips, *(x | y for x, y in combinations(flips, 2))]:
            near = place ^ np.uint64(flip)
            hit = np.minimum(np.searchsorted(place, near), len(place) - 1)
            i = np.flatnonzero((place[hit] == near) & (near > place))
            _connect(parent, many[i], many[hit[i]])
    return _find(parent, parent)


def _links(batches):
    """For rows (choice, key, fp, node) sorted by choice and key: a spanning forest of the links below each key."""

    def out(rows):
        choice, key, fp, node = rows
        start = np.ones(len(key), bool)
        start[1:] = (key[1:] != key[:-1]) | (choice[1:] != choice[:-1])
        group = np.cumsum(start) - 1
        many = np.bincount(group)[group] > 1
        if many.any():
            group, choice, fp, node = np.unique(group[many], return_inverse=True)[1], choice[many], fp[many].view(np.uint64), node[many]
            root = _forest(group, choice, fp)
            i = np.flatnonzero(root != np.arange(len(root)))
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[root[i]])], names=["a", "b"])

    held = None
    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("choice", "key", "fp", "node")]
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
        last = np.flatnonzero((rows[1] != rows[1][-1]) | (rows[0] != rows[0][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from out([x[:cut] for x in rows])
        held = [x[cut:] for x in rows]
    if held is not None and len(held[0]):
        yield from out(held)


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between nodes, as (fp, node) with distinct fp, that span all pairs at two or fewer differing bits."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keep = [signed(((1 << 64) - 1) ^ MASKS[i] ^ MASKS[j]) for i, j in FREE]
    keyed = nodes.select("fp", "node", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(k).cast("long")) for k in keep])).alias("choice", "key"))
    placed = keyed.repartition("choice", "key").sortWithinPartitions("choice", "key")
    return placed.select("choice", "key", "fp", "node").mapInArrow(_links, "a long, b long")


def near_groups(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (hex) and component_id, the smallest doc_id reachable over links."""
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    heads = prints.groupBy("fp").agg(F.min("doc_id").alias("node"))
    nodes = materialize(heads.filter("node is not null"), "fingerprint-nodes")
    named = components(fingerprint_links(nodes)).withColumnRenamed("node", "_node")
    placed = nodes.join(named, nodes["node"] == named["_node"], "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "node").alias("component_id"))
    return prints.join(placed, prints["fp"] == placed["_fp"], "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
