"""Near-duplicate groups at a wanted Jaccard similarity of word shingles, by wide SimHash fingerprints and pigeonring filtering,
and exact similarity within the blocks that these give.

A text's fingerprint has 1,024 bits: per bit the majority over its distinct five-word shingles. Two texts of similarity s differ in each bit
with probability arccos(2s / (1 + s)) / pi, whatever the edit looks like. The bits form a ring of 64 segments of 16; every segment is a
key, under which it travels with the REACH segments from it on. Below a key, the segments that follow must keep their running sums of
differences within their share of the budget before the Hamming distance over these REACH segments is taken; pairs within the budget are
near. A pair at 0.8 is near under some key with a probability of 0.99, at 0.85 of 0.999 and at 0.9 of 0.99999 (simulated).

Below a key a text that is near one already reached leaves the rest, so that a dense group gives near pairs by its size, not its square.
Near pairs decide nothing alone: they only gather texts into blocks. Within a block every link is a pair whose sets of shingles have the
wanted similarity, and every pair of texts is compared unless links join the two already. A block larger than CHUNK is cut into chunks:
first each chunk is linked, then one text of each group found, and last, where a block still has several groups, every two chunks meet.

Short texts' bits differ more often than that. A pair of which one text has fewer than SHORT distinct shingles is found exactly: both are
members of a block for each shingle of their prefixes (the lowest few of a set, of which similar sets share one), with the same chunks.

Keys with more than KEY_CHUNK fingerprints are cut into chunks in the same way, so that no task holds a hot key whole.

Defined results: texts of one fingerprint are one node, whatever their doc_ids, null ones included, and different texts of one doc_id
are nodes of their own; texts of fewer words than a shingle have one shingle, the whole sequence; texts without words (null, empty,
white space) are one group; a null doc_id counts as larger than all others, and of texts of one doc_id the one with the smaller hash
comes first; a group whose rows all lack a doc_id has a null component_id and still keeps one text; rows equal in doc_id and text stay
or go together; very long texts are read whole, one at a time; an empty table gives an empty one; further columns of any name pass through.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_ranges, materialize, raw, slices
from .components import components
from .simhash import shingle_hashes

WORDS, SEGMENTS, SEGMENT_BITS = 16, 64, 16
#: Segments that travel under a key, and those of them in a chain: the shared one and those that follow it on the ring.
REACH, CHAIN = 32, 4
BITS = SEGMENT_BITS * REACH
SMALL = 16
#: Texts of fewer distinct shingles are linked by their shingles, exactly: their fingerprints differ in more bits than the similarity tells.
SHORT = 16
#: Texts of a block that are compared in one go, about, and fingerprints below a key.
CHUNK, KEY_CHUNK = 128, 50_000
#: Stands for a doc_id that is null.
LAST = (1 << 63) - 1
LinksOf = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def budget(similarity: float) -> int:
    """Differing bits of BITS up to which a pair may be similar: four standard deviations above the expectation at the wanted similarity."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(BITS * share + 4 * np.sqrt(BITS * share * (1 - share)))


def distinct_shingles(text: bytes, shingle: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, shingle), "<u8"))


def wide_fingerprint(text: bytes, shingle: int = 5) -> bytes:
    return fingerprint_of(distinct_shingles(text, shingle))


def fingerprint_of(hashes: np.ndarray) -> bytes:
    """The fingerprint as WORDS little-endian words of 64 bits; each further word mixes the hashes anew."""
    counts = np.zeros((WORDS, 64), np.int64)
    for w in range(WORDS):
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for i in range(0, len(bits), 255):
            counts[w] += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return np.packbits((2 * counts > len(hashes)).astype(np.uint8), axis=1, bitorder="little").tobytes()


def _segments(prints, n: int = SEGMENTS) -> np.ndarray:
    return np.frombuffer(b"".join(raw(prints)), "<u2").reshape(-1, n)


def _keys(batches):
    """Per node and segment: place (segment and its value), payload (the REACH segments from this one on), node."""
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            prints = _segments(part.column("print"))
            for s in range(SEGMENTS):
                turned = np.ascontiguousarray(np.roll(prints, -s, axis=1)[:, :REACH])
                place = (s << SEGMENT_BITS) + turned[:, 0].astype(np.int32)
                cells = pa.Array.from_buffers(pa.binary(), len(turned), [None, pa.py_buffer(np.arange(len(turned) + 1, dtype=np.int32) * (BITS // 8)), pa.py_buffer(turned)])
                yield pa.RecordBatch.from_arrays([pa.array(place), cells, part.column("node")], names=["place", "payload", "node"])


def _place_sizes(batches):
    """A task's number of nodes at each place."""
    total = np.zeros(SEGMENTS << SEGMENT_BITS, np.int64)
    for batch in batches:
        prints = _segments(batch.column("print"))
        for s in range(SEGMENTS):
            total[s << SEGMENT_BITS : (s + 1) << SEGMENT_BITS] += np.bincount(prints[:, s], minlength=1 << SEGMENT_BITS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["place", "n"])


def _distance(x: np.ndarray, most: int) -> np.ndarray:
    """Differing bits of xor-ed segments with a viable chain and at most `most` of them; elsewhere BITS."""
    found = np.full(len(x), BITS)
    chain = np.cumsum(np.bitwise_count(x[:, :CHAIN]), axis=1, dtype=np.int64)
    at = np.flatnonzero((chain * REACH <= np.arange(1, CHAIN + 1) * most).all(1))
    total = np.bitwise_count(x[at]).sum(1, dtype=np.int64)
    found[at[total <= most]] = total[total <= most]
    return found


def _find(parent: np.ndarray, i: np.ndarray) -> np.ndarray:
    i = parent[i]
    while not np.array_equal(up := parent[i], i):
        i = up
    return i


def _few(rows: np.ndarray, group: np.ndarray, prints: np.ndarray, most: int):
    """Pairs (i, j) of the rows in groups of at most SMALL: a forest of the near pairs."""
    pairs = []
    for step in range(1, SMALL):
        i, j = rows[:-step], rows[step:]
        same = group[i] == group[j]
        if not same.any():
            break
        i, j = i[same], j[same]
        hit = _distance(prints[i] ^ prints[j], most) < BITS
        pairs.append((i[hit], j[hit]))
    if not pairs:
        return
    x, y = (np.concatenate(x) for x in zip(*pairs))
    parent = np.arange(len(prints))
    while len(x):
        x, y = _find(parent, x), _find(parent, y)
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
    tree = _find(parent, parent)
    at = np.flatnonzero(tree != np.arange(len(tree)))
    yield at, tree[at]


def _sweep(rows: np.ndarray, prints: np.ndarray, most: int):
    """Near pairs (i, j) of one large group. Each row reached is held against the rows not reached yet."""
    while len(rows):
        queue, rows = deque(rows[:1]), rows[1:]
        while queue and len(rows):
            i = queue.popleft()
            reached = _distance(prints[rows] ^ prints[i], most) < BITS
            if reached.any():
                yield np.full(reached.sum(), i), rows[reached]
                queue.extend(rows[reached])
                rows = rows[~reached]


def _pairs(batches, most: int):
    """Near pairs (a, b) of nodes below each place, for rows sorted by place: those that join its groups, not all."""

    def out(place, prints, node):
        start = np.r_[True, place[1:] != place[:-1]]
        group = np.cumsum(start) - 1
        size = np.bincount(group)[group]
        small, large = np.flatnonzero((size > 1) & (size <= SMALL)), np.flatnonzero(size > SMALL)
        parts = [_few(small, group, prints, most)]
        if len(large):
            parts += [_sweep(rows, prints, most) for rows in np.split(large, np.flatnonzero(np.diff(group[large])) + 1)]
        for i, j in (found for part in parts for found in part):
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])

    held = None
    for batch in batches:
        prints = _segments(batch.column("payload"), REACH)
        rows = [batch.column("place").to_numpy(zero_copy_only=False), prints, batch.column("node").to_numpy(zero_copy_only=False)]
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
        last = np.flatnonzero(rows[0] != rows[0][-1])
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from out(*(x[:cut] for x in rows))
        held = [x[cut:] for x in rows]
    if held is not None and len(held[0]):
        yield from out(*held)


def _sets(batches, shingle: int):
    """block, node and as payload the node's sorted distinct shingles as 64-bit words."""
    for part in slices(batches):
        sets = [distinct_shingles(t, shingle).tobytes() for t in raw(part.column("text"))]
        yield pa.RecordBatch.from_arrays([part.column("block"), part.column("node"), pa.array(sets, pa.binary())], names=["block", "node", "payload"])


def _prefixes(batches, shingle: int, similarity: float):
    """block, node and the node's shingles as payload, for each shingle of its prefix: two sets of at least this similarity share one of the lowest
    n - ceil(similarity * n) + 1 of each."""
    for part in slices(batches):
        blocks, nodes, sets = [], [], []
        for node, text in zip(part.column("node").to_pylist(), raw(part.column("text"))):
            own = distinct_shingles(text, shingle)
            prefix = own[: len(own) - ceil(similarity * len(own) - 1e-9) + 1].view("<i8").tolist()
            blocks += prefix
            nodes += [node] * len(prefix)
            sets += [own.tobytes()] * len(prefix)
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["block", "node", "payload"])


def _forest(sets: list[np.ndarray], group: np.ndarray, similarity: float):
    """Pairs (i, j) of at least this Jaccard similarity that join the groups, as far as any do; group is changed."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    met = owner[np.argsort(code, kind="stable")]
    count = np.bincount(code)
    start, ends = np.cumsum(count) - count, np.cumsum(sizes)
    for i in range(len(sets)):
        if (group == group[0]).all():
            return
        own = code[ends[i] - sizes[i] : ends[i]]
        shared = np.bincount(met[joined_ranges(start[own], count[own])], minlength=len(sets))
        for j in np.flatnonzero((shared + 1e-9 >= similarity * (sizes + sizes[i] - shared)) & (group != group[i])).tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                yield i, j


def _links(batches, similarity: float):
    """Links (a, b) that join the known groups below each place, for rows sorted by place."""
    place, rows = None, []

    def out():
        node = [n for n, _, _ in rows]
        pairs = list(_forest([np.frombuffer(s, "<u8") for _, _, s in rows], np.unique([g for _, g, _ in rows], return_inverse=True)[1], similarity))
        yield pa.RecordBatch.from_arrays([pa.array([node[x[k]] for x in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for at, *row in zip(*(batch.column(c).to_pylist() for c in ("place", "node", "known", "payload"))):
            if at != place and rows:
                yield from out()
                rows.clear()
            place = at
            rows.append(row)
    if rows:
        yield from out()


def _joined(rows: DataFrame, links_of: LinksOf) -> DataFrame:
    """Links between the rows (place, node, known, payload) of each place."""
    dealt = rows.select("place", "node", "known", "payload").repartition("place").sortWithinPartitions("place")
    return materialize(dealt.mapInArrow(links_of, "a long, b long").filter("a <> b"), "block-links")


def _spanning_links(members: DataFrame, links_of: LinksOf, chunk: int) -> DataFrame:
    """Links between the members (block, node, payload) of each block that join whatever links at all join; `links_of` finds those below one place."""
    of_block = lambda df: df.groupBy("block").agg(F.count("*").alias("n"))
    chunk_of = lambda n: F.pmod(F.xxhash64("node"), F.ceil(n / chunk))
    sizes = of_block(members)
    links = _joined(members.join(sizes, "block").select(F.xxhash64("block", chunk_of(F.col("n"))).alias("place"), "node", F.col("node").alias("known"), "payload"), links_of)
    large = members.join(sizes.filter(F.col("n") > chunk).select("block"), "block", "left_semi")
    if large.isEmpty():
        return links

    def grouped() -> DataFrame:
        return large.join(components(links).withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("block", "node", "payload", F.coalesce("component", "node").alias("known"))

    first = materialize(grouped().filter("node = known"), "first-of-groups")
    links = links.union(_joined(first.join(of_block(first), "block").withColumn("place", F.xxhash64("block", chunk_of(F.col("n")))), links_of))

    # Every two chunks of a block with several groups, but those of one group; groups smaller than a chunk share chunks.
    found = materialize(grouped(), "groups")
    parts = found.groupBy("block", "known").agg(F.count("*").alias("n"))
    several = parts.groupBy("block").agg(F.count("*").alias("k"), F.sum(F.when(F.col("n") < chunk, F.col("n"))).alias("rest")).filter("k > 1")
    parts = parts.join(several, "block").select("block", F.col("known").alias("_known"), F.when(F.col("n") >= chunk, F.col("known")).alias("whole"), F.when(F.col("n") >= chunk, F.col("n")).otherwise(F.col("rest")).alias("n"))
    parts = parts.withColumnRenamed("block", "_block")
    found = found.join(parts, (F.col("block") == F.col("_block")) & (F.col("known") == F.col("_known")))
    found = materialize(found.select("block", "node", "known", "payload", "whole", F.xxhash64("whole", F.col("whole").isNull(), chunk_of(F.col("n"))).alias("chunk")), "chunks")
    chunks = materialize(found.select("block", "chunk", "whole").distinct(), "chunk-names")
    x, y = chunks.toDF("block", "x", "u"), chunks.toDF("_block", "y", "v")
    pairs = x.join(y, (F.col("block") == F.col("_block")) & (F.col("x") <= F.col("y")) & ~F.coalesce(F.col("u") == F.col("v"), F.lit(False)))
    sides = pairs.select(F.col("block").alias("_block"), F.xxhash64("block", "x", "y").alias("place"), F.explode(F.array_distinct(F.array("x", "y"))).alias("_chunk"))
    return links.union(_joined(found.join(sides, (F.col("block") == F.col("_block")) & (F.col("chunk") == F.col("_chunk"))), links_of))


def _near(nodes: DataFrame, most: int) -> DataFrame:
    """Near pairs of (print, node): those below each place, and for places with more than KEY_CHUNK nodes those of its chunks and what joins them."""
    keyed = nodes.select("print", "node").mapInArrow(_keys, "place int, payload binary, node long")
    links_of = lambda it: _pairs(it, most)
    crowded = nodes.select("print").mapInArrow(_place_sizes, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).filter(F.col("n") > KEY_CHUNK).select("place")
    crowded = materialize(crowded, "crowded-places")  # SEGMENTS << SEGMENT_BITS rows at most
    if crowded.isEmpty():
        return keyed.repartition("place").sortWithinPartitions("place").mapInArrow(links_of, "a long, b long").filter("a <> b")
    rest = keyed.join(F.broadcast(crowded), "place", "left_anti").select("place", "payload", "node")
    hot = materialize(keyed.join(F.broadcast(crowded), "place").select(F.col("place").cast("long").alias("block"), "node", "payload"), "crowded-keys")
    return rest.repartition("place").sortWithinPartitions("place").mapInArrow(links_of, "a long, b long").filter("a <> b").union(_spanning_links(hot, links_of, KEY_CHUNK))


def _identified(docs: DataFrame) -> tuple[Column, Column]:
    """What tells rows of docs apart: doc_id, LAST for null, and a hash of the text."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)), F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def _placed(docs: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, print), and each print's group by its first row: print, low_id, low_key."""

    most = int((SHORT - 1) / similarity + 1e-9)

    def run(batches):
        for part in slices(batches):
            sets = [distinct_shingles(t, shingle) for t in raw(part.column("text"))]
            few = pa.array([len(x) <= most for x in sets], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_key"), pa.array([fingerprint_of(x) for x in sets], pa.binary()), few], names=["id", "text_key", "print", "few"])

    row_id, text_key = _identified(docs)
    rows = docs.select(row_id.alias("id"), text_key.alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    prints = materialize(rows.mapInArrow(run, "id long, text_key long, print binary, few boolean"), "wide-fingerprints")
    lowest = F.min(F.struct("id", "text_key")).alias("low")
    found = prints.groupBy("print").agg(F.min(F.struct("id", "text_key", "few")).alias("low"))
    nodes = materialize(found.select("print", "low.*", F.monotonically_increasing_id().alias("node")), "wide-nodes")
    heads = nodes.select("id", "text_key", "node", "few")
    text_of = lambda wanted: rows.join(wanted, ["id", "text_key"]).dropDuplicates(["id", "text_key"])
    blocks = components(_near(nodes, budget(similarity))).withColumnRenamed("component", "block")
    wanted = text_of(heads.join(blocks, "node").drop("few")).select("block", "node", "text")
    sets = materialize(wanted.mapInArrow(lambda it: _sets(it, shingle), "block long, node long, payload binary"), "shingle-sets")
    short = text_of(heads.filter("few")).select("node", "text")
    short = materialize(short.mapInArrow(lambda it: _prefixes(it, shingle, similarity), "block long, node long, payload binary"), "short-sets")
    links_of = lambda it: _links(it, similarity)
    named = components(_spanning_links(sets, links_of, CHUNK).union(_spanning_links(short, links_of, CHUNK)))
    grouped = materialize(nodes.join(named, "node", "left").select("print", "id", "text_key", F.coalesce("component", "node").alias("component")), "similar-nodes")
    first = grouped.groupBy("component").agg(lowest).select("component", F.col("low.id").alias("low_id"), F.col("low.text_key").alias("low_key"))
    return prints, grouped.select("print", "component").join(first, "component").select("print", "low_id", "low_key")


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of docs: doc_id and component_id, the smallest doc_id reachable over links between similar texts."""
    prints, groups = _placed(docs, shingle, similarity)
    given = lambda c: F.when(F.col(c) < LAST, F.col(c))
    return prints.join(groups, "print").select(given("id").alias("doc_id"), given("low_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each group of similar texts, that of the smallest doc_id, all columns; rows that are equal in doc_id and text stay together."""
    kept = _placed(docs, shingle, similarity)[1].select("low_id", "low_key").distinct()
    row_id, text_key = _identified(docs)
    return docs.join(kept, (row_id == kept["low_id"]) & (text_key == kept["low_key"]), "left_semi")
