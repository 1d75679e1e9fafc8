"""Prefix trie of conversations: which ones share their first turns, and how many tokens a shared prefix saves.

A node is a distinct sequence of first turns. Its key is a digest of that sequence: the sums of its turns' hashes, each of which covers
the turn's place, role and text, so that a running sum gives all prefixes of a conversation and a very long one can be summed in ranges
(tidemark.operators.ranges). A turn's own hash taken off again gives the parent's key: the edges need no join.

Leaves and savings of subtrees come by pointer jumping: in round k every node points to its ancestor 2**k levels up and knows the sums of
its subtree less than 2**k levels deep; the nodes at exactly 2**k below hand theirs up, and pointers are joined with themselves. A trie
of depth d takes log2(d) rounds, whatever the length of the conversations, and nodes whose pointer has left the root are out of the later
rounds. Each round is a table in the shared folder. The ids of conversations that end at a node are joined in chunks of bounded
length by many tasks, and the chunks hashed in order.

Defined results: turns are ordered by number, null first, then by role and by the text's SHA-256 (repeated numbers); a null role or text is
empty; turns without conv_id belong to no conversation and are left out, as no id can be rebuilt from them; a repeated row is a turn of
its own; an empty table gives no node, not even a root; only conv_id, turn, role and text are read, so further columns of any name don't
matter.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranges import numbered

from .common import materialize

C = F.col
#: 32-bit pieces of a turn's SHA-256 that are summed: 160 bits. A sum of 2**31 turns fits a long.
PIECES = 5
#: Conversation ids of one chunk, by their value: 2**16 of them at most.
CHUNK_BITS = 16
WORD = r"[^\x20\x09-\x0D]+"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn digest and n_words. Texts go no further than this."""
    text, role = F.coalesce(C("text"), F.lit("")), F.coalesce(C("role"), F.lit(""))
    rows = conversations.filter(C("conv_id").isNotNull()).select(
        C("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.sha2(text, 256).alias("of_text"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
    )
    return numbered(rows, ["conv_id"], ["turn", "role", "of_text"], "pos").select("conv_id", "pos", "digest", "n_words")


def shared_starts(turns: DataFrame, group: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations, and the table of their turns: conversation c has the first h turns of c - c % group in place of its own, h = crc32(c) % (most + 1)."""
    ids = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    ids = ids.withColumns({"h": F.crc32(C("conv_id").cast("string")) % (most + 1), "base": C("conv_id") - C("conv_id") % group})
    own = turns.join(ids.select("conv_id", "h", "base"), "conv_id").filter("pos > h")
    first = turns.filter(C("pos") <= most).select(C("conv_id").alias("base"), "pos", "digest", "n_words")
    lent = ids.filter("h > 0").join(first, "base").filter("pos <= h").select("conv_id", "pos", "digest", "n_words")  # `group` conversations a base, `most` turns each
    has = first.groupBy("base").agg(F.count("*").alias("has"))
    own = own.join(has, "base", "left").select("conv_id", (C("pos") - C("h") + F.least("h", F.coalesce("has", F.lit(0)))).alias("pos"), "digest", "n_words")
    return ids.select("conv_id"), lent.unionByName(own)


def _piece(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", depth.cast("string"), *[s.cast("string") for s in sums])))


def prefixes(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, n_words, last): every conversation with each of its prefixes, the empty one too; last: it is the whole conversation."""
    here = F.sha2(F.concat(C("pos").cast("string"), F.lit(":"), C("digest")), 256)
    rows = turns.withColumn("_h", here)
    rows = rows.select("conv_id", "pos", "n_words", *[_piece(C("_h"), i).alias(f"_p{i}") for i in range(PIECES)])
    summed = numbered(rows, ["conv_id"], ["pos"], "_n", {f"_s{i}": C(f"_p{i}") for i in range(PIECES)})
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("_length"))
    each = summed.join(lengths, "conv_id").select(
        "conv_id", C("pos").alias("depth"), _key(C("pos"), [C(f"_s{i}") for i in range(PIECES)]).alias("node"), _key(C("pos") - 1, [C(f"_s{i}") - C(f"_p{i}") for i in range(PIECES)]).alias("parent"),
        "n_words", (C("pos") == C("_length")).alias("last"),
    )
    empty = ids.join(lengths, "conv_id", "left").select("conv_id", F.lit(0).cast("long").alias("depth"), _key(F.lit(0), [F.lit(0)] * PIECES).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("n_words"), C("_length").isNull().alias("last"))
    return each.unionByName(empty)


def ends(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes where conversations end: SHA-256 of their ids in ascending order, joined by commas."""

    def run(batches):
        node, state = None, None
        for batch in batches:
            out = []
            for key, text in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if key != node:
                    if state is not None:
                        out.append((node, state.hexdigest()))
                    node, state = key, sha256(text.encode())
                else:
                    state.update(f",{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([h for _, h in out], pa.string())], names=["node", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    own = members.filter("last").select("node", "conv_id", F.shiftright("conv_id", CHUNK_BITS).alias("chunk"))
    chunks = own.groupBy("node", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return chunks.repartition("node").sortWithinPartitions("node", "chunk").select("node", "ids").mapInArrow(run, "node binary, ends_sha256 string")


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """nodes (node, parent and the values, among others) with each value summed over the node's subtree, by pointer jumping."""
    spark = nodes.sparkSession
    handed = None
    active = materialize(nodes.filter(C("parent").isNotNull()).select("node", C("parent").alias("up"), *values), "pointers")
    while not active.isEmpty():
        up = materialize(active.groupBy("up").agg(*[F.sum(v).alias(f"_{v}") for v in values]), "handed")
        handed = up if handed is None else handed.unionByName(up)
        at = active.join(up.withColumnRenamed("up", "_node"), C("node") == C("_node"), "left")
        at = at.select("node", "up", *[(C(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values])
        further = active.select(C("node").alias("_up"), C("up").alias("_further"))
        active = materialize(at.join(further, C("up") == C("_up")).select("node", C("_further").alias("up"), *values), "pointers")
    if handed is None:
        handed = spark.createDataFrame([], "up binary, " + ", ".join(f"_{v} long" for v in values))
    total = handed.groupBy("up").agg(*[F.sum(f"_{v}").alias(f"_{v}") for v in values])
    at = nodes.join(total, C("node") == C("up"), "left")
    return at.withColumns({v: C(v) + F.coalesce(f"_{v}", F.lit(0)) for v in values}).drop("up", *[f"_{v}" for v in values])


def trie(conversations: DataFrame) -> DataFrame:
    """A row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ids, turns = shared_starts(materialize(turns_of(conversations), "turns"))
    members = materialize(prefixes(ids, materialize(turns, "rebuilt")), "prefixes")
    found = members.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.count("*").alias("n_convs"), F.first("n_words").alias("n_words"))
    found = materialize(found, "nodes")
    below = found.filter(C("parent").isNotNull()).groupBy(C("parent").alias("_parent")).agg(F.count("*").alias("_children"))
    found = found.join(below, C("node") == C("_parent"), "left").withColumn("n_children", F.coalesce("_children", F.lit(0))).drop("_parent", "_children")
    found = found.withColumns({"n_leaves": (C("n_children") == 0).cast("long"), "saved_tokens": (C("n_convs") - 1) * C("n_words")})
    summed = subtree_sums(materialize(found, "own"), ["n_leaves", "saved_tokens"])
    over = found.select(C("node").alias("_above"), C("conv_id").alias("parent_conv_id"))
    summed = summed.join(over, C("parent") == C("_above"), "left").join(ends(members).withColumnRenamed("node", "_end"), C("node") == C("_end"), "left")
    return summed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"))
