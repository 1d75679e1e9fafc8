"""The prefix trie against a dictionary of prefixes."""

import random

import brute
import pytest
from test_operators import same

from tidemark.llm import common, conversation_trie
from tidemark.operators import ranges

SCHEMA = "conv_id long, turn long, role string, text string, node string, parent int, pos string, depth string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", None, None, None) for r in rows], SCHEMA).repartition(3)


def generated(seed, n):
    """Conversations that share starts, some deep, one of a third of all turns, with nulls, repeated rows and turn numbers."""
    r = random.Random(seed)
    say = ["hello", "hi  there", None, "", "a b\nc", "é" * 50]
    rows = []
    for c in [*range(-30, n), 10**12, 10**12 + 70000]:
        rows += [(c, t if r.random() < 0.95 else None, r.choice(["user", "user", None, ""]), r.choice(say[: 1 + t % 6])) for t in range(r.choice([0, 1, 2, 3, 5, 70 if c % 40 == 0 else 4]))]
    rows += [(20, t, "user", f"t{t}") for t in range(len(rows) // 2)]
    rows += rows[:3] + [(41, 1, "user", "one"), (41, 1, "user", "other"), (None, 1, "user", "lost"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("rows", [generated(1, 60), generated(2, 9), [], [(None, 1, "user", "x")], [(7, None, None, None)], [(7, 0, "user", "a"), (27, 0, "user", "a")]], ids=["large", "small", "empty", "no id", "null turn", "two"])
def test_trie(spark, rows):
    same(conversation_trie.trie(table(spark, rows)), brute.op12(rows))


def test_trie_of_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    same(conversation_trie.trie(df), brute.op12([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]))


def test_long_conversations_are_summed_in_ranges(spark, monkeypatch):
    rows = generated(3, 30)
    monkeypatch.setattr(ranges, "ROWS", 40)
    monkeypatch.setattr(conversation_trie, "CHUNK_BITS", 2)
    same(conversation_trie.trie(table(spark, rows)), brute.op12(rows))


def test_rounds_grow_with_the_logarithm_of_the_depth(spark, monkeypatch):
    written = []
    monkeypatch.setattr(conversation_trie, "materialize", lambda df, name: (written.append(name), common.materialize(df, name))[1])
    rows = [(1000, t, "user", f"t{t}") for t in range(100)]
    same(conversation_trie.trie(table(spark, rows)), brute.op12(rows))
    assert written.count("handed") == 7
