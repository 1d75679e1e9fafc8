"""Cross-tokenizer alignment against a walk over both token lists of each text."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from test_operators import BYTE, PIECE, awkward, frame, same

from tidemark.llm import alignment

SPACES = ["  a", "a  b", " ", "   ", "a ", "a \n b", "\n a\n  b \n", "a  b", "a 　b", "a▁b c", "<s> <0x41> </s>", "<|endoftext|> x", "\x1c a \x1d", "a b\t c", "x" * 3000, "日本 語 " * 5, "é é", "\u0000 a"]


@pytest.fixture(scope="module", params=["table", "awkward", "spaces", "empty"])
def data(request, spark, sf_dir):
    if request.param == "table":
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        return docs, [tuple(r) for r in docs.select("doc_id", "text").collect()]
    rows = {"awkward": awkward(), "spaces": list(enumerate(SPACES + SPACES[:3])), "empty": []}[request.param]
    return frame(spark, rows), rows


def test_link_statistics(data):
    docs, rows = data
    same(alignment.link_statistics(docs, BYTE, PIECE), brute.op11(rows, BYTE, PIECE))


def test_link_statistics_over_many_slices(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    same(alignment.link_statistics(docs, BYTE, PIECE, slice_bytes=20_000), brute.op11([tuple(r) for r in docs.select("doc_id", "text").collect()], BYTE, PIECE))


def test_aligner_that_forgets_units(monkeypatch):
    r = random.Random(7)
    words = ["".join(r.choices("abcdeé", k=r.randint(1, 9))) for _ in range(900)]
    runs = [pa.array([" ".join(r.choices(words, k=200)) + "  x" for _ in range(5)]) for _ in range(6)]
    whole = alignment.Aligner(BYTE, PIECE)
    expected = [[whole.take(i, whole.units(x)[0])[0].tolist() for i in range(6)] for x in runs]
    for name, value in (("HELD_UNITS", 500), ("KEPT_UNITS", 100)):
        monkeypatch.setattr(alignment, name, value)
    forgetful = alignment.Aligner(BYTE, PIECE)
    for x, found in zip(runs, expected):
        code, counts = forgetful.units(x)
        assert [forgetful.take(i, code)[0].tolist() for i in range(6)] == found and counts.sum() == len(code)
    assert len(forgetful.code) < len(whole.code)


def test_groups_with_many_links_expand_by_distinct_ids(monkeypatch):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 5, 60), rng.integers(0, 5, 40)
    to_a, to_b = np.array([1, 30, 31, 60]), np.array([3, 20, 39, 40])

    def counts():
        out = {}
        for g, p, n in zip(*(x.tolist() for x in alignment.linked(a, b, to_a, to_b))):
            out[g, p] = out.get((g, p), 0) + n
        return out

    expected = counts()
    monkeypatch.setattr(alignment, "EXPANDED", 20)
    assert counts() == expected and sum(expected.values()) == 1 * 3 + 29 * 17 + 1 * 19 + 29 * 1


def test_alignments_and_counts(spark):
    rows = [(1, "strawberries are naïve"), (2, ""), (3, "strawberries  strawberries"), (4, None)]
    found = {r.doc_id: r for r in alignment.align(frame(spark, rows), BYTE, PIECE).collect()}
    expected = {r[0]: r for r in brute.op11(rows, BYTE, PIECE)}
    for d, r in found.items():
        assert (len(r.a), len(r.b), len(r.a_ends), len(r.b_ends)) == (*expected[d][1:3], expected[d][3], expected[d][3])
        assert (r.a_ends[-1:], r.b_ends[-1:]) == ([len(r.a)] if r.a else [], [len(r.b)] if r.b else [])
        groups = ";".join(",".join(map(str, r.a[i:j])) + "|" + ",".join(map(str, r.b[k:m])) for i, j, k, m in zip([0, *r.a_ends], r.a_ends, [0, *r.b_ends], r.b_ends))
        assert brute.sha256(groups.encode()).hexdigest() == expected[d][7] or not groups
    counts = alignment.link_counts(frame(spark, rows), BYTE, PIECE).collect()
    assert {r.n_docs for r in counts} == {1, 2} and all(any(r.best for r in counts if r.a == a) for a in {r.a for r in counts})


def test_groups_close_at_shared_ends():
    r = random.Random(2)
    for _ in range(300):
        a, b = ({*r.sample(range(1, 40), r.randint(0, 12)), 40} for _ in range(2))
        end, to_a, to_b = alignment.groups_of(np.array(sorted(a)), np.array(sorted(b)))
        assert end.tolist() == sorted(a & b)
        assert to_a.tolist() == [sum(x <= e for x in a) for e in end] and to_b.tolist() == [sum(x <= e for x in b) for e in end]
