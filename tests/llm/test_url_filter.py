"""The URL filter against plain dictionaries of contexts."""

import brute
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import url_filter
from tidemark.llm.queries import URL_RULES

AWKWARD = [
    (1, None), (2, ""), (3, "no scheme.org/es/"), (4, "http://"), (5, "://org/"), (6, "http://EXAMPLE.org/es/1"), (7, "https://a.b.example.org/es/?q=/en/1"), (8, "https://example.org/en/12"),
    (9, "https://badexample.org/es/"), (10, "https://org"), (11, "https://org/"), (12, "https://org:80/"), (13, "https://x.com/fr/é"), (14, "https://x.com/FR/"), (15, "https://x.com/de/" + "z" * 30_000),
    (16, "https://x.com?u=http://y.org/"), (17, "ftp://x.com#a://b.org/"), (18, "https://日本.com/de/日本"), (19, "https://x.com/de/\n x"), (None, "https://x.com/fr/"), (None, None), (20, "https://x.com/fr/"),
    (20, "https://x.com/fr/"), (21, "https://x.com/fr"), (22, "http:// x y.org/a b"), (23, "https://É.org/fr/ÀB"),
]


def pages(spark, rows):
    return spark.createDataFrame([(p, u, "x", None, None) for p, u in rows], "page_id long, url string, verdict string, host string, n long").repartition(3)


def same(found, rows, order, share):
    expected = brute.op13(rows, [(r.verdict, r.host, r.path) for r in URL_RULES], order, share)
    key = lambda r: repr(r[:5])
    got, expected = sorted(map(tuple, found.collect()), key=key), sorted(expected, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    for a, b in zip(got, expected):
        assert a[5:] == (pytest.approx(b[5], abs=1e-9), pytest.approx(b[6], abs=1e-9))


@pytest.mark.parametrize("share", [1 / 20_000, 1 / 50])
def test_judged_pages(spark, sf_dir, share):
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    same(url_filter.judge(table, URL_RULES, share=share), [tuple(r) for r in table.select("page_id", "url").collect()], 5, share)


@pytest.mark.parametrize("rows", [AWKWARD, AWKWARD[:5], []], ids=["all", "no examples", "empty"])
def test_awkward_urls(spark, rows):
    same(url_filter.judge(pages(spark, rows), URL_RULES, order=3), rows, 3, 1 / 20_000)


def test_held_out_classes_are_told_apart(spark):
    """URLs of two kinds that no rule fits go the way of the examples of their kind."""
    good = [(i, f"https://site{i}.org/article/{i}/history-of-rivers") for i in range(200)]
    bad = [(1000 + i, f"https://x{i}.com/de/win-cash-{i}?bonus=1") for i in range(200)]
    asked = [(5000 + i, f"https://q{i}.net/article/{i}/history-of-lakes") for i in range(30)] + [(6000 + i, f"https://q{i}.net/win-cash-{i}?bonus=2") for i in range(30)]
    found = {r.page_id: r.verdict for r in url_filter.judge(pages(spark, good + bad + asked), URL_RULES).collect()}
    assert {found[5000 + i] for i in range(30)} == {"allow"} and {found[6000 + i] for i in range(30)} == {"block"}


def test_probabilities_sum_to_one(spark):
    models = url_filter.learn(spark.createDataFrame([("allow", "http://a.org/b"), ("allow", "http://a.org/cc")], "verdict string, url string"), 2, 0.0)
    for context in (0, 5, 97 * 42 + 75):
        runs = context * url_filter.SYMBOLS + np.arange(1, url_filter.SYMBOLS)
        assert sum(2.718281828459045 ** models["allow"].log_probabilities(runs)) == pytest.approx(1)


def test_windows_start_anew_with_each_url():
    runs, n = url_filter.windows(pa.array(["", "ab", "x", "ab", "é"])[1:], 2)
    s = url_filter.SYMBOLS
    a, b = ord("a") - 30, ord("b") - 30
    assert n.tolist() == [3, 2, 3, 2] and runs[:3].tolist() == [a, a * s + b, (a * s + b) * s + 1] == runs[5:8].tolist() and runs[-2] == url_filter.OTHER
