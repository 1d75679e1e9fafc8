"""URL filter: allow and block rules, and a character language-model ratio for the URLs that no rule fits.

A URL that a rule decides is an example of what is accepted or rejected. Two variable-order Markov models over the characters learn from
four fifths of them (by a hash of the URL, so its copies stay together). A context counts from order 0 up to `order`, but only while it
makes up at least `share` of its model's characters, which bounds the model (1 / share contexts an order) whatever the input; every
occurrence is counted all the same. A character's probability starts uniform and is mixed, context by longer context, with what
followed there (n + t * shorter) / (total + t), t being the number of different characters that followed. The verdict is the difference of
the two log-likelihoods over the number of characters, against the cut that best separates the other fifth, both classes counting alike.

A URL is repeated rows at most to the counting: tasks add up characters before the shuffle, so hot hosts and URLs make no hot key.

Defined results: a null URL, or one without ://, has an empty host and path, fits no rule and is judged by the empty string; repeated
page_ids and URLs are judged row by row, alike; of rules that fit, the longest (host and path together) wins, then the one with the
longer host; equal likelihoods reach the cut if it isn't positive; without examples of both classes every such URL is allowed, and
without held-out examples of both the cut is 0; long URLs are read whole; only page_id and url are read, so further columns of any name
don't matter; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import offsets, slices

#: Symbols: 0 before the first character, 1 after the last, 2 for what isn't printable ASCII, then the printable characters.
SYMBOLS = 2 + 1 + 94
BEFORE, AFTER, OTHER = 0, 1, 2
#: Distinct character runs that a task holds before it hands their counts on.
HELD_RUNS = 2_000_000
#: Bins of the calibration: differences are clipped to -BOUND to BOUND nats a character.
BINS, BOUND = 4_000, 10.0


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def decided(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls."""
    fits = lambda r: ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
    ranked = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))
    pick = lambda value: F.coalesce(*[F.when(fits(r), value(r)) for r in ranked], F.lit(None).cast("string"))
    return pick(lambda r: F.lit(r.text)), pick(lambda r: F.lit(r.verdict))


def windows(urls: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every character and end, its window of order + 1 symbols as one number (the last symbol counts least); and how many each URL has."""
    at = offsets(urls)
    data = np.frombuffer(urls.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    first = (data & 0xC0) != 0x80  # one symbol per character, not per byte
    symbol = np.where((data > 32) & (data < 127), data.astype(np.int64) - 30, OTHER)[first]
    counts = np.diff(np.concatenate([[0], np.cumsum(first)])[at - at[0]])
    symbol = np.insert(symbol, np.cumsum(counts), AFTER)
    n = counts + 1
    place = np.arange(len(symbol)) - np.repeat(np.cumsum(n) - n, n)
    out = symbol.copy()
    for k in range(1, order + 1):
        earlier = np.concatenate([np.zeros(min(k, len(symbol)), np.int64), symbol[: max(len(symbol) - k, 0)]])
        out += np.where(place >= k, earlier, BEFORE) * SYMBOLS**k
    return out, n


def counted(examples: DataFrame, order: int) -> DataFrame:
    """(verdict, run, n) of (verdict, url) rows: how often each window of order + 1 symbols is met. Tasks add up before the shuffle."""

    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def out():
            for verdict, found in held.items():
                runs, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
                n = np.zeros(len(runs), np.int64)
                np.add.at(n, at, np.concatenate([x for _, x in found]))
                yield pa.RecordBatch.from_arrays([pa.array([verdict] * len(runs), pa.string()), pa.array(runs), pa.array(n)], names=["verdict", "run", "n"])

        for part in slices(batches, "url"):
            verdicts = part.column("verdict")
            for verdict in verdicts.unique().to_pylist():
                urls = part.column("url").filter(pc.equal(verdicts, verdict))
                runs, n = np.unique(windows(urls, order)[0], return_counts=True)
                held.setdefault(verdict, []).append((runs, n))
                size += len(runs)
            if size > HELD_RUNS:
                yield from out()
                held, size = {}, 0
        yield from out()

    return examples.mapInArrow(run, "verdict string, run long, n long").groupBy("verdict", "run").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class MarkovModel:
    """Sorted contexts of each order with total and number of followers, and sorted (context, symbol) entries with their counts."""

    contexts: tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]
    entries: tuple[tuple[np.ndarray, np.ndarray], ...]

    def log_probabilities(self, runs: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each window's last symbol after those before it."""
        p = np.full(len(runs), 1 / (SYMBOLS - 1))  # nothing begins again: BEFORE has no probability
        for k, ((context, total, kinds), (entry, n)) in enumerate(zip(self.contexts, self.entries)):
            if not len(context):
                break
            own = runs % SYMBOLS ** (k + 1)
            before = own // SYMBOLS
            at = np.minimum(np.searchsorted(context, before), len(context) - 1)
            known = context[at] == before
            to = np.minimum(np.searchsorted(entry, own), len(entry) - 1)
            times = np.where(entry[to] == own, n[to], 0)
            p = np.where(known, (times + kinds[at] * p) / (total[at] + kinds[at]), p)
        return np.log(p)


def learn(examples: DataFrame, order: int, share: float) -> dict[str, MarkovModel]:
    """A model per verdict. What comes to the driver is bounded by 1 / share contexts an order and the symbols that may follow each."""
    runs = counted(examples, order)
    suffixes = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("run") % SYMBOLS ** (k + 1)).alias("entry")) for k in range(order + 1)])
    entries = runs.select("verdict", "n", F.explode(suffixes).alias("s")).groupBy("verdict", "s.k", "s.entry").agg(F.sum("n").alias("n"))
    entries = entries.withColumn("context", F.expr(f"entry div {SYMBOLS}"))
    contexts = entries.groupBy("verdict", "k", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    sizes = contexts.filter("k = 0").select("verdict", F.col("total").alias("size"))  # a row a verdict
    kept = contexts.join(F.broadcast(sizes), "verdict").filter(F.col("total") >= F.col("size") * share)
    found = entries.join(kept, ["verdict", "k", "context"]).select("verdict", "k", "context", "total", "kinds", "entry", "n").toArrow()
    out = {}
    column = {c: found.column(c).to_numpy() for c in ("k", "context", "total", "kinds", "entry", "n")}
    of = np.array(found.column("verdict").to_pylist(), object)
    for verdict in sorted(set(of.tolist())):
        parts = []
        for k in range(order + 1):
            at = np.flatnonzero((of == verdict) & (column["k"] == k))
            at = at[np.argsort(column["entry"][at])]
            context, first = np.unique(column["context"][at], return_index=True)
            parts.append(((context, column["total"][at][first], column["kinds"][at][first]), (column["entry"][at], column["n"][at])))
        out[verdict] = MarkovModel(*map(tuple, zip(*parts)))
    return out


def cut(differences: dict[str, np.ndarray], low: str, high: str) -> float:
    """The edge between bins with the smallest mean error rate of both classes (the nearest to 0 of equals); 0 without examples of both."""
    if not (differences[low].sum() and differences[high].sum()):
        return 0.0
    edges = np.linspace(-BOUND, BOUND, BINS + 1)
    missed = np.concatenate([[0], np.cumsum(differences[high])]) / differences[high].sum()
    passed = 1 - np.concatenate([[0], np.cumsum(differences[low])]) / differences[low].sum()
    error = np.round(missed + passed, 12)
    best = np.flatnonzero(error == error.min())
    return float(edges[best[np.argmin(np.abs(edges[best]))]])


def scored(rows: DataFrame, models: dict[str, MarkovModel], order: int, high: str, low: str) -> DataFrame:
    """Adds `difference` (null without both models) to rows with a `url`; other columns pass through."""
    kept = rows.columns
    if high not in models or low not in models:
        return rows.withColumn("difference", F.lit(None).cast("double"))
    held = rows.sparkSession.sparkContext.broadcast((models[high], models[low]))

    def run(batches):
        above, below = held.value
        for part in slices(batches, "url"):
            runs, n = windows(part.column("url"), order)
            found, at = np.unique(runs, return_inverse=True)
            gain = (above.log_probabilities(found) - below.log_probabilities(found))[at]
            mean = np.add.reduceat(gain, np.cumsum(n) - n) / n
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(mean)], names=[*kept, "difference"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in [*rows.dtypes, ("difference", "double")]))


def judge(pages: DataFrame, rules: list[Rule], order: int = 5, share: float = 1 / 20_000, high: str = "allow", low: str = "block") -> DataFrame:
    """page_id, host, path, rule, verdict, difference (per character; null where a rule decides or there is no model) and cut."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule, verdict = decided(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict, "url": F.coalesce("url", F.lit(""))})
    sure = rows.filter(F.col("verdict").isNotNull()).select("verdict", "url", (F.crc32("url") % 5 == 0).alias("held_out"))
    models = learn(sure.filter("NOT held_out").drop("held_out"), order, share)
    rest = scored(sure.filter("held_out").drop("held_out"), models, order, high, low)
    edge = F.floor((F.least(F.greatest("difference", F.lit(-BOUND)), F.lit(BOUND)) + BOUND) * (BINS / (2 * BOUND)))
    bins = rest.filter("difference IS NOT NULL").groupBy("verdict", F.least(edge, F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n")).collect()  # two verdicts' bins at most
    found = {v: np.zeros(BINS, np.int64) for v in (high, low)}
    for r in bins:
        found[r.verdict][r.bin] += r.n
    limit = cut(found, low, high)
    open_rows = scored(rows.filter(F.col("verdict").isNull()), models, order, high, low)
    done = rows.filter(F.col("verdict").isNotNull()).withColumn("difference", F.lit(None).cast("double"))
    verdict = F.when(F.coalesce(F.col("difference") >= limit, F.lit(True)), F.lit(high)).otherwise(F.lit(low))
    columns = ["page_id", "host", "path", "rule", "verdict", "difference"]
    return done.select(columns).union(open_rows.withColumn("verdict", verdict).select(columns)).withColumn("cut", F.lit(limit))
