"""Best-fit packing by a configuration linear program.

Pieces of at most `capacity` tokens differ, for packing, only in length, so the whole corpus reduces to a histogram of at most
`capacity` counts. A configuration is a multiset of lengths that fits one sequence. Multiplicative weights solve the covering
program over configurations: each round prices all lengths' best configurations by one knapsack dynamic program, and lengths that
got more than their share lose weight. The fractional answer is rounded, what rounding leaves is solved again a few times, and the rest
is filled by best fit, largest piece first, with the fullest completion that subset sums allow. Spark then ranks the pieces of each length
by doc_id, in parallel, and deals rank r of a length to the configuration slot with that number.

Defined results: a null text counts as empty and packs its end id alone; rows with equal doc_id are separate documents, and equal
rows equal pieces whose order doesn't matter; a null doc_id sorts first and passes through; very long texts give many full pieces;
an empty table gives an empty one; only doc_id and text are read, so further columns of any name don't matter.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, slices, texts
from .tokens import RUN_BYTES, encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, end: int, capacity: int):
    def run(batches):
        words = encoder(path, False)
        for batch in slices(batches, "text", RUN_BYTES):
            ids, counts = words.encode(batch.column("text"), end)
            data = memoryview(ids.astype("<u4")).cast("B")
            per = -(-counts // capacity)
            doc = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), per) if not batch.column("doc_id").null_count else None
            piece = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
            start = piece * capacity
            size = np.minimum(np.repeat(counts, per) - start, capacity)
            first = np.repeat(np.cumsum(counts) - counts, per) + start
            crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), size.tolist())]
            if doc is None:
                doc = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(per)), per)))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def _runs(part: np.ndarray, length: np.ndarray):
    """(rows as a slice, part, length) of each run of equal part and length."""
    if not len(length):
        return
    cuts = np.flatnonzero((part[1:] != part[:-1]) | (length[1:] != length[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(length)]):
        yield slice(a, b), int(part[a]), int(length[a])


def _number(batches):
    """Adds the range's number and each piece's rank among the range's pieces of its length."""
    from pyspark import TaskContext

    me, seen = TaskContext.get().partitionId(), Counter()
    for batch in batches:
        rank = np.zeros(batch.num_rows, np.int64)
        for at, _, n in _runs(np.zeros(batch.num_rows), batch.column("length").to_numpy()):
            rank[at] = seen[n] + np.arange(at.stop - at.start)
            seen[n] += at.stop - at.start
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in NAMES), pa.array(np.full(len(rank), me, np.int32)), pa.array(rank)], names=[*NAMES, "part", "rank"])


def pieces(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = 2048) -> DataFrame:
    return texts(docs).mapInArrow(_pieces(tokenizer, end, capacity), PIECE)


def _price(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value for each room, and the length (as an index, or -1 for one token of waste) taken first."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if k := fits[room]:
            got = value[:k] + best[room - lengths[:k]]
            j = k - 1 - int(got[::-1].argmax())
            if got[j] >= best[room]:
                best[room], taken[room] = got[j], j
    return best, taken


def _configuration(first: int, taken: np.ndarray, lengths: list[int], capacity: int) -> tuple[tuple[int, int], ...]:
    got, room = Counter([first]), capacity - lengths[first]
    while room > 0:
        j = int(taken[room])
        if j < 0:
            room -= 1
            continue
        got[j] += 1
        room -= lengths[j]
    return tuple(sorted(got.items()))


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 40, rate: float = 0.5) -> dict[tuple, float]:
    """Multiplicative weights: configuration -> how often it is used, such that every length is covered about once."""
    m = len(lengths)
    share, value = np.ones(m), lengths / capacity
    used: dict[tuple, float] = {}
    covered = np.zeros(m)
    for _ in range(rounds):
        _, taken = _price(lengths, value, capacity)
        own = [_configuration(i, taken, lengths.tolist(), capacity) for i in range(m)]
        now = np.zeros(m)
        times = [share[i] * counts[i] / dict(own[i])[i] for i in range(m)]
        for c, t in zip(own, times):
            for j, a in c:
                now[j] += a * t
        scale = counts.sum() / max(now.sum(), 1e-9)
        for c, t in zip(own, times):
            used[c] = used.get(c, 0.0) + t * scale
        covered += now * scale
        excess = np.clip(covered / np.maximum(covered.sum() / counts.sum() * counts, 1e-9) - 1, -1, 3)
        value = value * np.exp(-0.02 * excess)
        share = share * np.exp(-rate * excess)
        share /= share.mean()
    return {c: t / rounds for c, t in used.items()}


def _fill(left: np.ndarray, lengths: list[int], first: int, capacity: int) -> tuple[tuple[int, int], ...]:
    """The fullest completion of one piece of the length `first` from the pieces left, larger ones preferred."""
    room, reach, steps = capacity - lengths[first], 1, []
    limit = (1 << (room + 1)) - 1
    for j in range(first, -1, -1):
        n = int(left[j]) - (j == first)
        if n <= 0 or lengths[j] > room:
            continue
        for _ in range(min(n, room // lengths[j])):
            wider = (reach | reach << lengths[j]) & limit
            if wider == reach:
                break
            steps.append((j, reach))
            reach = wider
        if reach >> room & 1:
            break
    at, got = reach.bit_length() - 1, Counter([first])
    for j, before in reversed(steps):
        if not before >> at & 1:
            got[j] += 1
            at -= lengths[j]
    return tuple(sorted(got.items()))


Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def solved(histogram: dict[int, int], capacity: int = 2048, solves: int = 4) -> tuple[Plan, Plan]:
    """The sequences that the linear program gives, and those of best fit for what rounding leaves; each a list of (configuration as
    (length, count) pairs, number of sequences that use it). All pieces of the histogram are placed.

    A solution is rounded by carrying fractions on from configuration to configuration, as far as pieces are left; then the program is
    solved for the pieces left. Configurations that waste tokens are left to best fit."""
    lengths = np.array(sorted(n for n, k in histogram.items() if k), np.int64)
    if not len(lengths):
        return [], []
    sizes = lengths.tolist()
    left = np.array([histogram[n] for n in sizes], np.int64)
    by_program: dict[tuple, int] = {}
    by_fit: dict[tuple, int] = {}

    def use(into: dict, c: tuple, times: int) -> int:
        times = min(times, *(int(left[j]) // a for j, a in c))
        if times > 0:
            into[c] = into.get(c, 0) + times
            for j, a in c:
                left[j] -= a * times
        return max(times, 0)

    for turn in range(solves):
        have, before = np.flatnonzero(left), int(left.sum())
        if not before:
            break
        found = fractional(lengths[have], left[have].astype(float), capacity, 30 if not turn else 12)
        carry = 0.0
        for c, t in sorted(found.items(), key=lambda x: -x[1]):
            c = tuple((int(have[j]), a) for j, a in c)
            if sum(a * sizes[j] for j, a in c) == capacity:
                carry += t
                carry -= use(by_program, c, int(carry + 1e-9))
        if before - left.sum() < 0.02 * before:
            break
    for first in range(len(sizes) - 1, -1, -1):
        while left[first] > 0:
            c = _fill(left, sizes, first, capacity)
            use(by_fit, c, int(left[first]))
    named = lambda plan: [(tuple((sizes[j], a) for j, a in c), n) for c, n in plan.items()]
    return named(by_program), named(by_fit)


def plan(histogram: dict[int, int], capacity: int = 2048) -> Plan:
    """(configuration, number of sequences that use it): the program's, then those of best fit."""
    by_program, by_fit = solved(histogram, capacity)
    return by_program + by_fit


def _slots(chosen) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length, for each configuration that has it: first rank, pieces a sequence, first sequence, offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter = Counter()
    base = 0
    for c, times in chosen:
        at = 0
        for length, a in sorted(c, reverse=True):
            rows.setdefault(length, []).append((ranks[length], a, base, at))
            ranks[length] += a * times
            at += a * length
        base += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*r)) for n, r in rows.items()}


def pack(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = 2048) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = materialize(pieces(docs, tokenizer, end, capacity), "pieces")
    order = ["length", "doc_id", "piece", "ids_crc32"]
    ranged = cut.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    ranged = materialize(ranged.mapInArrow(_number, PIECE + ", part int, rank long"), "ranked-pieces")
    before: dict[tuple[int, int], int] = {}
    histogram: Counter = Counter()
    for part, length, n in sorted(map(tuple, ranged.groupBy("part", "length").count().collect())):  # ranges ascend: capacity + the number of ranges rows at most
        before[part, length] = histogram[length]
        histogram[length] += n
    slots = _slots(plan(histogram, capacity))

    def deal(batches):
        for batch in batches:
            length, part, rank = (batch.column(c).to_numpy() for c in ("length", "part", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for at, p, n in _runs(part, length):
                r = before[p, n] + rank[at]
                first, each, base, start = slots[n]
                k = np.searchsorted(first, r, "right") - 1
                copy, which = np.divmod(r - first[k], each[k])
                sequence[at], offset[at] = base[k] + copy, start[k] + which * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in NAMES), pa.array(sequence), pa.array(offset)], names=[*NAMES, "sequence_id", "offset"])

    return ranged.mapInArrow(deal, PIECE + ", sequence_id long, offset long")
