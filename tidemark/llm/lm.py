"""Language-model scoring: a log-bilinear neural model trained in numpy with noise-contrastive estimation.

The model predicts a token from the two before it: r = C1 q[w-1] + C2 q[w-2], score = r . q[w] + b[w]. Its units are the most
frequent words, each on its own, and buckets of all other words by their last three bytes; the numbers of both grow with the square
root of the vocabulary. Units lie in classes of about equal root frequency: a class is predicted first (r . u[c] + a[c]), then the unit
within it, both by the same r. A word of a bucket has the share of its smoothed count there. Batched matrix products normalise classes
and units of a class exactly, so that a context's probabilities over all words, and one unseen word per bucket, sum to one.

Training runs where the texts are: each task makes gradient steps over all its tokens, with noise drawn anew for every batch from the
units' shares, and gives its parameters; those are averaged, each row by how often the task met it. ROUNDS passes take disjoint parts of
the training documents, so that together they see each token once. Noise follows a seed and the task's number.

Counts of words beyond the frequent ones never leave the executors: documents meet them in a join on the word.

Defined results: a null text counts as empty and is its end token alone; a null doc_id has no remainder and trains; repeated
rows are scored one by one, and equal texts get equal scores; very long texts are read whole. Without training rows all counts are zero
and the model is uniform over its units. An empty table gives an empty one; only doc_id and text are read, so further columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_ranges, materialize, offsets, shuffle_partitions, slices, texts

END = b""
#: Counted words that a task holds, each once a slice of texts, before it passes on their sums.
HELD_WORDS = 500_000
#: Length of a word's vector, noise draws a batch, passes.
SIZE, NOISE, ROUNDS = 24, 24, 2
#: Tokens that a task holds at a time while it trains, and a batch: as many as LEAST_STEPS batches leave, between these bounds. Shorter runs go over theirs again, PASSES times at most.
HELD_TOKENS, BATCH, LEAST_BATCH, LEAST_STEPS, PASSES = 4_000_000, 1 << 12, 1 << 12, 150, 12
#: Tokens scored at a time, and rows of parameters that travel together.
SCORED_TOKENS, ROWS = 1 << 15, 256


def words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All tokens of texts as bytes, each text's words and then its end token, and how many each has. Arrow splits at the same six bytes and lower-cases A-Z alone."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(column))
    values, cuts = parts.values, parts.offsets.to_numpy()
    full = pc.binary_length(values).to_numpy() > 0  # white space at an end of a text leaves an empty part there
    sizes = np.diff(np.append(0, np.cumsum(full))[cuts]) + 1
    at = np.full(sizes.sum(), len(values), np.int64)
    at[joined_ranges(np.cumsum(sizes) - sizes, sizes - 1)] = np.flatnonzero(full)
    return pa.concat_arrays([values, pa.array([""], values.type)]).take(pa.array(at)).cast(pa.binary()), sizes


def _count(batches):
    held, n = [], 0

    def out():
        words, counts = (pa.concat_arrays([x.field(f) for x in held]) for f in ("values", "counts"))
        found = pa.table([words, counts], names=["word", "c"]).group_by("word", use_threads=False).aggregate([("c", "sum")])
        return found.select(["word", "c_sum"]).rename_columns(["word", "c"]).combine_chunks().to_batches()

    for part in slices(batches):
        held.append(words(part.column("text"))[0].value_counts())
        n += len(held[-1])
        if n > HELD_WORDS:
            yield from out()
            held, n = [], 0
    if held:
        yield from out()


def bucket(word: bytes, buckets: int) -> int:
    return crc32(word[-3:]) % buckets


#: By length, what each byte at each place changes in the crc32 of as many zero bytes.
CRC = [[np.array([crc32(bytes(i) + bytes([b]) + bytes(n - 1 - i)) ^ crc32(bytes(n)) for b in range(256)], np.uint32) for i in range(n)] for n in range(4)]


def buckets_of(words: pa.Array, buckets: int) -> np.ndarray:
    """bucket() of each word: crc32 of bytes is the exclusive or of what each of them changes."""
    at, data = offsets(words), np.frombuffer(words.buffers()[2] or b"", np.uint8)
    ends, sizes, out = at[1:], np.minimum(np.diff(at), 3), np.zeros(len(words), np.uint32)
    for n in range(1, 4):
        own = np.flatnonzero(sizes == n)
        crc = np.full(len(own), crc32(bytes(n)), np.uint32)
        for i in range(n):
            crc ^= CRC[n][i][data[ends[own] - n + i]]
        out[own] = crc
    return out.astype(np.int64) % buckets


class Codes(dict):
    """Word to its place among the known ones; any other to len(known) + its bucket."""

    def __init__(self, known: list[bytes], buckets: int):
        super().__init__(zip(known, range(len(known))))
        self.n, self.buckets, self.known = len(known), buckets, pa.array(known, pa.binary())

    def of(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The codes of tokens, which of them aren't known, and these."""
        at = pc.index_in(tokens, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        other = np.flatnonzero(at < 0)
        rare = tokens.take(pa.array(other))
        at[other] = self.n + buckets_of(rare, self.buckets)
        return at, other, rare

    def __missing__(self, word):
        return self.n + crc32(word[-3:]) % self.buckets


@dataclass
class Units:
    """unit_of: unit of each code; units lie by descending share, class c has those from first[c] to first[c + 1]."""

    unit_of: np.ndarray
    share: np.ndarray
    first: np.ndarray

    @property
    def class_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def arrange(own_counts: list[int], bucket_sizes: np.ndarray, bucket_of_known: list[int]) -> Units:
    """own_counts: of the known words that are units; bucket_sizes: smoothed counts of the buckets; bucket_of_known: of the known words that are none."""
    sizes = np.concatenate([np.array(own_counts, float) + 1, bucket_sizes])
    order = np.argsort(-sizes, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    n = len(own_counts)
    share = sizes[order] / sizes.sum()
    root = np.cumsum(np.sqrt(share))
    cls = np.unique(((root - np.sqrt(share) / 2) / root[-1] * max(1, isqrt(len(share)))).astype(np.int64), return_inverse=True)[1]
    first = np.append(np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]]), len(share))
    return Units(np.concatenate([place[:n], place[n + np.array(bucket_of_known, np.int64)], place[n:]]), share, first)


def _order(at: np.ndarray, below: int) -> np.ndarray:
    """Stable order of numbers below a bound; numpy sorts small integers by their digits."""
    return np.argsort(at.astype(np.uint16) if below <= 1 << 16 else at, kind="stable")


def _heads(ascending: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(ascending), bool)
    np.not_equal(ascending[1:], ascending[:-1], out=new[1:])
    return np.flatnonzero(new)


def _sums(rows: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Of runs of rows with an even number of floats; numpy adds two of them at a time as one complex number."""
    return np.add.reduceat(rows.view(np.complex64), heads, axis=0).view(np.float32)


class Grouped:
    """Rows by a number that they share: what belongs to a number is computed once for all of its rows."""

    def __init__(self, at: np.ndarray, below: int):
        self.order = _order(at, below)
        ascending = at[self.order]
        self.heads = _heads(ascending)
        self.values = ascending[self.heads]

    @property
    def place(self) -> np.ndarray:
        """Of each row's number among the values."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.repeat(np.arange(len(self.heads)), np.diff(self.heads, append=len(out)))
        return out

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """Of the rows of each value."""
        return _sums(rows.take(self.order, axis=0), self.heads)


class LogBilinear:
    """All parameters are rows of one matrix: units (vector, bias), classes (vector, bias), and the two context matrices."""

    def __init__(self, units: Units, seed: int = 7):
        self.units, self.class_of = units, units.class_of
        k, c = len(units.share), len(units.first) - 1
        self.k, self.c = k, c
        self.class_share = np.add.reduceat(units.share, units.first[:-1])
        self.running = np.cumsum(units.share)
        self.running_before = np.append(0.0, self.running)[units.first[:-1]]
        #: Logarithms of the expected number of a class, and of a unit within its class, among the noise.
        self.log_class = np.log(NOISE * self.class_share).astype(np.float32)
        self.log_unit = np.log(NOISE * units.share / self.class_share[self.class_of]).astype(np.float32)
        rng = np.random.default_rng(seed)
        p = rng.normal(0, 0.1, (k + c + 2 * SIZE, SIZE + 1)).astype(np.float32)
        p[:k, SIZE] = np.log(units.share / self.class_share[self.class_of])
        p[k : k + c, SIZE] = np.log(self.class_share)
        p[k + c :, :SIZE] = np.concatenate([np.eye(SIZE), 0.5 * np.eye(SIZE)])
        p[k + c :, SIZE] = 0
        self.p, self.grad = p, np.zeros_like(p)

    def _context(self, before: Grouped, earlier: Grouped) -> np.ndarray:
        at = self.k + self.c
        x, y = (self.p.take(g.values, axis=0)[:, :SIZE] @ self.p[start : start + SIZE, :SIZE].T for g, start in ((before, at), (earlier, at + SIZE)))
        r = np.ones((len(before.order), SIZE + 1), np.float32)
        np.add(x.take(before.place, axis=0), y.take(earlier.place, axis=0), out=r[:, :SIZE])
        return r

    def step(self, state: np.ndarray, met: np.ndarray, rng, before, earlier, unit, rate: float) -> None:
        """One step of Adagrad over a batch, whose tokens are taken in the order of their units, hence of their classes. state: sums of squared gradients; met:
        how often each row was met. Both levels are noise-contrastive: the class against classes, the unit against units of its class."""
        p, k, first = self.p, self.k, self.units.first
        order = _order(unit, k)
        unit = unit[order]
        contexts = Grouped(before[order], k), Grouped(earlier[order], k)
        cls = self.class_of[unit]
        r = self._context(*contexts)
        grad, touched = self.grad, np.zeros(len(p), bool)

        def add(at: np.ndarray, rows: np.ndarray) -> None:
            """Rows of different places."""
            grad[at] = grad.take(at, axis=0) + rows
            touched[at] = True

        # What the tokens of each class of the batch are scored against: the classes drawn, the units drawn for it by its units' shares (as
        # places on the running sum of all shares; none where it has one unit), and the class itself.
        cuts, many = _heads(cls), np.diff(first) > 1
        present = cls[cuts]
        classes = np.searchsorted(np.cumsum(self.class_share), rng.random(NOISE) * (1 - 1e-9)).clip(0, self.c - 1)
        drawn = np.searchsorted(self.running, self.running_before[:, None] + rng.random((self.c, NOISE)) * self.class_share[:, None]).clip(first[:-1, None], first[1:, None] - 1)[present]
        against = np.empty((len(cuts), 2 * NOISE + 1, SIZE + 1), np.float32)
        against[:, :NOISE], against[:, NOISE:-1], against[:, -1] = p[k + classes], p.take(drawn, axis=0), p[k + present]
        weights = -against  # their products with r, whose last number is one, are the logarithms of the noise less the scores
        weights[:, :NOISE, SIZE] += self.log_class[classes]
        weights[:, NOISE:-1, SIZE] += np.where(many[present, None], self.log_unit[drawn], 60)
        weights[:, -1, SIZE] += self.log_class[present]
        errors, back, pushed = np.empty((len(r), 2 * NOISE + 1), np.float32), np.empty_like(r), np.empty_like(against)
        found = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(cls)], weights, against, pushed))
        for x, z, w, _, _ in found:
            np.matmul(r[x:z], w.T, out=errors[x:z])
        _shares(errors)
        errors[:, -1] -= 1
        for x, z, _, w, out in found:
            np.matmul(errors[x:z], w, out=back[x:z])
            np.matmul(errors[x:z].T, r[x:z], out=out)
        add(k + present, pushed[:, -1])
        for c, row in zip(classes.tolist(), pushed[:, :NOISE].sum(0)):  # a class may be drawn twice
            grad[k + c] += row
        touched[k + classes] = True
        drawn_by, rows = Grouped(drawn.ravel(), k), pushed[:, NOISE:-1].reshape(-1, SIZE + 1)
        add(drawn_by.values, np.column_stack([drawn_by.sums(np.ascontiguousarray(rows[:, :SIZE])), np.add.reduceat(rows[drawn_by.order, SIZE], drawn_by.heads)]))

        target = p.take(unit, axis=0)
        true = (_shares(self.log_unit[unit] - np.einsum("ij,ij->i", r, target)) - 1) * many[cls]
        back += np.multiply(target, true[:, None], out=target)
        heads = _heads(unit)
        add(unit[heads], np.column_stack([_sums(true[:, None] * r[:, :SIZE], heads), np.add.reduceat(true, heads)]))

        back = np.ascontiguousarray(back[:, :SIZE])
        at = k + self.c
        for start, g in zip((at, at + SIZE), contexts):
            sums = g.sums(back)
            rows = np.zeros((len(sums), SIZE + 1), np.float32)
            np.matmul(sums, p[start : start + SIZE, :SIZE], out=rows[:, :SIZE])
            grad[start : start + SIZE, :SIZE] += sums.T @ p.take(g.values, axis=0)[:, :SIZE] / 16
            add(g.values, rows)
        touched[at:] = True
        met[:k] += np.bincount(before, minlength=k) + np.bincount(earlier, minlength=k) + np.bincount(unit, minlength=k)
        met[k:] += len(unit)
        at = np.flatnonzero(touched)  # few of many units
        g, sums = grad.take(at, axis=0), state.take(at, axis=0)
        grad[at] = 0
        sums += g * g
        state[at] = sums
        g *= rate
        g /= np.sqrt(sums, out=sums)
        p[at] = p.take(at, axis=0) - g

    def train(self, before, earlier, unit, seed, rate: float = 0.2) -> np.ndarray:
        """Steps over all tokens, in order of the texts; short runs take smaller batches and go over theirs again. Returns how often each row was met."""
        rng, state, met = np.random.default_rng(seed), np.ones_like(self.p), np.zeros(len(self.p))
        size = min(BATCH, max(LEAST_BATCH, len(unit) // LEAST_STEPS))
        for _ in range(min(PASSES, -(-LEAST_STEPS // max(-(-len(unit) // size), 1)))):
            for i in range(0, len(unit), size):
                j = slice(i, i + size)
                self.step(state, met, rng, before[j], earlier[j], unit[j], rate)
        return met

    def log_probabilities(self, before, earlier, unit) -> np.ndarray:
        """Natural logarithms of each unit's probability after its context."""
        p, k, first = self.p, self.k, self.units.first
        order = _order(unit, k)  # hence of their classes
        unit = unit[order]
        r, cls = self._context(Grouped(before[order], k), Grouped(earlier[order], k)), self.class_of[unit]
        found = np.concatenate([np.zeros(0, np.float32)] + [_log_softmax(r[i : i + (1 << 12)] @ p[k : k + self.c].T, cls[i : i + (1 << 12)]) for i in range(0, len(cls), 1 << 12)])
        cuts = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1], True]).tolist()
        for a, z in zip(cuts, cuts[1:]):
            lo, hi = first[cls[a]], first[cls[a] + 1]
            for i in range(a, z, 1 << 12) if hi - lo > 1 else ():
                j = slice(i, min(z, i + (1 << 12)))
                found[j] += _log_softmax(r[j] @ p[lo:hi].T, unit[j] - lo)
        out = np.empty(len(order))
        out[order] = found
        return out


def _shares(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place of x; beyond the largest exponential it is 0."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.divide(np.float32(1), x, out=x)


def _log_softmax(scores: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The logarithm at `at` of each row's normalised exponentials; scores is overwritten."""
    scores -= scores.max()
    chosen = scores[np.arange(len(at)), at]
    if chosen.min() < -60:  # a row far below the largest: each row by its own maximum
        scores -= scores.max(1, keepdims=True)
        chosen = scores[np.arange(len(at)), at]
    return chosen - np.log(np.exp(scores, out=scores) @ np.ones(scores.shape[1], np.float32))


def _coded(column: pa.Array, code: Codes, units: Units):
    """Of texts: their tokens' codes, the places of unknown ones and these, all units, the units one and two before each (the end token before a text), and the texts' lengths."""
    tokens, sizes = words(column)
    at, other, rare = code.of(tokens)
    unit, end = units.unit_of[at], units.unit_of[code[END]]
    before, earlier = np.roll(unit, 1), np.roll(unit, 2)
    starts = np.cumsum(sizes) - sizes
    before[starts], earlier[starts] = end, end
    second = starts[sizes > 1] + 1
    earlier[second] = end
    return at, other, rare, unit, before, earlier, sizes


def _trainer(model: LogBilinear, known: list[bytes], buckets: int, seed: int):
    """A task's parameters after its texts, in blocks of rows, with how often each row was met."""

    def run(batches):
        from pyspark import TaskContext

        code, start = Codes(known, buckets), model.p.copy()
        own = LogBilinear(model.units)
        own.p, met, held, size, turn = start.copy(), np.zeros(len(start)), [], 0, 0

        def learn():
            nonlocal met
            met += own.train(*(np.concatenate(x) for x in zip(*held)), seed=[seed, TaskContext.get().partitionId(), turn])

        for part in slices(batches):
            *_, unit, before, earlier, _ = _coded(part.column("text"), code, model.units)
            held.append((before, earlier, unit))
            size += len(unit)
            if size > HELD_TOKENS:
                learn()
                held, size, turn = [], 0, turn + 1
        if held:
            learn()
        if not met.any():
            return
        for i in range(0, len(start), ROWS):
            yield pa.RecordBatch.from_arrays(
                [pa.array([i // ROWS], pa.int32()), pa.array([met[i : i + ROWS]], pa.list_(pa.float64())), pa.array([own.p[i : i + ROWS].ravel()], pa.list_(pa.float32()))], names=["block", "met", "p"]
            )

    return run


def _averaged(table: pa.Table) -> pa.Table:
    """One block of parameters: each row the tasks' mean, weighted by how often they met it."""
    total, weight = None, None
    for met, p in zip(table.column("met").to_pylist(), table.column("p").to_pylist()):
        met = np.array(met)
        p = np.array(p).reshape(len(met), -1) * met[:, None]
        total, weight = (p, met) if total is None else (total + p, weight + met)
    mean = total / np.maximum(weight, 1e-9)[:, None]
    return pa.table([pa.array([table.column("block")[0].as_py()], pa.int32()), pa.array([weight], pa.list_(pa.float64())), pa.array([mean.ravel().astype(np.float32)], pa.list_(pa.float32()))], names=["block", "met", "p"])


def fit(training: DataFrame, known: list[bytes], buckets: int, units: Units, rounds: int = ROUNDS) -> LogBilinear:
    """Rounds of training in the partitions of `training` (as many tasks as there are shuffle partitions at most, each of which gives one set
    of parameters) and averaging of their parameters, a block of ROWS rows in one task."""
    model, schema = LogBilinear(units), "block int, met array<double>, p array<float>"
    for turn in range(rounds):
        part = training.filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn).coalesce(shuffle_partitions(training.sparkSession))
        blocks = part.mapInArrow(_trainer(model, known, buckets, turn), schema).groupBy("block").applyInArrow(_averaged, schema)
        for block, met, p in zip(*blocks.toArrow().to_pydict().values()):  # as many rows as the model has, over ROWS
            at = slice(block * ROWS, block * ROWS + len(met))
            hit = np.array(met) > 0
            model.p[at][hit] = np.array(p, np.float32).reshape(len(met), -1)[hit]
    return model


def _score(model: LogBilinear, known: list[bytes], counts: list[int], buckets: int, bucket_sizes: np.ndarray, is_unit: int):
    """Per document what the known words decide, and the other words with how often it has them. The first is_unit known words are units."""

    def run(batches):
        from pyspark import TaskContext

        code = Codes(known, buckets)
        log_c = np.append(np.log10(np.array(counts, float) + 1), np.zeros(buckets))
        # A word of a bucket has its smoothed count's share there.
        of_bucket = np.array([*(bucket(w, buckets) for w in known), *range(buckets)], np.int64)
        within = np.where(np.arange(len(log_c)) < is_unit, 0.0, log_c - np.log10(bucket_sizes)[of_bucket])
        row = TaskContext.get().partitionId() << 34
        for part in slices(batches):
            at, other, rare, unit, before, earlier, sizes = _coded(part.column("text"), code, model.units)
            lm = np.concatenate([np.zeros(0)] + [model.log_probabilities(before[i : i + SCORED_TOKENS], earlier[i : i + SCORED_TOKENS], unit[i : i + SCORED_TOKENS]) for i in range(0, len(unit), SCORED_TOKENS)]) / np.log(10)
            starts = np.cumsum(sizes) - sizes
            sums = [np.add.reduceat(x, starts) for x in ((at < len(known)).astype(np.int64), log_c[at], lm + within[at])]
            # The distinct unknown words of each text, by (text, word).
            rare = rare.dictionary_encode()
            many = max(len(rare.dictionary), 1)
            pairs, times = np.unique((np.searchsorted(starts, other, "right") - 1) * many + rare.indices.to_numpy(), return_counts=True)
            cuts = pa.array(np.searchsorted(pairs, np.arange(len(sizes) + 1) * many), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, x) for x in (rare.dictionary.take(pa.array(pairs % many)), pa.array(times, pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(row + np.arange(len(sizes))), pa.array(sizes), *(pa.array(x) for x in sums), *lists],
                names=["doc_id", "row", "n_tokens", "known", "log_c", "lm", "rare", "times"],
            )
            row += len(sizes)

    return run


SCORED = "doc_id long, row long, n_tokens long, known long, log_c double, lm double, rare array<binary>, times array<long>"


def _bucket_sizes(own: list[bytes], buckets: int):
    """Counts, and numbers of distinct words, of the words that are no units, per bucket."""

    def run(batches):
        skip, total = pa.array(own, pa.binary()), np.zeros(buckets, np.int64)
        for batch in batches:
            other = batch.filter(pc.invert(pc.is_in(batch.column("word"), value_set=skip)))
            np.add.at(total, buckets_of(other.column("word"), buckets), other.column("c").to_numpy() + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["bucket", "n"])

    return run


@dataclass
class Vocabulary:
    """known: words whose counts a worker holds, the first n_units of them units of the model; bucket_sizes: smoothed counts of the buckets, the unseen word's 1 with them."""

    known: list[bytes]
    counts: list[int]
    n_units: int
    buckets: int
    bucket_sizes: np.ndarray

    def units(self) -> Units:
        return arrange(self.counts[: self.n_units], self.bucket_sizes, [bucket(w, self.buckets) for w in self.known[self.n_units :]])


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """`most` words at most, by descending count and then by word: all with counts of the highest sixteenths of a doubling that hold no more
    together. Two small aggregates find them, so that no task sends `most` rows of its own."""
    size = F.floor(F.log2("c") * 16).cast("int")
    taken, lowest = 0, None
    for b, n in sorted((tuple(r) for r in counts.groupBy(size.alias("size")).count().collect()), reverse=True):  # 16 rows a doubling
        taken += n
        if taken > most:
            break
        lowest = b
    if lowest is None:
        return []
    found = counts.filter(size >= lowest).select("word", "c").toArrow().to_pydict()  # `most` rows at most
    return sorted(zip(map(bytes, found["word"]), found["c"]), key=lambda x: (-x[1], x[0]))


def vocabulary(counts: DataFrame, v: int, per_root: float, frequent: int) -> Vocabulary:
    """Of a table of v counted words. Units: per_root times the square root of v words and half the root of v buckets."""
    n_units, buckets = int(per_root * v**0.5) + 1, isqrt(v) // 2 + 8
    top = most_frequent(counts, max(frequent, n_units))
    known = [w for w, _ in top]
    n_units = min(n_units, len(known))
    sizes = np.ones(buckets)
    for b, n in counts.mapInArrow(_bucket_sizes(known[:n_units], buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # the root of v rows
        sizes[b] += n
    return Vocabulary(known, [c for _, c in top], n_units, buckets, sizes)


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2, per_root: float = 6.0, frequent: int = 32768) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs."""
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False))
    rows = texts(docs)
    training = rows.filter(~out)
    counts = materialize(training.mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    found = vocabulary(counts, v, per_root, frequent)
    model = fit(training, found.known, found.buckets, found.units())
    scored = materialize(rows.mapInArrow(_score(model, found.known, found.counts, found.buckets, found.bucket_sizes, found.n_units), SCORED), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    met = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_log_c"))
    met = met.withColumnRenamed("row", "_row")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.join(met, scored["row"] == met["_row"], "left").select(
        "doc_id", out.alias("held_out"), "n_tokens", (F.col("known") + zero("rare_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_c") + zero("rare_log_c") - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"), (F.col("lm") + zero("rare_log_c")).alias("score"),
    )
