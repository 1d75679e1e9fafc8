"""Suffix-array dedup of byte strings that repeat across documents.

A byte goes if a `window`-byte string that covers it also starts in a document with a smaller doc_id. Equal strings have the same
minimizer (the least hashed LEAD-byte word in them, leftmost of equals), so only suffixes that start at a minimizer are sorted,
about one in twenty; such an anchor stands for the run of windows whose minimizer it is, and has what precedes it as a second,
reversed suffix. Splitters sampled from the corpus range-partition the suffixes by their leading bytes, and by doc_id where a
leading word is so common that several splitters share it. A bucket sorts its suffixes, and their reversed left sides, by multikey quicksort
over 8-byte characters; two windows are equal where both sorts put them in one run at the window's depths. Words that
splitters part are compared across the buckets: each bucket passes on its smallest doc_id per such window.

Suffixes travel in packed blocks, one per bucket and flush of a task, and so do the texts that meet their removed windows at the end.

Defined results: a null text counts as empty; a null doc_id counts as larger than all others, and rows with one doc_id never remove
bytes from each other; a doc_id of 2**63 - 1 is a null one; texts shorter than the window lose nothing; very long texts are cut into
overlapping stretches for the search alone; an empty table gives an empty one; only doc_id and text are read, so further columns of any
name don't matter.
"""

from __future__ import annotations

from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_ranges, materialize, offsets, shuffle_partitions, slices, texts

LEAD = 12
LAST = (1 << 63) - 1
FLUSH = 400_000
#: Windows that a task holds before it passes them on, some 100 MB.
HELD_WINDOWS = 3_000_000
#: Bytes of text that a task packs at a time per group of documents.
HELD_TEXT = 24 << 20
#: Bytes of text whose suffixes make a bucket, and bytes of a group of documents, at most about: numbers of both grow with the input.
BUCKET_BYTES, PART_BYTES = 16 << 20, 32 << 20
#: Sampled suffixes and bytes of sampled texts per bucket.
OVERSAMPLE, SAMPLE_BYTES = 24, 256 << 10
#: A leading word stays whole, in one bucket, while it has at most so many buckets' share of the suffixes.
WHOLE = 8


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def anchors(data: np.ndarray, cuts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of texts data[cuts[i]:cuts[i+1]]: position, and the first and last window that has it as minimizer."""
    n = len(data) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = len(data) - LEAD + 1
    head = np.ndarray((words,), "<u8", padded.tobytes(), 0, (1,))
    tail = np.ndarray((words,), "<u4", padded.tobytes(), 8, (1,))
    key = _mix(head * np.uint64(0x9E3779B97F4A7C15) ^ _mix(tail.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
    key = (key & np.uint64(0xFFFFFFFFFF000000)) | np.arange(words, dtype=np.uint64)
    span = window - LEAD + 1
    low, width = key, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    chosen = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    sizes = np.maximum(np.diff(cuts) - window + 1, 0)
    at = joined_ranges(cuts[:-1], sizes)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    picked = chosen[at]
    starts = np.flatnonzero(np.concatenate([[True], (picked[1:] != picked[:-1])]))
    ends = np.append(starts[1:], len(at)) - 1
    return picked[starts], at[starts], at[ends]


def _sides(data: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Per anchor `window` bytes from it on, and what precedes it, nearest byte first; zeros beyond its windows."""
    padded = np.concatenate([np.zeros(window, np.uint8), data, np.zeros(window, np.uint8)])
    right = np.lib.stride_tricks.sliding_window_view(padded, window)[at + window].copy()
    right[np.arange(window) >= (last + window - at)[:, None]] = 0
    reach = window - LEAD
    left = np.lib.stride_tricks.sliding_window_view(padded, reach)[at + window - reach][:, ::-1].copy()
    left[np.arange(reach) >= (at - first)[:, None]] = 0
    return right, left


def _documents(batches):
    """(bytes, cuts, doc ids with LAST for null, row keys) of runs of rows."""
    for part in slices(batches, "text", 3 << 20):
        column = part.column("text")
        cuts = offsets(column)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]]
        yield data, cuts - cuts[0], part.column("doc_id").fill_null(LAST).to_numpy(), part.column("row").to_numpy()


def _pieces(data, cuts, window):
    """Anchors of a run of documents, longer texts cut into overlapping stretches so that positions stay below 2**24."""
    limit = 1 << 23
    if len(data) <= limit:
        yield anchors(data, cuts, window)
        return
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        for start in range(a, max(a + 1, b - window + 1), limit):
            stop = min(b, start + limit + window - 1)
            yield tuple(x + start for x in anchors(data[start:stop], np.array([0, stop - start]), window))


def _lead_key(right: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """LEAD bytes and the doc_id as one comparable string."""
    full = np.zeros((len(right), LEAD + 9), np.uint8)
    full[:, :LEAD] = right[:, :LEAD]
    full[:, LEAD : LEAD + 8] = (doc.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    full[:, LEAD + 8] = 1
    return full.view(f"S{LEAD + 9}").ravel()


def sample_splitters(rows: DataFrame, total: int, buckets: int, window: int) -> list[bytes]:
    """buckets - 1 splitters at most, from a sample of the suffixes whose size follows from the number of buckets. The sample only
    balances the buckets; no row depends on it. A leading word that takes up to WHOLE splitters stays whole; one that takes more is parted by doc_id."""
    drawn = min(1.0, SAMPLE_BYTES * buckets / max(total, 1))
    rows = rows.sample(drawn, 11) if drawn < 1 else rows
    share = min(1.0, 20.0 * OVERSAMPLE * buckets / max(total * drawn, 1))

    def pick(batches):
        for data, cuts, doc, _ in _documents(batches):
            for at, first, last in _pieces(data, cuts, window):
                keep = (_mix(at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + doc[np.searchsorted(cuts, at, "right") - 1].view(np.uint64)) >> np.uint64(11)).astype(float) < share * (1 << 53)
                at, first, last = at[keep], first[keep], last[keep]
                right, _ = _sides(data, at, first, last, window)
                yield pa.RecordBatch.from_arrays([pa.array([x.ljust(LEAD + 9, b"\0") for x in _lead_key(right, doc[np.searchsorted(cuts, at, "right") - 1]).tolist()], pa.binary())], names=["key"])

    keys = sorted(bytes(r["key"]) for r in rows.mapInArrow(pick, "key binary").collect())  # about OVERSAMPLE * buckets rows
    if not keys:
        return []
    cut = [keys[len(keys) * i // buckets] for i in range(1, buckets)]
    taken, out = Counter(k[:LEAD] for k in cut), set()
    for k in cut:
        out |= {k[:LEAD].ljust(LEAD + 9, b"\0")} | ({k} if taken[k[:LEAD]] > WHOLE else set())
    return sorted(out)


def _packed(right, left, doc, row, at, first, last) -> bytes:
    """Suffixes in the order of their leads. Both sides stand in one string in the order of the text, so that what precedes one suffix
    compresses against what follows another; numbers are delta coded and lie byte by byte."""
    order = np.argsort(_lead_key(right, doc), kind="stable")
    strings = np.concatenate([left[order, ::-1], right[order]], axis=1)
    numbers = [np.diff(c[order].astype(np.int64), prepend=0).view(np.uint8).reshape(-1, 8).T for c in (doc, row, at)]
    small = [c[order].astype(np.uint8) for c in (at - first, last - first)]
    return zstandard.ZstdCompressor(level=4).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in (strings, *numbers, *small)))


def _unpacked(blob: bytes, n: int, window: int):
    data, reach = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), window - LEAD
    strings, rest = data[: n * (reach + window)].reshape(n, reach + window), data[n * (reach + window) :]
    doc, row, at = (np.cumsum(np.ascontiguousarray(x.T).view(np.int64).ravel()) for x in rest[: 24 * n].reshape(3, 8, n))
    return [strings[:, reach:], strings[:, :reach][:, ::-1], doc, row, at, rest[24 * n : 25 * n], rest[25 * n :]]


def _blocks(splitters: list[bytes], window: int):
    """Packs a task's suffixes per bucket."""
    cut = np.array([s for s in splitters], f"S{LEAD + 9}")

    def flush(held):
        right, left, doc, row, at, first, last = (np.concatenate(x) for x in zip(*held))
        bucket = np.searchsorted(cut, _lead_key(right, doc), "right") if len(cut) else np.zeros(len(doc), np.int64)
        order = np.argsort(bucket, kind="stable")
        ids, starts = np.unique(bucket[order], return_index=True)
        out = []
        for b, a, z in zip(ids.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)]):
            i = order[a:z]
            out.append((b, z - a, _packed(right[i], left[i], doc[i], row[i], at[i], first[i], last[i])))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "n", "block"])

    def run(batches):
        held, size = [], 0
        for data, cuts, docs, keys in _documents(batches):
            for at, first, last in _pieces(data, cuts, window):
                for i in range(0, len(at), 1 << 16):
                    a, f, z = at[i : i + (1 << 16)], first[i : i + (1 << 16)], last[i : i + (1 << 16)]
                    right, left = _sides(data, a, f, z, window)
                    d = np.searchsorted(cuts, a, "right") - 1
                    held.append((right, left, docs[d], keys[d], a - cuts[d], f - cuts[d], z - cuts[d]))
                    size += len(a)
                    if size > FLUSH:
                        yield from flush(held)
                        held, size = [], 0
        if size:
            yield from flush(held)

    return run


def multikey_quicksort(words: np.ndarray, small: int = 1 << 14) -> np.ndarray:
    """Order of rows of 8-byte characters: ternary partition by one character, the equal part goes on with the next; small ranges are sorted at once."""
    n, m = words.shape
    order = np.arange(n)
    stack = [(0, n, 0)]
    while stack:
        lo, hi, d = stack.pop()
        if hi - lo < 2 or d == m:
            continue
        part = order[lo:hi]
        if hi - lo <= small:
            order[lo:hi] = part[np.lexsort(words[part, d:].T[::-1])]
            continue
        key = words[part, d]
        pivot = np.sort(key[:: max(1, len(key) // 64)])[min(len(key), 64) // 2 - 1]
        less, more = key < pivot, key > pivot
        same = ~(less | more)
        a, b = int(less.sum()), int(same.sum())
        order[lo:hi] = np.concatenate([part[less], part[same], part[more]])
        stack += [(lo, lo + a, d), (lo + a, lo + a + b, d + 1), (lo + a + b, hi, d)]
    return order


def _sorted_runs(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each row in sorted order, and the common prefix of each sorted row with the one before it."""
    n, width = strings.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = strings
    order = multikey_quicksort(wide.view(">u8").astype(np.uint64))
    ranked = strings[order]
    common = np.zeros(n, np.int64)
    if n > 1:
        differ = ranked[1:] != ranked[:-1]
        common[1:] = np.where(differ.any(1), differ.argmax(1), width)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return place, common


def repeated_windows(right, left, doc, before, count, window, shared):
    """For suffixes of one bucket: flags (row, offset) of windows whose string has a smaller doc_id here, and of windows of `shared` rows that have not.

    before: bytes from the row's first window to its anchor; count: its windows less one."""
    if not len(doc):
        return []
    right_at, right_lcp = _sorted_runs(right)
    left_at, left_lcp = _sorted_runs(left)
    found = []
    for o in range(window - LEAD + 1):
        rows = np.flatnonzero((before >= o) & (o >= before - count))
        if len(rows) < 1:
            continue
        run = np.cumsum(right_lcp < window - o)[right_at[rows]]
        side = np.cumsum(left_lcp < o)[left_at[rows]]
        key = (run.astype(np.int64) << 32) | side
        order = np.lexsort((doc[rows], key))
        key, rows = key[order], rows[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        lowest = np.repeat(doc[rows[head]], np.diff(np.append(head, len(rows))))
        again = doc[rows] > lowest
        firsts = ~again & shared[rows]
        found.append((o, rows[again], rows[firsts]))
    return found


DIGEST = 16


def _compare(splitters: list[bytes], window: int, parts: int):
    """Sorts a bucket and gives runs of removed windows as packed blocks per group of documents, and undecided windows of words that splitters part."""
    def bucket_rows(batches):
        held, bucket = [], None
        for batch in batches:
            for b, n, block in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "block"))):
                if held and b != bucket:
                    yield bucket, held
                    held = []
                bucket = b
                held.append(_unpacked(block, n, window))
        if held:
            yield bucket, held

    def run(batches):
        # A task's buckets share their blocks, so that there is one block per task and group of documents, not per bucket.
        gone, open_windows, size = [], [], 0
        for bucket, held in bucket_rows(batches):
            right, left, doc, row, at, before, count = (np.concatenate(x) for x in zip(*held))
            lead = np.ascontiguousarray(right[:, :LEAD])
            wide = np.zeros((len(lead), 16), np.uint8)
            wide[:, :LEAD] = lead
            order = multikey_quicksort(wide.view(">u8").astype(np.uint64))
            lead = lead[order].view(f"V{LEAD}").ravel()
            head = np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1]]))
            sizes = np.diff(np.append(head, len(lead)))
            low, high = np.minimum.reduceat(doc[order], head), np.maximum.reduceat(doc[order], head)
            parted = np.zeros(len(head), bool)
            for k in {0, len(head) - 1}:
                word = lead[head[k]].tobytes()
                parted[k] = any(s[:LEAD] == word and s[LEAD:] != bytes(9) for s in splitters[max(0, bucket - 1) : bucket + 1])
            keep = np.repeat((low < high) | parted, sizes)
            rows = order[keep]
            right, left, doc, row, at, before, count = (x[rows] for x in (right, left, doc, row, at, before, count))
            before, count, shared = before.astype(np.int64), count.astype(np.int64), np.repeat(parted, sizes)[keep]
            removed, open_rows, open_key = [], [], []
            for o, again, firsts in repeated_windows(right, left, doc, before, count, window, shared):
                removed.append((doc[again], row[again], at[again] - o))
                if len(firsts):
                    strings = np.concatenate([left[firsts, :o][:, ::-1], right[firsts, : window - o]], axis=1)
                    open_key += [sha256(s.tobytes()).digest()[:DIGEST] for s in strings]
                    open_rows.append((doc[firsts], row[firsts], at[firsts] - o))
            gone += removed
            if open_key:
                d, w, p = (np.concatenate(x) for x in zip(*open_rows))
                digest = np.frombuffer(b"".join(open_key), "<i8").reshape(-1, 2)
                open_windows.append(np.stack([digest[:, 0], digest[:, 1], d, w, p]))
            size += sum(len(x[0]) for x in removed) + len(open_key)
            if size > HELD_WINDOWS:
                yield from _flushed(gone, open_windows, parts)
                gone, open_windows, size = [], [], 0
        yield from _flushed(gone, open_windows, parts)

    return run


def _flushed(gone: list, open_windows: list, parts: int):
    if gone:
        yield from _by_group(*(np.concatenate(x) for x in zip(*gone)), parts)
    if open_windows:
        found = np.concatenate(open_windows, axis=1)
        yield from _blocks_of(np.mod(found[0], parts), found, True)


def _blocks_of(part: np.ndarray, columns: np.ndarray, undecided: bool):
    """One packed block of the columns per part."""
    order = np.argsort(part, kind="stable")
    ids, starts = np.unique(part[order], return_index=True)
    blocks = [zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(columns[:, order[a:z]]).tobytes()) for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(order)])]
    sizes = np.diff(np.append(starts, len(order)))
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), undecided)), pa.array(ids, pa.int32()), pa.array(sizes, pa.int64()), pa.array(blocks, pa.binary())], names=["undecided", *NAMES])


def _columns(block: bytes, n: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.int64).reshape(-1, n)


def _compare_across(parts: int):
    """Windows that the buckets left undecided, all with one remainder of their digests: those with a smaller doc_id elsewhere go."""

    def run(table):
        a, b, doc, row, at = np.concatenate([_columns(x, n) for n, x in zip(table.column("n").to_pylist(), table.column("block").to_pylist())], axis=1)
        order = np.lexsort((doc, b, a))
        a, b, doc, row, at = (x[order] for x in (a, b, doc, row, at))
        head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        late = doc > np.repeat(doc[head], np.diff(np.append(head, len(doc))))
        batches = [x.select(NAMES) for x in _by_group(doc[late], row[late], at[late], parts)]
        return pa.Table.from_batches(batches, BLOCK_SCHEMA)

    return run


NAMES = ["part", "n", "block"]
BLOCK = "part int, n long, block binary"
BLOCK_SCHEMA = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("block", pa.binary())])


def _part(doc: np.ndarray, row: np.ndarray, parts: int) -> np.ndarray:
    x = _mix(doc.view(np.uint64) + row.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x % np.uint64(parts)).astype(np.int64)


def _text_blocks(parts: int):
    """Packs a task's texts per group of documents: their ids and row keys, whether the id is null, ends and bytes."""

    def flush(held):
        docs, keys, sizes, bodies = (np.concatenate([x[k] for x in held]) for k in range(4))
        part, ends = _part(docs, keys, parts), np.cumsum(sizes)
        order = np.argsort(part, kind="stable")
        ids, starts = np.unique(part[order], return_index=True)
        blocks, counts = [], []
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
            i = order[a:z]
            body = bodies[joined_ranges((ends - sizes)[i], sizes[i])]
            blocks.append(zstandard.ZstdCompressor(level=3).compress(np.concatenate([docs[i], keys[i], sizes[i]]).tobytes() + body.tobytes()))
            counts.append(z - a)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(counts, pa.int64()), pa.array(blocks, pa.binary())], names=NAMES)

    def run(batches):
        held, size = [], 0
        for data, cuts, docs, keys in _documents(batches):
            held.append((docs, keys, np.diff(cuts), data))
            size += len(data)
            if size > HELD_TEXT:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def _texts_of(block: bytes, n: int):
    """(doc id with LAST for null, row key, text) of a block."""
    data = zstandard.ZstdDecompressor().decompress(block)
    docs, keys, sizes = np.frombuffer(data, np.int64, 3 * n).reshape(3, n).tolist()
    at = 24 * n
    for doc, row, size in zip(docs, keys, sizes):
        yield doc, row, data[at : at + size]
        at += size


def _by_group(doc: np.ndarray, row: np.ndarray, at: np.ndarray, parts: int):
    """Window starts as runs (doc, row, first, last), packed per group of documents."""
    if not len(doc):
        return
    order = np.lexsort((at, row, doc))
    doc, row, at = doc[order], row[order], at[order]
    head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (at[1:] > at[:-1] + 1)]))
    last = at[np.append(head[1:], len(at)) - 1]
    doc, row, at = doc[head], row[head], at[head]
    yield from _blocks_of(_part(doc, row, parts), np.stack([doc, row, at, last]), False)


def _result(text: bytes, first: np.ndarray, last: np.ndarray, window: int) -> tuple[int, int, int, str, bytes]:
    """(bytes, bytes removed, runs removed, digest of the rest, rest) for windows that start in [first, last]."""
    if not len(first):
        return len(text), 0, 0, sha256(text).hexdigest(), text
    step = np.zeros(len(text) + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, last + window, -1)
    gone = np.cumsum(step[:-1]) > 0
    edges = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
    rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return len(text), int(gone.sum()), int((edges == 1).sum()), sha256(rest).hexdigest(), rest


def _apply(window: int, with_text: bool):
    def run(left, right):
        removed: dict[tuple[int, int], list] = {}
        for n, block in zip(right.column("n").to_pylist(), right.column("block").to_pylist()):
            data = _columns(block, n)
            cuts = np.flatnonzero((np.diff(data[0]) != 0) | (np.diff(data[1]) != 0)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), n]):
                removed.setdefault((int(data[0, a]), int(data[1, a])), []).append(data[2:, a:z])
        rows = []
        for m, block in zip(left.column("n").to_pylist(), left.column("block").to_pylist()):
            for doc, row, text in _texts_of(block, m):
                found = removed.get((doc, row))
                spans = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
                got = _result(text, spans[0], spans[1], window)
                rows.append((None if doc == LAST else doc, *got[:4], *([got[4].decode(errors="replace")] if with_text else [])))
        kinds = [pa.int64()] * 4 + [pa.string()] * (1 + with_text)
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: 5 + with_text]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=names)

    return run


def remove_repeats(docs: DataFrame, window: int = 50, buckets: int | None = None, with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept_text if asked for (bytes that no longer
    form UTF-8 become U+FFFD there)."""
    spark = docs.sparkSession
    rows = texts(docs)
    per_id = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    shared_id, total = per_id.agg(F.coalesce(F.max("n") > 1, F.lit(False)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    rows = rows.withColumn("row", F.xxhash64("text") if shared_id else F.lit(0).cast("long"))  # tells rows of one doc_id apart
    n = shuffle_partitions(spark)
    buckets, parts = buckets or max(4 * n, -(-total // BUCKET_BYTES)), max(4 * n, -(-total // PART_BYTES)) + 1
    splitters = sample_splitters(rows, total, buckets, window)
    blocks = rows.mapInArrow(_blocks(splitters, window), "bucket int, n long, block binary")
    sorted_blocks = blocks.repartitionById(n, F.col("bucket") % n).sortWithinPartitions("bucket")
    compared = materialize(sorted_blocks.mapInArrow(_compare(splitters, window, parts), f"undecided boolean, {BLOCK}"), "repeats")
    across = compared.filter("undecided").select(NAMES).groupBy("part").applyInArrow(_compare_across(parts), BLOCK)
    runs = compared.filter("not undecided").select(NAMES).unionAll(across)
    placed = rows.mapInArrow(_text_blocks(parts), BLOCK)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return placed.groupBy("part").cogroup(runs.groupBy("part")).applyInArrow(_apply(window, with_text), schema)
