"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids are linked.

Neither tokenizer joins a word with the space after it, so a text is cut before its words and each distinct unit of a worker is aligned
once. The units of a run lie one behind the other on one axis of bytes: union1d of the two arrays of token ends gives the elementary
intervals, searchsorted their owners, so each interval is one overlap of an A and a B token; where both end, a group closes. A group's
tokens are all linked, which expands to the product of its two sides.

Counts of id pairs cover all documents. A task describes a run of documents (a slice) by its distinct units and pairs, in a table in the
shared folder; only the distinct pairs of a slice travel to be counted and back, never those of a document, so a frequent pair gives one
row per slice. The slices then take up what came back. Ids of an A have their highest count in a table bounded by the vocabulary.

Defined results: null, empty and unfaithful texts (those whose tokens' bytes aren't the text's, as with U+2581) have no tokens; null and
repeated doc_ids and repeated rows are documents of their own; ties for the highest count are all best; an empty table gives an empty
one; whole texts of any length are aligned, with memory in proportion to one text and the distinct pairs of one group; only doc_id and
text are read, so further columns of any name don't matter. A vocabulary whose pieces run across a word's end raises ValueError.
"""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import sha256
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_ranges, materialize, release, slices, texts
from .tokens import WordEncoder

MARK = "▁"
#: Spaces before which nothing but a word ends: both tokenizers begin a new token there.
CUT = re.compile(r"(?<=[^ ]) (?=\S)")
#: Units and links that a worker holds, and how many units of the first met it keeps beyond that.
HELD_UNITS, HELD_LINKS, KEPT_UNITS = 120_000, 2_000_000, 60_000
#: Bytes of text in a slice, units that are aligned and documents' unit occurrences that are looked at together.
SLICE_BYTES, LEARNT, OCCURRENCES = 2 << 20, 10_000, 100_000
#: Links of groups that are expanded at a time; a group with more is expanded by its distinct ids.
EXPANDED = 1 << 16


def byte_level() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; for millions of integers a sort is faster than numpy's hash table."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, A tokens, B tokens) of each group, the tokens as numbers of those up to the group's end. Both arrays rise to the same last end."""
    ends = np.union1d(ends_a, ends_b)
    own_a, own_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    closes = (ends_a[own_a] == ends) & (ends_b[own_b] == ends) if len(ends) else np.zeros(0, bool)
    return ends[closes], own_a[closes] + 1, own_b[closes] + 1


def linked(a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id pair as A << 32 | B, how often) of the products of all groups; a pair may come more than once."""
    n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
    size = n_a * n_b
    out = []
    for g in np.flatnonzero(size > EXPANDED):
        (x, m), (y, n) = (np.unique(i[to - k : to], return_counts=True) for i, to, k in ((a, to_a[g], n_a[g]), (b, to_b[g], n_b[g])))
        out.append((np.full(len(x) * len(y), g), (x.astype(np.int64)[:, None] << 32 | y).ravel(), np.outer(m, n).ravel()))
    at = np.flatnonzero(size <= EXPANDED)
    group, place = np.repeat(at, size[at]), joined_ranges(np.zeros(len(at), np.int64), size[at])
    x, y = (to_a - n_a)[group] + place // np.maximum(n_b, 1)[group], (to_b - n_b)[group] + place % np.maximum(n_b, 1)[group]
    out.append((group, a[x].astype(np.int64) << 32 | b[y], np.ones(len(group), np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out))


class Aligner:
    """Aligns units, and holds what it has aligned: in rows of one number per unit, and flat arrays of ids, group ends and links."""

    def __init__(self, byte_path: str, piece_path: str):
        from sentencepiece import SentencePieceProcessor

        self.a = WordEncoder(byte_path, True)
        self.b = SentencePieceProcessor(model_file=piece_path)
        alphabet = byte_level()
        self.bytes_a = [b""] * self.a.plain.get_vocab_size()
        for token, i in self.a.plain.get_vocab(with_added_tokens=False).items():
            self.bytes_a[i] = bytes(map(alphabet.__getitem__, token)) if all(c in alphabet for c in token) else b""
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError(f"{piece_path}: has pieces that run across the end of a word")
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)
        ]
        self.len_a, self.len_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.code: dict[str, int] = {}
        self.text: list[bytes] = []
        #: Per unit: A tokens, B tokens, groups, links, distinct links; -1 A tokens if unfaithful.
        self.sizes = np.zeros((0, 5), np.int64)
        #: Ids of A and of B; the ends of groups in A and in B tokens of the unit; distinct links and how often each.
        self.flat = [np.zeros(0, t) for t in (np.int32, np.int32, np.int32, np.int32, np.int64, np.int32)]

    #: Which column of sizes says how much of each flat array is a unit's.
    OF = (0, 1, 2, 2, 4, 4)

    def _encode_a(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = np.array(["<|" in u for u in units], bool)
        ids, sizes = zip(*(f([" " + units[i] for i in np.flatnonzero(odd == o)]) for f, o in ((self.a._parted, False), (self.a._library, True))))
        at, sizes, ids = np.argsort(odd, kind="stable"), np.concatenate(sizes), np.concatenate(ids)
        back = np.argsort(at)
        return ids[joined_ranges((np.cumsum(sizes) - sizes)[back], sizes[back])], sizes[back]

    def _encode_b(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.b.encode(units, num_threads=1)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.int32, int(sizes.sum())), sizes

    def _faithful(self, units: list[str], *sides) -> np.ndarray:
        raw = [b" " + u.encode() for u in units]
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        good = np.ones(len(units), bool)
        for ids, sizes, tokens, length in sides:
            ends = np.concatenate([[0], np.cumsum(length[ids])])[np.cumsum(sizes)]
            same = np.diff(ends, prepend=0) == n
            got = b"".join(map(tokens.__getitem__, ids.tolist()))
            if not same.all() or got != b"".join(raw):
                starts = ends - np.diff(ends, prepend=0)
                same = np.array([got[i:j] == r for i, j, r in zip(starts.tolist(), ends.tolist(), raw)], bool)
            good &= same
        return good

    def learn(self, units: list[str]) -> None:
        """Aligns units that aren't held yet."""
        (a, n_a), (b, n_b) = self._encode_a(units), self._encode_b(units)
        good = self._faithful(units, (a, n_a, self.bytes_a, self.len_a), (b, n_b, self.bytes_b, self.len_b))
        a, b = (ids[np.repeat(good, n)] for ids, n in ((a, n_a), (b, n_b)))
        n_a, n_b = n_a * good, n_b * good
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        end, to_a, to_b = groups_of(ends_a, ends_b)
        unit_ends = np.concatenate([[0], ends_a])[np.cumsum(n_a)]
        of = np.flatnonzero(good)[np.searchsorted(unit_ends[good], end)] if len(end) else np.zeros(0, np.int64)
        group, pair, times = linked(a, b, to_a, to_b)
        found, place = np.unique(pair, return_inverse=True)
        key, at = np.unique(of[group] * max(len(found), 1) + place, return_inverse=True)
        often = np.zeros(len(key), np.int64)
        np.add.at(often, at, times)
        of_link = key // max(len(found), 1)
        sa, sb = list(map(str, a.tolist())), list(map(str, b.tolist()))
        ta, tb = [0, *to_a.tolist()], [0, *to_b.tolist()]
        said = [f"{sa[i] if j - i == 1 else ','.join(sa[i:j])}|{sb[k] if m - k == 1 else ','.join(sb[k:m])}" for i, j, k, m in zip(ta, ta[1:], tb, tb[1:])]
        n_groups = np.bincount(of, minlength=len(units))
        cuts = [0, *np.cumsum(n_groups).tolist()]
        self.code.update(zip(units, range(len(self.code), len(self.code) + len(units))))
        self.text += [";".join(said[i:j]).encode() for i, j in zip(cuts, cuts[1:])]
        n_links = np.zeros(len(units), np.int64)
        np.add.at(n_links, of, np.diff(to_a, prepend=0) * np.diff(to_b, prepend=0))
        new = np.stack([np.where(good, n_a, -1), n_b, n_groups, n_links, np.bincount(of_link, minlength=len(units))], 1)
        self.sizes = np.concatenate([self.sizes, new])
        base_a, base_b = (np.cumsum(n) - n for n in (n_a, n_b))
        for i, x in enumerate((a, b, to_a - base_a[of], to_b - base_b[of], found[key % max(len(found), 1)], often)):
            self.flat[i] = np.concatenate([self.flat[i], x.astype(self.flat[i].dtype)])

    def _trim(self) -> None:
        if len(self.code) > HELD_UNITS or len(self.flat[4]) > HELD_LINKS:
            kept = min(KEPT_UNITS, int(np.searchsorted(np.cumsum(self.sizes[:, 4]), HELD_LINKS // 2)))
            self.code = dict(list(self.code.items())[:kept])
            self.text, self.sizes = self.text[:kept], self.sizes[:kept].copy()
            self.flat = [x[: np.maximum(self.sizes[:, c], 0).sum()].copy() for x, c in zip(self.flat, self.OF)]

    def units(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all units in a row, and how many each text has; a text with an unfaithful unit has none."""
        self._trim()
        split = pc.split_pattern(found, " ")
        flat, counts = split.flatten().dictionary_encode(), pc.list_value_length(split).to_numpy().astype(np.int64)
        words = flat.dictionary.to_pylist()
        odd = np.array([not w or w[0].isspace() for w in words], bool)
        row, at = np.repeat(np.arange(len(counts)), counts), flat.indices.to_numpy()
        apart = np.zeros(len(counts), bool)
        apart[row[odd[at]]] = True
        whole = {int(i): CUT.split(t) if t else [] for i, t in zip(np.flatnonzero(apart), found.filter(pa.array(apart)).to_pylist())}
        more = [u for us in whole.values() for u in us]
        used = np.zeros(len(words), bool)
        used[at[~apart[row]]] = True
        if new := list(dict.fromkeys(u for u in (*compress(words, used.tolist()), *more) if u not in self.code)):
            for i in range(0, len(new), LEARNT):
                self.learn(new[i : i + LEARNT])
        code = np.fromiter((self.code.get(w, -1) for w in words), np.int64, len(words))[at]
        if whole:
            keep = ~apart[row]
            row = np.concatenate([row[keep], np.repeat(np.fromiter(whole, np.int64), [len(us) for us in whole.values()])])
            code = np.concatenate([code[keep], np.fromiter(map(self.code.__getitem__, more), np.int64, len(more))])
            order = np.argsort(row, kind="stable")
            row, code = row[order], code[order]
        bad = np.zeros(len(counts), bool)
        bad[row[self.sizes[code, 0] < 0]] = True
        code, row = code[~bad[row]], row[~bad[row]]
        return code, np.bincount(row, minlength=len(counts))

    def take(self, i: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What flat array i has of the units, in a row, and how much each has."""
        n = np.maximum(self.sizes[:, self.OF[i]], 0)
        return self.flat[i][joined_ranges((np.cumsum(n) - n)[code], n[code])], n[code]


@lru_cache(2)
def aligner_of(byte_path: str, piece_path: str) -> Aligner:
    """One for a worker process, so that tasks share what it has aligned."""
    return Aligner(byte_path, piece_path)


def _summed(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over runs of so many values."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.cumsum(counts)], prepend=0)


def _lists(values: np.ndarray, counts: np.ndarray, kind=None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind or pa.int32()))


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 to 2**32 - 1, byte by byte, compressed."""
    return len(x).to_bytes(8, "little") + pa.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], 4 * n, codec="zstd"), np.uint8).reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64)


def align(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """doc_id, a and b (ids of both tokenizers), a_ends and b_ends (of each group, in tokens of the text)."""

    def run(batches):
        aligner = aligner_of(byte_path, piece_path)
        for part in slices(batches, "text", SLICE_BYTES // 4):
            code, counts = aligner.units(part.column("text"))
            doc = np.repeat(np.arange(len(counts)), counts)
            columns = []
            for ids, ends in ((0, 2), (1, 3)):
                found, n = aligner.take(ids, code)
                to, k = aligner.take(ends, code)
                per = np.bincount(doc, n, len(counts)).astype(np.int64)
                before = np.cumsum(n) - n - (np.cumsum(per) - per)[doc]
                columns += [_lists(found, per), _lists(to + np.repeat(before, k), np.bincount(doc, k, len(counts)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), columns[0], columns[2], columns[1], columns[3]], names=["doc_id", "a", "b", "a_ends", "b_ends"])

    return texts(docs).mapInArrow(run, "doc_id long, a array<int>, b array<int>, a_ends array<int>, b_ends array<int>")


#: Small row groups, so that writers hold little.
WRITER = {"parquet.block.size": str(16 << 20)}
SLICED = (
    "slice long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_units int,"
    " units binary, unit_links binary, link binary, often binary, a array<int>, b array<int>, docs array<int>"
)


def _joined(batches, size: int):
    """Runs of about so many bytes of text, however small the batches are."""
    held, n = [], 0
    for part in slices(batches, "text", size):
        held.append(part)
        n += part.nbytes
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _document_counts(doc: np.ndarray, unit: np.ndarray, n_units: int, n_link: np.ndarray, link: np.ndarray, n_pairs: int) -> np.ndarray:
    """In how many documents each link is. Occurrences of units come document by document, and whole documents are looked at together."""
    out, start, first = np.zeros(n_pairs, np.int64), 0, np.cumsum(n_link) - n_link
    while start < len(doc):
        last = doc[min(start + OCCURRENCES, len(doc)) - 1]
        stop = int(np.searchsorted(doc, last, "right"))
        there = distinct((doc[start:stop] - doc[start]) * n_units + unit[start:stop])
        d, u = there // n_units, there % n_units
        seen = distinct(np.repeat(d, n_link[u]) * n_pairs + link[joined_ranges(first[u], n_link[u])])
        out += np.bincount(seen % n_pairs, minlength=n_pairs)
        start = stop
    return out


def _sliced(docs: DataFrame, byte_path: str, piece_path: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """A row per document; the first of a slice also has the units of all its documents, packed, its distinct units (how many links each has,
    which and how often) and its distinct links (ids, and in how many of its documents)."""

    def run(batches):
        aligner, number = aligner_of(byte_path, piece_path), TaskContext.get().partitionId() << 32
        for table in _joined(batches, slice_bytes):
            code, counts = aligner.units(table.column("text").combine_chunks())
            doc = np.repeat(np.arange(len(counts)), counts)
            cuts = [0, *np.cumsum(counts).tolist()]
            text, used = aligner.text, code.tolist()
            sha = [sha256(b";".join(map(text.__getitem__, used[i:j]))).hexdigest() if i < j else "" for i, j in zip(cuts, cuts[1:])]
            unit, local = np.unique(code, return_inverse=True)
            link, n_link = aligner.take(4, unit)
            often, _ = aligner.take(5, unit)
            pair, link = np.unique(link, return_inverse=True)
            n_docs = _document_counts(doc, local, len(unit), n_link, link, len(pair))
            per_doc = [_summed(aligner.sizes[code, c], counts) for c in range(4)]
            n, rest = len(counts), len(counts) - 1
            columns = [pa.array(np.full(n, number)), pa.array(np.arange(n), pa.int32()), table.column("doc_id").combine_chunks(), *map(pa.array, per_doc), pa.array(sha, pa.string()), pa.array(counts, pa.int32())]
            columns += [pa.array([packed(x)] + [None] * rest, pa.binary()) for x in (local, n_link, link, often)]
            columns += [pa.array([x] + [None] * rest, pa.list_(pa.int32())) for x in (pair >> 32, pair & 0xFFFFFFFF, n_docs)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SLICED.split(", ") if c])
            number += 1
            release()

    return texts(docs).mapInArrow(run, SLICED)


def _links(sliced: DataFrame) -> DataFrame:
    return sliced.filter("a IS NOT NULL").select("slice", F.posexplode(F.arrays_zip("a", "b", "docs"))).select("slice", "pos", "col.a", "col.b", "col.docs")


def _counted(links: DataFrame) -> DataFrame:
    counted = links.groupBy("a", "b").agg(F.sum("docs").alias("n_docs"))
    top = counted.groupBy("a").agg(F.max("n_docs").alias("top"))  # at most a row per id of the vocabulary
    return counted.join(F.broadcast(top), "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("top")).alias("best"))


def link_counts(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(a, b, n_docs, best) of all linked id pairs: how many documents hold them linked, and whether that is the A id's highest count."""
    return _counted(_links(materialize(_sliced(docs, byte_path, piece_path), "aligned", **WRITER)))


def _resolved(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a slice with what has come back for its links."""
    docs = docs.sort_by("place")
    units, n_link, link, often = (unpacked(docs.column(c)[0].as_py()) for c in ("units", "unit_links", "link", "often"))
    n_docs, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
    at = counts.column("pos").to_numpy()
    n_docs[at], best[at] = counts.column("n_docs").to_numpy(), counts.column("best").to_numpy()
    per_doc = docs.column("n_units").to_numpy().astype(np.int64)
    columns = [_summed(_summed(often * x[link], n_link)[units], per_doc) for x in (best, n_docs)]
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    for name, x in zip(("n_best", "count_sum"), columns):
        out = out.append_column(name, pa.array(x, pa.int64()))
    return out.append_column("groups_sha256", docs.column("groups_sha256"))


def link_statistics(docs: DataFrame, byte_path: str, piece_path: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links with their A id's highest count), count_sum (of the links' counts), groups_sha256."""
    sliced = materialize(_sliced(docs, byte_path, piece_path, slice_bytes), "aligned", **WRITER)
    links = _links(sliced)
    back = links.select("slice", "pos", "a", "b").join(_counted(links), ["a", "b"]).select(F.col("slice").alias("of"), "pos", "n_docs", "best")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    parts = sliced.select("slice", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "place", "n_units", "units", "unit_links", "link", "often")
    return parts.groupBy("slice").cogroup(back.groupBy("of")).applyInArrow(_resolved, schema)
