"""SentencePiece encoding and decoding by shared-prefix forward passes.

SentencePiece marks white space and never lets a piece cross from a word into the next mark, so a text is its marked words' pieces
in a row. A task sorts the distinct marked words of a run of documents, which puts them in trie order, and walks them depth
first: the forward states of the prefix that a word shares with its predecessor are kept, and only the rest is computed. For a
unigram model the state is the best score and last piece (Viterbi). For a BPE model the highest-scoring path isn't what the
library gives; there the state is the one last piece that the merge order allows: a piece may follow another just if merging the
two of them together gives these two again. The ids equal the library's for both.

Defined results: a null text counts as empty; an empty text has no ids; a null doc_id and repeated rows pass through row by row, equal
texts with equal ids; very long texts, and texts of one very long word, are encoded whole, with memory in proportion to the word; an
empty table gives an empty one; only doc_id and text are read, so further columns of any name don't matter. Where a text has U+2581
itself, decoding gives a space, as the library does. A model that needs another normaliser, or has pieces of the user's, raises ValueError.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import joined_ranges, slices, texts

MARK = "▁"
MARKED_WORD = re.compile(f"{MARK}+[^{MARK}]*")
#: Words that a worker holds with their ids, and how many of the first met it keeps beyond that.
HELD_WORDS, KEPT_WORDS = 600_000, 200_000
#: Ids that it holds, whatever the length of the words.
HELD_IDS = 8_000_000
RUN_BYTES = 8 << 20
UNIGRAM, BPE = 1, 2


class Model:
    """The pieces of a model file with an identity normaliser and a dummy prefix."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as file:
            found = proto.ModelProto.FromString(file.read())
        kinds = proto.ModelProto.SentencePiece
        self.kind = found.trainer_spec.model_type
        spec = found.normalizer_spec
        plain = spec.add_dummy_prefix and spec.escape_whitespaces and not (spec.remove_extra_whitespaces or spec.precompiled_charsmap or found.trainer_spec.treat_whitespace_as_suffix)
        if self.kind not in (UNIGRAM, BPE) or not plain or any(p.type == kinds.USER_DEFINED for p in found.pieces):
            raise ValueError(f"{path}: only BPE and unigram models with an identity normaliser, a dummy prefix and no pieces of the user's are encoded here")
        normal = [(i, p) for i, p in enumerate(found.pieces) if p.type == kinds.NORMAL]
        self.ids = {p.piece: i for i, p in normal}
        self.scores = {p.piece: p.score for _, p in normal}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(found.pieces) if p.type == kinds.BYTE}
        self.unknown = next(i for i, p in enumerate(found.pieces) if p.type == kinds.UNKNOWN)
        ends: dict[str, set[int]] = {}
        for piece in self.ids:
            ends.setdefault(piece[-2:], set()).add(len(piece))
        #: By their last two characters, the lengths of pieces, longest first, without the single characters.
        self.ends = {k: tuple(sorted((n for n in v if n > 1), reverse=True)) for k, v in ends.items() if len(k) == 2}
        self.sound: dict[str, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.unknown_score = min(self.scores.values(), default=0.0) - 10
        self.text = [self._text(p, kinds) for p in found.pieces]
        self.follows: dict[tuple[str, str], bool] = {}

    @staticmethod
    def _text(p, kinds) -> bytes:
        if p.type == kinds.BYTE:
            return bytes([int(p.piece[3:5], 16)])
        return b"" if p.type == kinds.CONTROL else " ⁇ ".encode() if p.type == kinds.UNKNOWN else p.piece.replace(MARK, " ").encode()

    def merged(self, text: str) -> list[str]:
        """Merges by descending score, leftmost first: the definition of BPE, for strings of two pieces at most."""
        parts = list(text)
        while True:
            best = max(((self.scores[x + y], -i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in self.scores), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def may_follow(self, left: str, right: str) -> bool:
        got = self.follows.get((left, right))
        if got is None:
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            got = self.follows[left, right] = self.is_sound(right) and self.merged(left + right) == ([left, right] if left else [right])
        return got

    def is_sound(self, piece: str) -> bool:
        """Whether merging the piece's characters gives the piece."""
        got = self.sound.get(piece)
        if got is None:
            got = self.sound[piece] = self.merged(piece) == [piece]
        return got

    def encode_sorted(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each of the words, which are sorted: depth first through their trie. The forward state of a prefix is its last
        piece, its score and where that piece starts; the states of the prefix that a word shares with the one before stay. A word's
        ids are made once, by walking back over these starts."""
        step = self._bpe_state if self.kind == BPE else self._unigram_state
        pieces, scores, starts, before, out = [""], [0.0], [0], "", []
        for word in words:
            limit, shared = min(len(before), len(word)), 0
            while shared < limit and before[shared] == word[shared]:
                shared += 1
            del pieces[shared + 1 :], scores[shared + 1 :], starts[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                step(word, end, pieces, scores, starts)
            last, at = [], len(word)
            while at:
                last.append(pieces[at])
                at = starts[at]
            out.append(tuple(i for piece in reversed(last) for i in self.of_piece(piece)))
            before = word
        return out

    def _bpe_state(self, word: str, end: int, pieces: list, scores: list, starts: list) -> None:
        """Of the pieces that end here the one that may follow the last piece before it; a single character if no longer one may."""
        follows = self.follows
        for size in self.ends.get(word[end - 2 : end], ()):
            if (start := end - size) >= 0 and (piece := word[start:end]) in self.scores:
                got = follows.get((pieces[start], piece))
                if got or (got is None and self.may_follow(pieces[start], piece)):
                    break
        else:
            start, piece = end - 1, word[end - 1]
        pieces.append(piece)
        scores.append(0.0)
        starts.append(start)

    def _unigram_state(self, word: str, end: int, pieces: list, scores: list, starts: list) -> None:
        """Viterbi: the piece that ends here with the best total score."""
        best = (-float("inf"), 0, "")
        for size in (*self.ends.get(word[end - 2 : end], ()), 1):
            if (start := end - size) >= 0 and ((piece := word[start:end]) in self.scores or size == 1):
                best = max(best, (scores[start] + self.scores.get(piece, self.unknown_score), start, piece))
        score, start, piece = best
        pieces.append(piece)
        scores.append(score)
        starts.append(start)

    def of_piece(self, piece: str) -> tuple[int, ...]:
        got = self.known.get(piece)
        if got is None:
            i = self.ids.get(piece)
            got = (i,) if i is not None else tuple(self.bytes[b] for b in piece.encode()) if self.bytes else (self.unknown,)
            self.known[piece] = got
        return got

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.text.__getitem__, ids)).removeprefix(b" ")


@lru_cache(2)
def load(path: str) -> Model:
    return Model(path)


class Encoder:
    def __init__(self, model: Model):
        self.model = model
        self.code: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and the number of each text's."""
        if len(self.code) > HELD_WORDS or len(self.ids) > HELD_IDS:
            kept = min(KEPT_WORDS, int(np.searchsorted(np.cumsum(self.sizes), HELD_IDS // 2)))
            self.code, self.sizes = dict(islice(self.code.items(), kept)), self.sizes[:kept].copy()
            self.ids = self.ids[: self.sizes.sum()].copy()
        words = [MARKED_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in found]
        flat = [w for ws in words for w in ws]
        if new := sorted({w for w in flat if w not in self.code}):
            ids = self.model.encode_sorted(new)
            self.code.update(zip(new, range(len(self.code), len(self.code) + len(new))))
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in ids for i in x), np.int32)])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, ids), np.int64, len(ids))])
        at = np.fromiter(map(self.code.__getitem__, flat), np.int64, len(flat))
        per_word = self.sizes[at]
        ids = self.ids[joined_ranges((np.cumsum(self.sizes) - self.sizes)[at], per_word)]
        ends = np.concatenate([[0], np.cumsum(per_word)])[np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]
        return ids, np.diff(ends, prepend=0)


@lru_cache(2)
def encoder_of(path: str) -> Encoder:
    """One for a worker process, so that tasks share the words that it has met."""
    return Encoder(load(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every whole text."""

    def run(batches):
        encoder = encoder_of(path)
        for part in slices(batches, "text", RUN_BYTES):
            ids, counts = encoder.encode(part.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of (doc_id, ids) rows."""

    def run(batches):
        model = load(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [model.decode(x or []).decode(errors="replace") for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_sha256 (of the decoded ids) and round_trip (the decoded text is the text)."""

    def run(batches):
        model = load(path)
        encoder = encoder_of(path)
        for part in slices(batches, "text", RUN_BYTES):
            found = part.column("text").to_pylist()
            ids, counts = encoder.encode(found)
            data, flat = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), ids.tolist()
            ends = np.cumsum(counts).tolist()
            rows = []
            for text, a, b in zip(found, [0, *ends], ends):
                back = model.decode(flat[a:b])
                rows.append((b - a, zlib.crc32(data[4 * a : 4 * b]), sha256(back).hexdigest(), back == text.replace(MARK, " ").encode()))
            n, crc, sha, same = zip(*rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha), pa.array(same)], names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
