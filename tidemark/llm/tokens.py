"""Encoding whole texts with the tokenizers library, each distinct word once.

The tokenizers here cut a text at white space before anything else, so a text's ids are its words' ids in a row. Arrow splits the
texts of a task and finds their distinct words; words that this worker hasn't met go to the library, many in one string with a
special token between them; numpy puts the ids together. A text that has no safe cut at some space is encoded as a whole.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import joined_ranges, release

#: Words that a worker holds with their ids, some 30 MB, and how many of the first met, the common ones, it keeps beyond that.
HELD_WORDS, KEPT_WORDS = 700_000, 300_000
IN_ONE_STRING = 100
#: Bytes of text that are split and looked up at a time.
RUN_BYTES = 6 << 20
SEPARATOR = "<|endoftext|>"


class WordEncoder:
    """spaced: words take the one space before them along (byte-level BPE); else white space is dropped."""

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer

        self.plain, self.parting, self.spaced = Tokenizer.from_file(path), Tokenizer.from_file(path), spaced
        self.plain.encode_special_tokens, self.parting.encode_special_tokens = True, False
        self.separator = self.parting.token_to_id(SEPARATOR)
        for t in (self.plain, self.parting):
            t.no_padding()
            t.no_truncation()
        self.words = pa.array([], pa.string())
        self.ids, self.sizes, self.unsafe = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)

    def _library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and how many each has."""
        found = [np.array(e.ids, np.int32) for e in self.plain.encode_batch_fast(words, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.int32), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def _parted(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _library, for words without the separator's characters."""
        strings = [SEPARATOR.join(words[i : i + IN_ONE_STRING]) + SEPARATOR for i in range(0, len(words), IN_ONE_STRING)]
        runs = (self.parting.encode_batch_fast(strings[i : i + 256], add_special_tokens=False) for i in range(0, len(strings), 256))
        found = np.concatenate([np.zeros(0, np.int32), *(np.array(e.ids, np.int32) for run in runs for e in run)])
        ends = np.flatnonzero(found == self.separator)
        return found[found != self.separator], np.diff(ends, prepend=-1) - 1

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Adds words; returns in which order."""
        words = new.to_pylist()
        has = np.array(["<|" in w for w in words], bool)
        order = np.argsort(has, kind="stable")
        plain, odd = ([words[i] for i in np.flatnonzero(has == x)] for x in (False, True))
        lead = " " if self.spaced else ""
        ids, sizes = zip(self._parted([lead + w for w in plain]), self._library([lead + w for w in odd]))
        self.words = pa.concat_arrays([self.words, pa.array(plain, pa.string()), pa.array(odd, pa.string())])
        self.ids, self.sizes = np.concatenate([self.ids, *ids]), np.concatenate([self.sizes, *sizes])
        self.unsafe = np.concatenate([self.unsafe, np.array([not w or w[0].isspace() for w in plain + odd], bool)])
        return order

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text's followed by end, and the number of ids of each text."""
        if len(self.words) > HELD_WORDS:
            self.words, self.sizes, self.unsafe = pa.concat_arrays([self.words.slice(0, KEPT_WORDS)]), self.sizes[:KEPT_WORDS].copy(), self.unsafe[:KEPT_WORDS].copy()
            self.ids = self.ids[: self.sizes.sum()].copy()
        split = pc.split_pattern(texts, " ") if self.spaced else pc.ascii_split_whitespace(texts)
        flat = split.flatten().dictionary_encode()
        per_text = pc.list_value_length(split).to_numpy().astype(np.int64)
        place = pc.index_in(flat.dictionary, value_set=self.words)
        if place.null_count:
            new, before = place.is_null().to_numpy(zero_copy_only=False), len(self.words)
            order = self._learn(flat.dictionary.filter(place.is_null()))
            place = place.fill_null(0).to_numpy().astype(np.int64)
            place[np.flatnonzero(new)[order]] = before + np.arange(len(order))
        else:
            place = place.to_numpy().astype(np.int64)
        code = place[flat.indices.to_numpy()]
        ids, sizes = self.ids, self.sizes
        row = np.repeat(np.arange(len(per_text)), per_text)
        if self.spaced:
            first = np.cumsum(per_text) - per_text
            unsafe = self.unsafe[code]
            unsafe[first] = False
            whole = np.zeros(len(per_text), bool)
            whole[row[unsafe]] = True
            firsts = self._library([x if not w else "" for x, w in zip(flat.dictionary.take(flat.indices.take(pa.array(first))).to_pylist(), whole)])
            wholes = self._library([t for t, w in zip(texts.to_pylist(), whole) if w] if whole.any() else [])
            code[first] = len(sizes) + np.arange(len(first))
            if whole.any():
                keep = ~whole[row]
                row, code = np.append(row[keep], np.flatnonzero(whole)), np.append(code[keep], len(sizes) + len(first) + np.arange(int(whole.sum())))
                order = np.argsort(row, kind="stable")
                row, code = row[order], code[order]
            ids, sizes = np.concatenate([ids, firsts[0], wholes[0]]), np.concatenate([sizes, firsts[1], wholes[1]])
        per_word = sizes[code]
        body = ids[joined_ranges((np.cumsum(sizes) - sizes)[code], per_word)]
        counts = np.bincount(row, per_word, len(per_text)).astype(np.int64)
        release()
        return np.insert(body, np.cumsum(counts), end).astype(np.int32), counts + 1


@lru_cache(2)
def encoder(path: str, spaced: bool) -> WordEncoder:
    """One for a worker process, so that tasks share what it has met."""
    return WordEncoder(path, spaced)
