"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once for a worker.

A byte-level BPE with the usual pattern never joins a non-space character to a space that follows it, so a text may be cut before each
such space, and around a line feed that stands alone between non-spaces. Pieces repeat, so their ids are kept: pieces are found, hashed
(two 64-bit values) and looked up for a whole chunk of documents at once, and only new ones go to the library. A text with a string that
the tokenizer treats as a special token is encoded whole. The ids are those of the whole text in every case.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from gristmill.llm.common import U64, Text, chunks, word_hash

#: Pieces that a worker keeps before it starts anew, and slots of its table: these bound its memory (about 70 MB).
KEPT, SLOTS = 1_200_000, 1 << 22
#: Pieces that go to the library in one call, whose result is much larger than the ids.
AT_ONCE = 10_000

_GAP = np.zeros(256, bool)
_GAP[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: First bytes of the longer white-space characters (U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000) and of others.
_LONG = np.zeros(256, bool)
_LONG[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def pieces(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the pieces of all documents, in order; none crosses a document."""
    data, n = text.data, len(text.data)
    gap = np.ones(n + 2, bool)
    np.take(_GAP, data, out=gap[1:-1])
    starts = np.zeros(n + 1, bool)
    starts[text.offsets[:-1][text.offsets[:-1] < n]] = True

    def solid_before(i: np.ndarray) -> np.ndarray:
        """Whether the character that ends before ``i`` is no white space."""
        one, two, three = data[i - 1], data[np.maximum(i - 2, 0)], data[np.maximum(i - 3, 0)]
        long = ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | (np.isin(three, (0xE1, 0xE2, 0xE3)) & np.isin(two, (0x80, 0x81, 0x9A)))
        return ~gap[i] & ~long

    space = np.flatnonzero(data == 0x20)
    space = space[(space > 0) & ~starts[space]]
    starts[space[solid_before(space)]] = True
    feed = np.flatnonzero(data == 0x0A)
    feed = feed[(feed > 0) & (feed < n - 1)]
    feed = feed[~starts[feed] & ~starts[feed + 1] & ~gap[feed + 2] & ~_LONG[data[np.minimum(feed + 1, n - 1)]]]
    feed = feed[solid_before(feed)]
    starts[feed] = True
    starts[feed + 1] = True
    start = np.flatnonzero(starts[:n])
    return start, np.r_[start[1:], n] if len(start) else start


def ragged(offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices ``offset[0] .. offset[0]+length[0]-1, offset[1] ..``."""
    total = np.cumsum(length)
    return np.repeat(offset - (total - length), length) + np.arange(total[-1] if len(total) else 0)


class Encoder:
    """Encodes texts as ``tokenizer.encode(text, add_special_tokens=False).ids`` does, for a byte-level BPE."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = np.zeros(self.size, bool)
        for token, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.spaced[k] = token[:1] == "Ġ"  # how byte-level vocabularies write a space
        self._clear()

    def _clear(self) -> None:
        self.slots = np.full(SLOTS, -1, np.int32)
        self.n = self.used = 0
        self.first, self.second = np.zeros(1 << 16, U64), np.zeros(1 << 16, U64)
        self.offset, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, self.dtype)

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        if n <= len(array):
            return array
        out = np.zeros(max(n, len(array) * 3 // 2), array.dtype)
        out[: len(array)] = array
        return out

    def _find(self, first: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        out = np.full(len(first), -1, np.int32)
        todo, slot = np.arange(len(first)), (first & U64(SLOTS - 1)).astype(np.int64)
        while len(todo):
            entry = self.slots[slot]
            hit = (entry >= 0) & (self.first[entry] == first[todo])
            out[todo[hit]] = entry[hit]
            go = ~hit & (entry >= 0)
            todo, slot = todo[go], (slot[go] + 1) & (SLOTS - 1)
        return out

    def _add(self, first: np.ndarray, second: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """New entries, whose ids follow each other in ``ids``."""
        n, m = self.n + len(first), self.used + len(ids)
        for name, size in (("first", n), ("second", n), ("offset", n), ("length", n), ("ids", m)):
            setattr(self, name, self._room(getattr(self, name), size))
        self.first[self.n : n], self.second[self.n : n], self.length[self.n : n] = first, second, length
        self.offset[self.n : n] = self.used + np.cumsum(length) - length
        self.ids[self.used : m] = ids
        entry, slot = np.arange(self.n, n, dtype=np.int32), (first & U64(SLOTS - 1)).astype(np.int64)
        while len(entry):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entry[free]  # of several that want a slot one gets it
            go = self.slots[slot] != entry
            entry, slot = entry[go], (slot[go] + 1) & (SLOTS - 1)
        self.n, self.used = n, m

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for k in range(0, len(texts), AT_ONCE) for x in self.tokenizer.encode_batch_fast(texts[k : k + AT_ONCE], add_special_tokens=False)]

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        """Encodes pieces: those of a space and a word in one call, as each then begins with the only space; the others one by one."""
        odd = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_GAP[data] | _LONG[data], out=odd[1:])
        plain = (data[start] == 0x20) & (odd[end] - odd[start] == 1) & (end - start > 1)
        some = np.flatnonzero(plain)
        for k in range(0, len(some), AT_ONCE):
            part = some[k : k + AT_ONCE]
            joined = data[ragged(start[part], end[part] - start[part])].tobytes().decode("utf-8", "surrogatepass")
            ids = np.array(self._encode([joined])[0], self.dtype)
            opens = np.flatnonzero(self.spaced[ids])
            if len(opens) != len(part):
                raise ValueError("the tokenizer is not a byte-level BPE with the usual pattern")
            self._add(first[part], second[part], ids, np.diff(np.r_[opens, len(ids)]))
        rest = ~plain
        if rest.any():
            found = self._encode([data[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(start[rest].tolist(), end[rest].tolist(), strict=True)])
            self._add(first[rest], second[rest], np.array([i for x in found for i in x], self.dtype), np.array(list(map(len, found)), np.int64))

    def chunk(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a chunk, one after the other, and how many each has."""
        start, end = pieces(text)
        first, second = (word_hash(text.data, start, end, seed) for seed in range(2))
        entry = self._find(first)
        if (new := np.flatnonzero(entry < 0)).size:
            if self.n + len(new) > KEPT:
                self._clear()
                new = np.arange(len(first))
            _, where = np.unique(first[new], return_index=True)
            where = new[where]
            self._learn(text.data, start[where], end[where], first[where], second[where])
            entry[new] = self._find(first[new])
        wrong = self.second[entry] != second  # two pieces of one hash
        length = self.length[entry].astype(np.int64)
        ids = self.ids[ragged(self.offset[entry], length)]
        bounds = np.searchsorted(start, text.offsets)
        total = np.r_[0, np.cumsum(length)]
        counts = np.diff(total[bounds])
        whole = set(np.searchsorted(text.offsets, start[wrong], side="right") - 1)
        raw = text.data.tobytes()
        for special in self.special:
            at = raw.find(special)
            while at >= 0:
                whole.add(int(np.searchsorted(text.offsets, at, side="right") - 1))
                at = raw.find(special, at + 1)
        if whole:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k in whole:
                parts[k] = np.array(self._encode([raw[text.offsets[k] : text.offsets[k + 1]].decode("utf-8", "surrogatepass")])[0], self.dtype)
            ids, counts = np.concatenate(parts), np.array(list(map(len, parts)))
        return ids, counts

    def column(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each chunk of a text column its first row, its ids and how many each row has."""
        for text in chunks(column):
            yield text.first, *self.chunk(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder, kept between tasks."""
    return Encoder(path)
