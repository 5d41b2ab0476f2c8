"""Benchmark decontamination by spaced seeds: overlaps that tolerate substituted words.

Words are runs of A-Z lower-cased letters, digits and non-ASCII characters. A document holds an item if, at some alignment of the two, a
window of ``min(window, words of the item)`` words agrees in ``similarity`` of its positions or more. Seeds find the alignments: a mask
looks at 4 positions and ignores others, so a substituted word between them does no harm. With these four masks every such window of 5 to
20 words has a seed (a test goes through all patterns), hence nothing is lost; each hit's alignment is verified on the whole item.

Training seeds are joined to the benchmark's by hash: the benchmark comes in blocks of at most ``block_words`` words, each is broadcast as a
sorted table of seeds, joined by binary search, and released before the next, so the documents are never shuffled. Items of equal words are
one. A hit whose two predecessors hit as well has an alignment that is already known and isn't made, and hits and verifications go in parts
of bounded size, so a text of one word again and again costs its alignments and not the product of its seeds with the benchmark's.

Items of fewer than ``least_words`` words (five) say too little and match nothing; null texts have no words; rows that repeat are each
searched, and each names all items, ties included; an item's or a document's id may be null. Without documents or items there are no rows.
A document is searched whole, however long. Other columns are not read by ``find_leaks`` and kept by ``drop_leaks``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import PLAIN, U64, Text, Workspace, chunks, id_and_text, mix, named, settle, table, word_hash

#: Fixed masks: 1 where a seed looks.
MASKS = ("1111", "11011", "10111", "11101")
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
FILTER_BITS = 22


def word_hashes(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all documents, and for each document its first word's index."""
    plain = PLAIN[text.data]
    start, end, first = text.words(plain)
    return word_hash(plain, start, end), first


def seeds(words: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask the positions where it fits into a document, and the hashes of what it sees there."""
    doc_end = np.repeat(first[1:], np.diff(first))
    for number, mask in enumerate(MASKS):
        at = np.flatnonzero(np.arange(len(words)) + len(mask) <= doc_end)
        total = np.full(len(at), number, U64)
        for factor, step in zip(FACTORS, [k for k, c in enumerate(mask) if c == "1"], strict=True):
            total = (total + words[at + step]) * U64(factor)
        yield at, mix(total)


#: Hits, and positions to compare, that are handled at a time; alignments that are verified at a time.
PART, STEP = 1 << 18, 1 << 14
NO_SEED = U64(0)


def _in_parts(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive entries of about ``limit`` in all; a larger entry is a range of its own."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right")))
        yield at, end
        at = end


def _ragged(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries of so many places each the entry's number and 0, 1, 2 .. within it."""
    own = np.repeat(np.arange(len(sizes)), sizes)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _before(at: np.ndarray, hashes: np.ndarray, first: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The hash of the seed one word before each, in the same text; 0 if it has none. ``starts``: the text's first word by position."""
    out = np.full(len(at), NO_SEED, U64)
    if len(at):
        follows = np.r_[False, at[1:] == at[:-1] + 1] & (at > first[starts])
        out[follows] = hashes[np.flatnonzero(follows) - 1]
    return out


class Block:
    """Distinct word sequences of some benchmark items, and their seeds in order of (hash, hash of the seed before)."""

    def __init__(self, ids: list, texts: list[str], least_words: int):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        words, first = word_hashes(Text(0, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])))
        same: dict[bytes, list] = {}
        for k, i in enumerate(ids):
            same.setdefault(words[first[k] : first[k + 1]].tobytes(), []).append(i)
        kept = [(np.frombuffer(w, U64), own) for w, own in same.items() if len(w) >= 8 * least_words]
        self.ids = [own for _, own in kept]  # of each sequence, all items that have it
        self.words = np.concatenate([w for w, _ in kept] or [np.zeros(0, U64)])
        self.first = np.cumsum([0, *(len(w) for w, _ in kept)])
        self.item = np.repeat(np.arange(len(kept)), np.diff(self.first))
        found = []
        for at, hashes in seeds(self.words, self.first):
            found.append((hashes, _before(at, hashes, self.first, self.item[at]), at))
        hashes, before, at = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((before, hashes))
        self.hashes, self.before, self.at = hashes[order], before[order], at[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.hashes >> U64(64 - FILTER_BITS)).astype(np.int64)] = True

    def _within(self, hashes: np.ndarray, before: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of each [low, high), where the hash is the same, that has the seed before too."""
        out = []
        for side in ("left", "right"):
            a, b = low.copy(), high.copy()
            while (go := a < b).any():  # binary search of all ranges side by side
                mid = (a + b) // 2
                value = self.before[np.minimum(mid, len(self.before) - 1)]
                right = go & ((value < before) if side == "left" else (value <= before))
                a, b = np.where(right, mid + 1, a), np.where(go & ~right, mid, b)
            out.append(a)
        return out[0], out[1]

    def alignments(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Distinct (document, sequence, document word that its first word falls on), a part at a time; a later part may repeat some."""
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        span = int(np.diff(first).max(initial=0)) + int(np.diff(self.first).max(initial=0)) + 1
        most = int(np.diff(self.first).max(initial=0))
        for at, hashes in seeds(words, first):
            before = _before(at, hashes, first, doc[at])
            some = np.flatnonzero(self.filter[(hashes >> U64(64 - FILTER_BITS)).astype(np.int64)])
            at, hashes, before = at[some], hashes[some], before[some]
            low = np.searchsorted(self.hashes, hashes, side="left")
            high = np.searchsorted(self.hashes, hashes, side="right")
            hit = np.flatnonzero(high > low)
            at, hashes, before, low, high = at[hit], hashes[hit], before[hit], low[hit], high[hit]
            known_low, known_high = self._within(hashes, before, low, high)
            none = before == NO_SEED  # texts that begin here have nothing before that could be known
            known_low[none], known_high[none] = low[none], low[none]
            # ranges of new hits: before the known ones and after them
            at, start, many = np.r_[at, at], np.r_[low, known_high], np.r_[known_low - low, high - known_high]
            for a, b in _in_parts(many, PART):
                own, step = _ragged(many[a:b])
                hit_at, seed = at[a:b][own], start[a:b][own] + step
                for c in range(0, len(seed), PART):
                    place = self.at[seed[c : c + PART]]
                    word, item = hit_at[c : c + PART], self.item[place]
                    where = word - (place - self.first[item])
                    key = np.unique((doc[word] * max(len(self.ids), 1) + item) * span + (where - first[doc[word]] + most))
                    pair, off = key // span, key % span
                    d = pair // max(len(self.ids), 1)
                    yield d, pair % max(len(self.ids), 1), off - most + first[d]

    def overlaps(self, words: np.ndarray, first: np.ndarray, doc: np.ndarray, item: np.ndarray, at: np.ndarray, window: int, similarity: float) -> np.ndarray:
        """Rows (document, sequence, -matched, size, document word, item word) of the alignments that hold a similar window, the best of each."""
        a, n = self.first[item], self.first[item + 1] - self.first[item]
        size = np.minimum(window, n)
        start, end = np.maximum(0, first[doc] - at), np.minimum(n, first[doc + 1] - at)
        fits = end - start >= size
        doc, item, at, a, size, start, end = (x[fits] for x in (doc, item, at, a, size, start, end))
        out = []
        for x, y in _in_parts(end - start, PART):
            own, step = _ragged((end - start)[x:y])
            place = start[x:y][own] + step
            same = np.zeros(len(own) + 1, np.int64)
            np.cumsum(words[at[x:y][own] + place] == self.words[a[x:y][own] + place], out=same[1:])
            begins = step <= (end - start - size)[x:y][own]  # a window fits here
            index = np.flatnonzero(begins)
            count = same[index + size[x:y][own[index]]] - same[index]
            enough = count >= np.ceil(similarity * size[x:y][own[index]] - 1e-9)
            index, count = index[enough], count[enough]
            k = own[index]
            out.append(np.stack([doc[x:y][k], item[x:y][k], -count, size[x:y][k], at[x:y][k] + place[index] - first[doc[x:y][k]], place[index]], 1))
        return _least(np.concatenate(out) if out else np.zeros((0, 6), np.int64))


def _least(rows: np.ndarray) -> np.ndarray:
    """The least row of each (document, sequence)."""
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)]] if len(rows) else rows


def _blocks(items: DataFrame, id_col: str, text_col: str, block_words: int, least_words: int) -> Iterator[Block]:
    ids: list = []
    texts: list[str] = []
    size = 0
    for row in items.select(named(id_col).cast("long").alias("i"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("t")).orderBy("i", "t").toLocalIterator():
        if texts and size + len(row["t"]) > 6 * block_words:
            yield Block(ids, texts, least_words)
            ids, texts, size = [], [], 0
        ids.append(row["i"])
        texts.append(row["t"])
        size += len(row["t"])
    if texts:
        yield Block(ids, texts, least_words)


def _matches(block: Block, text: Text, window: int, similarity: float) -> np.ndarray:
    """Rows (document, sequence, -matched, size, document word, item word): the best overlap of each pair that has one.

    Alignments are verified from the left. Once all words of a window agree nothing further right is better, so it isn't verified.
    """
    words, first = word_hashes(text)
    best = np.zeros((0, 6), np.int64)
    if not len(block.words):
        return best
    many = len(block.ids)
    for doc, item, at in block.alignments(words, first):
        order = np.argsort(at, kind="stable")
        doc, item, at = doc[order], item[order], at[order]
        for k in range(0, len(at), STEP):
            some = slice(k, k + STEP)
            d, i, w = doc[some], item[some], at[some]
            if len(best):
                where = np.minimum(np.searchsorted(best[:, 0] * many + best[:, 1], d * many + i), len(best) - 1)
                row = best[where]
                hopeless = (row[:, 0] == d) & (row[:, 1] == i) & (row[:, 2] == -row[:, 3]) & (w - first[d] > row[:, 4])
                d, i, w = d[~hopeless], i[~hopeless], w[~hopeless]
            if len(d):
                best = _least(np.concatenate([best, block.overlaps(words, first, d, i, w, window, similarity)]))
    return best


def _proved(window: int, similarity: float, least_words: int) -> None:
    if window > 20 or similarity < 0.8 or least_words < 5:
        raise ValueError("the masks are proved for windows of 5 to 20 words and similarities of 0.8 or more")


FOUND = pa.schema([(n, pa.int64()) for n in ("doc_id", "item_id", "matched_words", "window_words", "doc_word", "item_word")])
FOUND_DDL = ", ".join(f"{f.name} long" for f in FOUND)


def find_leaks(docs: DataFrame, items: DataFrame, window: int = 20, similarity: float = 0.8, least_words: int = 5, block_words: int = 200_000, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and item that it holds, with the best window: words that agree, its length, and where it begins.

    A block's rows are written before the next block is broadcast.
    """
    _proved(window, similarity, least_words)
    spark = docs.sparkSession
    rows, ws = id_and_text(docs, id_col, text_col), Workspace(docs.sparkSession, "decontaminate")

    def search(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for text in chunks(batch.column(1)):
                    found = [(ids[text.first + d], i, -m, *rest) for d, k, m, *rest in _matches(sent.value, text, window, similarity).tolist() for i in sent.value.ids[k]]
                    if found:
                        yield table(FOUND, *map(list, zip(*found, strict=True)))

        return rows.mapInArrow(run, FOUND_DDL)

    found = []
    for k, block in enumerate(_blocks(items, item_id_col, item_text_col, block_words, least_words)):
        sent = spark.sparkContext.broadcast(block)  # at most block_words words, or one item
        found.append(ws.write(search(sent), f"block{k}"))
        sent.unpersist()
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], FOUND_DDL)


def drop_leaks(docs: DataFrame, items: DataFrame, window: int = 20, similarity: float = 0.8, least_words: int = 5, block_words: int = 200_000, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all columns; a row is judged where it is read. What is left of them after each block is written."""
    _proved(window, similarity, least_words)
    ws, out = Workspace(docs.sparkSession, "decontaminate-drop"), docs
    where = [c.lower() for c in docs.columns].index(text_col.lower())
    for k, block in enumerate(_blocks(items, item_id_col, item_text_col, block_words, least_words)):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for text in chunks(batch.column(where)):
                    keep[text.first + np.unique(_matches(sent.value, text, window, similarity)[:, 0])] = False
                yield batch.filter(pa.array(keep))
            settle()

        out = ws.write(out.mapInArrow(run, docs.schema), f"block{k}")
        sent.unpersist()
        if k:
            ws.drop(f"block{k - 1}")
    return out
