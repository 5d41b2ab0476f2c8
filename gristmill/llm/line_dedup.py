"""Line dedup by an exact set-similarity join: a line goes if an earlier one's set of words is similar enough.

A line is what line feeds part, its words are ``[^\\x20\\x09-\\x0D]+``, unchanged, and it stands for the set of them. Lines are in order
of document id, line number and contents. A line is removed if the Jaccard similarity of its set to that of any earlier line, removed or
not, is ``similarity`` or more (a tie with it counts). Lines without words stay. Null texts have no lines; a row without an id keeps all its
lines and removes none; rows that repeat an id take turns by line number, and equal rows are treated alike; an empty table gives no rows.
Texts and lines are read whole, however long. Other columns are not read by ``line_links`` and kept by ``remove_lines``, whatever their names.

The join orders words by rarity (counts of all words, in a sketch of fixed size; ties by hash, so the order is total) and

1. deals each distinct set by the words of its prefix, which any similar set's prefix must meet; equal sets are one, their later lines go;
2. under each word pairs the sets if lengths, positions of the word and 64-bit parities leave similarity possible, and verifies the Jaccard
   similarity of the pairs on the sets themselves;
3. under a word that gives more than ``FEW`` pairs a set (a group of near copies) or has more than ``LARGE`` sets, takes the sets instead and
   compares them in blocks of bounded size: a block returns the links of each set by number, its earliest similar set and a spanning
   forest, but no pairs. A pair counts at the first such word that the two share.

So every link is found and counted, while rows are in proportion to the lines, also for a group of near copies that has a third of them;
only the comparisons within blocks are as many as pairs under a word. Words of very many lines go to the blocks at once, without passing
through one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import U64, Text, Workspace, chunks, fresh, id_and_text, mix, named, partitions, settle, table, word_hash
from gristmill.llm.components import components

SKETCH_BITS, BLOOM_BITS = 22, 26
#: Pairs for each set and sets that a word may have for its pairs to be written; lines that have a word from which it goes to the blocks at once.
FEW, LARGE, MANY = 16, 1 << 13, 1 << 20
#: Pairs that are filtered at a time.
AT_ONCE = 1 << 16
#: Words of the sets of a block; a block is compared with itself and with each other one of its word.
BLOCK_WORDS = 1 << 17
#: Lines of a chunk from which their numbers don't fit into a sort key beside 40 bits of the word.
KEYED = 1 << 24

#: Sets of more words than this have their 64 parities twice, each for half of their words.
SPLIT = 72


class Lines:
    """Lines with words of a chunk: document, number, set size ``n``, set hash ``h``, parities, and words in order from ``offset`` on."""

    def __init__(self, text: Text, rank: np.ndarray | None):
        start, end, first = text.words()
        words = word_hash(text.data, start, end)
        feeds = np.flatnonzero(text.data == 0x0A)
        doc = np.repeat(np.arange(len(text)), np.diff(first))
        number = np.searchsorted(feeds, start) - np.searchsorted(feeds, text.offsets[:-1])[doc]
        opens = np.r_[True, (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])] if len(doc) else np.zeros(0, bool)
        line = np.cumsum(opens) - 1
        weight = rank[(words >> U64(64 - SKETCH_BITS)).astype(np.int64)].astype(U64) if rank is not None else U64(0)
        if len(begin := np.flatnonzero(opens)) < KEYED:
            key = (line.astype(U64) << U64(40)) | (weight << U64(32)) | (words >> U64(32))
            order = np.argsort(key)
            key, words, line = key[order], words[order], line[order]
            while (swap := np.flatnonzero((key[1:] == key[:-1]) & (words[1:] < words[:-1]))).size:  # ties of the sorted bits
                swap = swap[np.r_[True, np.diff(swap) > 1]]
                words[swap], words[swap + 1] = words[swap + 1], words[swap].copy()
        else:  # one document of very many lines
            order = np.lexsort((words, np.broadcast_to(weight, words.shape), line))
            words, line = words[order], line[order]
        keep = np.r_[True, (line[1:] != line[:-1]) | (words[1:] != words[:-1])] if len(line) else np.zeros(0, bool)
        self.words, line = words[keep], line[keep]
        self.doc, self.number = doc[begin], number[begin]
        self.n = np.bincount(line, minlength=len(begin)).astype(np.int64)
        self.offset = np.cumsum(self.n) - self.n
        if len(begin):
            mixed = mix(self.words ^ U64(0x5DEECE66D))
            self.h = mix(np.add.reduceat(mixed, self.offset) + self.n.astype(U64))
            bit = U64(1) << (mixed & U64(63))
            other = (mixed & U64(64) != 0) & (self.n > SPLIT)[line]
            self.parity = np.bitwise_xor.reduceat(np.where(other, U64(0), bit), self.offset)
            self.parity2 = np.bitwise_xor.reduceat(np.where(other, bit, U64(0)), self.offset)
        else:
            self.h = self.parity = self.parity2 = np.zeros(0, U64)


def least_overlap(total: np.ndarray, t: Fraction) -> np.ndarray:
    """Words that sets of ``total`` words together must share."""
    return -(-t.numerator * total // (t.numerator + t.denominator))


#: Arrays that are added up in one group.
FAN = 16


def _fold(dtype: str, last):
    """Adds up counts or joins bits of a few arrays; ``last`` makes what the driver gets of the only one."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        total, expand = None, zstandard.ZstdDecompressor()
        for body in group.column("body").to_pylist():
            values = np.frombuffer(expand.decompress(body), dtype)
            total = values.copy() if total is None else total | values if dtype == "uint8" else np.minimum(total.astype(np.int64) + values, np.iinfo(np.int32).max).astype(np.int32)
        return pa.table({"body": pa.array([zstandard.ZstdCompressor(1).compress((last(total) if key[1].as_py() else total).tobytes())], pa.binary())})

    return run


def _gather(rows: DataFrame, dtype: str, ws: Workspace, name: str, last=lambda x: x) -> np.ndarray | None:
    """Adds up arrays of a fixed size, a row from each task, in a tree on the executors; the driver gets one array."""
    rows, level = ws.write(rows.select("body"), f"{name}0", narrow=True), 0
    n = rows.count()
    while n:
        parts = -(-n // FAN)
        folded = rows.withColumns({"part": F.pmod(F.xxhash64("body"), F.lit(parts)), "only": F.lit(parts == 1)}).groupBy("part", "only").applyInArrow(_fold(dtype, last), "body binary")
        level += 1
        rows = ws.write(folded, f"{name}{level}", narrow=True)
        ws.drop(f"{name}{level - 1}")
        n = rows.count() if parts > 1 else 0
    found = rows.collect() if level else []
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(found[0]["body"]), np.uint8) if found else None


LINE = pa.schema([("h", pa.int64()), ("n", pa.int32()), ("doc_id", pa.int64()), ("line", pa.int32()), ("body", pa.binary())])
LINE_DDL = "h long, n int, doc_id long, line int, body binary"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line with words; the task's last row has, instead, in how many lines the words of each bucket are."""
    counts = np.zeros(1 << SKETCH_BITS, np.int32)
    for batch in batches:
        for text in chunks(batch.column(1)):
            x = Lines(text, None)
            np.add.at(counts, (x.words >> U64(64 - SKETCH_BITS)).astype(np.int64), np.int32(1))
            yield table(LINE, x.h.view(np.int64), x.n.astype(np.int32), batch.column(0).take(pa.array(x.doc + text.first)), x.number.astype(np.int32), pa.nulls(len(x.n), pa.binary()))
    settle()
    yield table(LINE, [None], [None], [None], [None], [zstandard.ZstdCompressor(1).compress(counts.tobytes())])


def _commonness(counts: np.ndarray) -> np.ndarray:
    """How common the words of each bucket are, in 256 steps of their logarithm."""
    return np.minimum(255, np.round(6 * np.log2(counts + 1.0))).astype(np.uint8)


def rarity(sketches: DataFrame, ws: Workspace) -> np.ndarray:
    """For each bucket of words how common they are; 4 MB for any corpus."""
    found = _gather(sketches, "int32", ws, "counts", _commonness)
    return np.zeros(1 << SKETCH_BITS, np.uint8) if found is None else found


#: Postings that a task packs at a time.
PACKED = 200_000
#: A posting: word, set, its parities and size, the word's place in it, and the set's first line.
POSTING = [("word", "<u8"), ("h", "<u8"), ("parity", "<u8"), ("parity2", "<u8"), ("n", "<u4"), ("at", "<u4"), ("doc", "<i8"), ("line", "<i4")]


def _postings(rank, slots: int, t: Fraction):
    """Prefix words of each distinct set of a chunk, packed by slot. Those of very common words go to as many slots more, by set."""
    schema = pa.schema([("slot", pa.int32()), ("body", pa.binary())])
    common = int(round(6 * np.log2(MANY + 1.0)))

    def packed(found: list[tuple]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        slot = ((columns[0] >> U64(40)) % U64(slots)).astype(np.int32)
        many = rank.value[(columns[0] >> U64(64 - SKETCH_BITS)).astype(np.int64)] >= common
        slot[many] = slots + (columns[1][many] % U64(slots)).astype(np.int32)
        order = np.argsort(slot, kind="stable")
        columns = [c[order].astype(d) for c, (_, d) in zip(columns, POSTING, strict=True)]
        cuts = np.searchsorted(slot[order], np.arange(2 * slots + 1))
        some = np.flatnonzero(cuts[1:] > cuts[:-1])
        press = zstandard.ZstdCompressor(1)
        bodies = [press.compress(b"".join(c[cuts[s] : cuts[s + 1]].tobytes() for c in columns)) for s in some]
        return table(schema, some.astype(np.int32), pa.array(bodies, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for text in chunks(batch.column(1)):
                x = Lines(text, rank.value)
                doc = ids[x.doc + text.first]
                order = np.lexsort((x.number, doc, x.h))
                own = order[np.r_[True, x.h[order][1:] != x.h[order][:-1]]] if len(order) else order  # the first line of each set
                long = x.n[own] - -(-t.numerator * x.n[own] // t.denominator) + 1
                line = np.repeat(own, long)
                at = np.arange(len(line)) - np.repeat(np.cumsum(long) - long, long)
                found.append((x.words[x.offset[line] + at], x.h[line], x.parity[line], x.parity2[line], x.n[line], at, doc[line], x.number[line]))
                if sum(len(f[0]) for f in found) > PACKED:
                    yield packed(found)
                    found = []
        if found:
            yield packed(found)
        found = []
        settle()

    return run


#: A pair of sets, the earlier as x; or, without x, a set under a word (``key``) that goes to the blocks.
PAIR = pa.schema([("y", pa.int64()), ("ny", pa.int32()), ("y_doc", pa.int64()), ("y_line", pa.int32()), ("x", pa.int64()), ("nx", pa.int32()), ("x_doc", pa.int64()), ("x_line", pa.int32()), ("key", pa.int64())])
PAIR_DDL = "y long, ny int, y_doc long, y_line int, x long, nx int, x_doc long, x_line int, key long"


def _candidates(t: Fraction, slots: int):
    """Pairs of sets under each word of a slot, and the sets of words that have too many."""
    width = sum(np.dtype(d).itemsize for _, d in POSTING)

    def run(slot: tuple, group: pa.Table) -> pa.Table:
        parts: list[list[np.ndarray]] = [[] for _ in POSTING]
        for body in group.column("body").to_pylist():
            raw = zstandard.ZstdDecompressor().decompress(body)
            n, at = len(raw) // width, 0
            for part, (_, d) in zip(parts, POSTING, strict=True):
                part.append(np.frombuffer(raw, d, n, at))
                at += n * np.dtype(d).itemsize
        word, h, parity, parity2, n, at, doc, line = (np.concatenate(p) for p in parts)
        few = slot[0].as_py() < slots
        if few:
            order = np.argsort(word)
            alone = word[order]
            alone = np.r_[True, alone[1:] != alone[:-1]] & np.r_[alone[1:] != alone[:-1], True]
            word, h, parity, parity2, n, at, doc, line = (c[order[~alone]] for c in (word, h, parity, parity2, n, at, doc, line))  # words of one set pair nothing
        if not len(word):
            return PAIR.empty_table()
        order = np.lexsort((h, line, doc, word))
        word, h, parity, parity2, n, at, doc, line = (c[order] for c in (word, h, parity, parity2, n.astype(np.int64), at.astype(np.int64), doc, line))
        again = np.lexsort((h, word))  # keeps the order of equals, so the first of each is the set's first line
        index = again[np.r_[True, (word[again][1:] != word[again][:-1]) | (h[again][1:] != h[again][:-1])]]
        index.sort()
        word, h, parity, parity2, n, at, doc, line = (c[index] for c in (word, h, parity, parity2, n, at, doc, line))
        opens = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        size = np.diff(np.r_[opens, len(word)])
        start = np.repeat(opens, size)
        own = np.repeat(np.arange(len(opens)), size)
        hot, made = (size > LARGE) | (not few), np.zeros(len(opens), np.int64)
        todo = np.flatnonzero(~hot[own] & (np.arange(len(word)) > start))
        xs, ys, step = [], [], 0
        while len(todo):
            steps = max(1, AT_ONCE // len(todo))
            x = (start[todo][:, None] + np.arange(step, step + steps)).ravel()  # the step-th sets under the word
            y = np.repeat(todo, steps)
            live = x < y
            x, y = x[live], y[live]
            total = n[x] + n[y]
            need = least_overlap(total, t)
            some = np.minimum(n[x] - at[x], n[y] - at[y]) >= need
            x, y, free = x[some], y[some], (total - 2 * need)[some]
            one, two = parity[x] ^ parity[y], parity2[x] ^ parity2[y]
            alike = (n[x] > SPLIT) == (n[y] > SPLIT)  # else the two halves of one together are as the other's parities
            apart = np.where(alike, np.bitwise_count(one).astype(np.int64) + np.bitwise_count(two), np.bitwise_count(one ^ two))
            fits = apart <= free
            xs.append(x[fits])
            ys.append(y[fits])
            made += np.bincount(own[y[fits]], minlength=len(made))
            step += steps
            todo = todo[start[todo] + step < todo]
            if (made > FEW * size).any():
                hot |= made > FEW * size
                todo = todo[~hot[own[todo]]]
                made[hot] = 0
        x, y = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (xs, ys))
        x, y = x[~hot[own[y]]], y[~hot[own[y]]]
        hot = np.flatnonzero(hot[own])
        own, none = np.r_[y, hot], np.r_[np.zeros(len(y), bool), np.ones(len(hot), bool)]
        other = np.r_[x, hot]
        columns = [h[own].view(np.int64), n[own].astype(np.int32), doc[own], line[own].astype(np.int32)]
        columns += [pa.array(c, f.type, mask=none) for c, f in zip((h[other].view(np.int64), n[other].astype(np.int32), doc[other], line[other].astype(np.int32)), list(PAIR)[4:8], strict=True)]
        return pa.table([*(pa.array(c, f.type) for c, f in zip(columns[:4], PAIR, strict=False)), *columns[4:], pa.array(word[own].view(np.int64), mask=~none)], schema=PAIR)

    return run


#: Words whose parities a set has in the second round of filters.
PARITIES = 8
SETS_DDL = "h long, n int, " + ", ".join(f"p{k} long" for k in range(PARITIES)) + ", words array<bigint>"
SETS = pa.schema([("h", pa.int64()), ("n", pa.int32()), *((f"p{k}", pa.int64()) for k in range(PARITIES)), ("words", pa.list_(pa.int64()))])


def _bloom_slots(key: np.ndarray) -> list[np.ndarray]:
    return [(mix(key + U64(k)) >> U64(64 - BLOOM_BITS)).astype(np.int64) for k in range(3)]


def _document_key(doc: np.ndarray) -> np.ndarray:
    return doc.astype(np.int64).view(U64) * U64(0xC2B2AE3D27D4EB4F) + U64(1)


def _in_bloom(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    return np.all([(bits[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 for s in _bloom_slots(key)], axis=0)


def _bloom(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wanted sets (h) and the documents that have them."""
    bits = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
    for batch in batches:
        h, doc = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        for slot in _bloom_slots(h.view(U64)) + _bloom_slots(_document_key(doc)):
            np.bitwise_or.at(bits, slot >> 3, np.uint8(128) >> (slot & 7).astype(np.uint8))
    yield pa.record_batch({"body": pa.array([zstandard.ZstdCompressor(1).compress(bits.tobytes())], pa.binary())})


def _sets(bloom):
    """The sets that may be wanted, each once for a chunk, of documents that may have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bloom.value
        for batch in batches:
            batch = batch.filter(pa.array(_in_bloom(bits, _document_key(batch.column(0).to_numpy(zero_copy_only=False)))))
            for text in chunks(batch.column(1)):
                x = Lines(text, None)
                _, own = np.unique(x.h, return_index=True)
                own = own[_in_bloom(bits, x.h[own])]
                each = np.repeat(x.offset[own], x.n[own]) + np.arange(x.n[own].sum()) - np.repeat(np.cumsum(x.n[own]) - x.n[own], x.n[own])
                n, some = x.n[own], x.words[each]
                start = np.cumsum(n) - n
                place = mix(some ^ U64(0x9E3779B97F4A7C15))
                bit = U64(1) << (place & U64(63))
                part = (place >> U64(6)) & U64(PARITIES - 1)
                parities = [np.bitwise_xor.reduceat(np.where(part == U64(k), bit, U64(0)), start) if len(own) else np.zeros(0, U64) for k in range(PARITIES)]
                words = pa.ListArray.from_arrays(pa.array(np.r_[start, n.sum()].astype(np.int32)), pa.array(some.view(np.int64)))
                yield table(SETS, x.h[own].view(np.int64), n.astype(np.int32), *(p.view(np.int64) for p in parities), words)

    return run


LINKED = pa.schema([("h", pa.int64()), ("n", pa.int32()), ("doc", pa.int64()), ("line", pa.int32()), ("links", pa.int64()), ("x_doc", pa.int64()), ("x_line", pa.int32()), ("similarity", pa.float64()), ("root", pa.int64())])
LINKED_DDL = "h long, n int, doc long, line int, links long, x_doc long, x_line int, similarity double, root long"


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _compared(t: Fraction):
    """Compares the sets of two blocks of a word, or of one with itself.

    For each set with a link here: how many it has that count here, its earliest similar set and the similarity, and the set that stands
    for it in a spanning forest.
    """

    def run(key: tuple, group: pa.Table) -> pa.Table:
        word, low, high = (k.as_py() for k in key)
        h, n, doc, line, part = (group.column(c).to_numpy() for c in ("y", "ny", "y_doc", "y_line", "part"))
        order = np.lexsort((h, line, doc))
        group = group.take(pa.array(order))
        h, n, doc, line, part = (c[order] for c in (h, n.astype(np.int64), doc, line, part))
        words, long = _lists(group.column("words"))
        place = mix(words.view(U64) ^ U64(0x9E3779B97F4A7C15))
        local = np.unique(words, return_inverse=True)[1]
        start = np.cumsum(long) - long
        parity = np.bitwise_xor.reduceat(U64(1) << (place & U64(63)), start)
        keys, many = _lists(group.column("keys"))  # words that go to the blocks; those before this one may have counted a pair already
        first = np.cumsum(many) - many
        before = np.unique(np.where(keys < word, keys, word), return_inverse=True)[1]
        before = np.where(keys < word, before, -1)
        has, seen = np.zeros(local.max(initial=0) + 1, np.int64), np.zeros(before.max(initial=0) + 1, bool)
        links, near, likeness, label = np.zeros(len(h), np.int64), np.full(len(h), -1), np.zeros(len(h)), np.arange(len(h))
        for y in range(1, len(h)):
            total = n[:y] + n[y]
            need = least_overlap(total, t)
            able = (np.minimum(n[:y], n[y]) >= need) & (np.bitwise_count(parity[:y] ^ parity[y]) <= total - 2 * need)
            if low != high:
                able &= part[:y] != part[y]
            x = np.flatnonzero(able)
            if not len(x):
                continue
            own = local[start[y] : start[y] + long[y]]
            has[own] = 1
            at = np.repeat(start[x] - (np.cumsum(long[x]) - long[x]), long[x]) + np.arange(long[x].sum())
            common = np.add.reduceat(has[local[at]], np.cumsum(long[x]) - long[x])
            has[own] = 0
            similar = common >= need[x]
            x, common = x[similar], common[similar]
            if not len(x):
                continue
            near[y], likeness[y] = x[0], common[0] / (n[x[0]] + n[y] - common[0])
            mine = before[first[y] : first[y] + many[y]]
            mine = mine[mine >= 0]
            fresh_ = x
            if len(mine):
                seen[mine] = True
                at = np.repeat(first[x] - (np.cumsum(many[x]) - many[x]), many[x]) + np.arange(many[x].sum())
                fresh_ = x[np.add.reduceat((seen[before[at]] & (before[at] >= 0)).astype(np.int64), np.cumsum(many[x]) - many[x]) == 0]
                seen[mine] = False
            links[y] += len(fresh_)
            links[fresh_] += 1
            met = np.unique(label[x])
            if len(met) > 1 or met[0] != label[y]:
                label[np.isin(label, np.r_[met, label[y]])] = min(met[0], label[y])
        some = np.flatnonzero((links > 0) | (near >= 0) | (label != np.arange(len(h))))
        none = near[some] < 0
        at = np.maximum(near[some], 0)
        earliest = [pa.array(c, k, mask=none) for c, k in ((doc[at], pa.int64()), (line[at].astype(np.int32), pa.int32()), (likeness[some], pa.float64()))]
        return pa.table([pa.array(h[some]), pa.array(n[some].astype(np.int32)), pa.array(doc[some]), pa.array(line[some].astype(np.int32)), pa.array(links[some]), *earliest, pa.array(h[label[some]])], schema=LINKED)

    return run


def _linked(rows: DataFrame, found: DataFrame, t: Fraction, ws: Workspace) -> DataFrame:
    """Of each distinct set with a link, in several rows: number of links, earliest similar set before it, and sets that are linked to it (``root``)."""
    spark = rows.sparkSession
    pairs, hot = found.where("key is null").drop("key"), found.where("key is not null").select("key", "y", "ny", "y_doc", "y_line")
    sizes = hot.groupBy("key").agg(F.count("*").alias("c"), F.sum("ny").alias("w")).where("c > 1")
    sizes = ws.write(sizes.select("key", F.ceil(F.col("w") / BLOCK_WORDS).cast("int").alias("blocks")), "sizes", narrow=True)
    hot = ws.write(hot.join(sizes, "key"), "hot")
    keys = ws.write(hot.groupBy(F.col("y").alias("h"), F.col("ny").alias("n")).agg(F.collect_set("key").alias("keys")), "keys", narrow=True)  # of a set's prefix
    side = lambda df, of: df.select(F.col(of).alias("h"), F.col(f"{of}_doc").alias("doc"))
    wanted = ws.write(side(pairs, "y").unionByName(side(pairs, "x")).unionByName(side(hot, "y")).distinct(), "wanted", narrow=True)
    bits = _gather(wanted.mapInArrow(_bloom, "body binary"), "uint8", ws, "bloom")
    bloom = spark.sparkContext.broadcast(bits if bits is not None else np.zeros(1 << (BLOOM_BITS - 3), np.uint8))  # 8 MB; it only spares rows
    sets = rows.mapInArrow(_sets(bloom), SETS_DDL).dropDuplicates(["h", "n"]).join(wanted.select("h").distinct(), "h", "left_semi")
    sets = ws.write(sets.join(keys, ["h", "n"], "left"), "sets")
    ws.drop("wanted")
    parities = [f"p{k}" for k in range(PARITIES)]
    view = lambda of, columns: sets.select(F.col("h").alias(of), F.col("n").alias(f"n{of}"), *(F.col(c).alias(f"{of}_{c}") for c in columns))
    both = lambda df, columns: df.join(view("y", columns).hint("merge"), ["y", "ny"]).join(view("x", columns).hint("merge"), ["x", "nx"])
    apart = sum((F.bit_count(F.col(f"y_{c}").bitwiseXOR(F.col(f"x_{c}"))) for c in parities[1:]), F.bit_count(F.col(f"y_{parities[0]}").bitwiseXOR(F.col(f"x_{parities[0]}"))))
    total = F.col("ny") + F.col("nx")
    need = F.ceil(total * t.numerator / F.lit(float(t.numerator + t.denominator)) - 1e-9)
    close = both(pairs, [*parities, "keys"]).where((apart <= total - 2 * need) & ~F.coalesce(F.arrays_overlap("y_keys", "x_keys"), F.lit(False)))
    close = ws.write(close.select(*pairs.columns), "close", narrow=True)
    held = both(close, ["words"]).withColumn("common", F.size(F.array_intersect("y_words", "x_words")))
    held = held.where(F.col("common") * t.denominator >= (total - F.col("common")) * t.numerator).withColumn("similarity", F.col("common") / (total - F.col("common")))
    held = ws.write(held.select(*pairs.columns, "similarity"), "held", narrow=True)
    ws.drop("close")
    one = F.lit(1).cast("long").alias("links")
    later = held.select(F.col("y").alias("h"), F.col("ny").alias("n"), F.col("y_doc").alias("doc"), F.col("y_line").alias("line"), one, "x_doc", "x_line", "similarity", F.col("x").alias("root"))
    earlier = held.select(F.col("x").alias("h"), F.col("nx").alias("n"), F.col("x_doc").alias("doc"), F.col("x_line").alias("line"), one, *(F.lit(None).cast(d).alias(c) for c, d in (("x_doc", "long"), ("x_line", "int"), ("similarity", "double"))), F.col("x").alias("root"))
    own = F.pmod(F.xxhash64("y"), F.col("blocks")).cast("int")
    dealt = hot.join(sets.select(F.col("h").alias("y"), F.col("n").alias("ny"), "words", "keys").hint("merge"), ["y", "ny"]).withColumn("part", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    blocks = dealt.select("key", "low", "high", "part", "y", "ny", "y_doc", "y_line", "words", "keys").groupBy("key", "low", "high").applyInArrow(_compared(t), LINKED_DDL)
    out = later.unionByName(earlier).unionByName(ws.write(blocks, "blocks"))
    ws.drop("hot", "keys")
    return out


def _prepared(docs: DataFrame, similarity: float, id_col: str, text_col: str, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Lines, and what is known of each set with links, in several rows."""
    spark = docs.sparkSession
    t = Fraction(str(similarity))
    rows = id_and_text(docs, id_col, text_col).where("doc_id is not null")
    lines = ws.write(rows.mapInArrow(_lines, LINE_DDL), "lines")
    rank = spark.sparkContext.broadcast(rarity(lines.where("body is not null"), ws))  # 4 MB
    slots = 4 * partitions(spark)
    found = rows.mapInArrow(_postings(rank, slots, t), "slot int, body binary").groupBy("slot").applyInArrow(_candidates(t, slots), PAIR_DDL).distinct()
    return lines.where("body is null").drop("body"), _linked(rows, ws.write(found, "found"), t, ws)


def _sums(linked: DataFrame) -> DataFrame:
    """Of each set with links its first line, how many it has, and the earliest line before that which is similar."""
    near = F.min(F.when(F.col("x_doc").isNotNull(), F.struct("x_doc", "x_line", "similarity"))).alias("near")
    return linked.groupBy("h", "n").agg(F.min(F.struct("doc", "line")).alias("own"), F.sum("links").alias("links"), near)


def _known(lines: DataFrame, sums: DataFrame) -> DataFrame:
    """Of each distinct set its first line, and what ``sums`` has."""
    first = lines.groupBy("h", "n").agg(F.min(F.struct("doc_id", "line")).alias("first"))
    return first.join(sums.hint("merge"), ["h", "n"], "left")


def _of(lines: DataFrame, known: DataFrame) -> DataFrame:
    """Lines with whether they go, and the earliest line that they resemble. Both sides are written tables, so that a line which a third of
    all are is split among tasks."""
    joined = lines.join(known.hint("merge"), ["h", "n"])  # both sides grow with the corpus
    equal, near = F.struct("doc_id", "line") > F.col("first"), F.col("near").isNotNull()  # not its set's first line
    nearer = near & ~(equal & (F.col("first") < F.struct("near.x_doc", "near.x_line")))
    pick = lambda a, b: F.when(equal | near, F.when(nearer, a).otherwise(b))
    kept = {"kept_doc_id": pick(F.col("near.x_doc"), F.col("first.doc_id")), "kept_line": pick(F.col("near.x_line"), F.col("first.line")), "similarity": pick(F.round("near.similarity", 6), F.lit(1.0))}
    return joined.withColumns({**kept, "removed": equal | near})


def similar_lines(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", ws: Workspace | None = None) -> DataFrame:
    """A row for each line that goes: (doc_id, line, kept_doc_id, kept_line, similarity, h), with the earliest line that it resembles.

    ``h`` is the hash of its set.
    """
    ws = ws or Workspace(docs.sparkSession, "line-dedup")
    lines, linked = _prepared(docs, similarity, id_col, text_col, ws)
    known = ws.write(_known(lines, ws.write(_sums(linked), "sums", narrow=True)), "known")
    return _of(lines, known).where("removed").select("doc_id", "line", "kept_doc_id", "kept_line", "similarity", "h").distinct()


def line_links(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The whole join, a row for each line with words: (doc_id, line, class_doc_id, class_line, n_links, removed, kept_doc_id, kept_line, similarity).

    The class is what links connect, by its first line; ``n_links`` is how many other sets are similar to the line's (equal lines are one
    set, so they share it and don't count); a removed line has the earliest line that it resembles. Equal rows have a row each.
    """
    ws = Workspace(docs.sparkSession, "line-links")
    lines, linked = _prepared(docs, similarity, id_col, text_col, ws)
    sums = ws.write(_sums(linked), "sums", narrow=True)
    roots = ws.write(components(linked.select(F.col("h").alias("u"), F.col("root").alias("v")), ws), "roots", narrow=True)
    classes = roots.join(sums.select(F.col("h").alias("node"), "own"), "node").groupBy("root").agg(F.min("own").alias("class"))
    classes = roots.join(ws.write(classes, "classes", narrow=True), "root").select(F.col("node").alias("h"), "class")
    known = ws.write(_known(lines, ws.write(sums.join(classes, "h"), "complete", narrow=True)), "known")
    return _of(lines, known).select("doc_id", "line", F.coalesce("class.doc", "first.doc_id").alias("class_doc_id"), F.coalesce("class.line", "first.line").alias("class_line"), F.coalesce("links", F.lit(0)).alias("n_links"), "removed", "kept_doc_id", "kept_line", "similarity")


def _rewrite(where: int, spans: int, drop_empty: bool, schema_width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
            out, keep = [], []
            gone_column = batch.column(spans)
            column = batch.column(where)
            for k in range(batch.num_rows):
                text, gone = column[k].as_py(), gone_column[k].as_py()
                if not gone or text is None:
                    out.append(text)
                    keep.append(True)
                    continue
                marks = {(g["line"], g["h"]) for g in gone}
                parts = text.split("\n")
                raw = text.encode("utf-8", "surrogatepass")
                x = Lines(Text(0, np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), None)
                hit = {int(a) for a, b in zip(x.number.tolist(), x.h.view(np.int64).tolist(), strict=True) if (a, b) in marks}
                left = [p for a, p in enumerate(parts) if a not in hit]
                out.append("\n".join(left))
                keep.append(not (drop_empty and hit and not any(p.strip() for p in left)))
            columns = [pa.array(out, batch.schema.field(where).type) if c == where else batch.column(c) for c in range(schema_width)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:schema_width]).filter(pa.array(keep, pa.bool_()))

    return run


def remove_lines(docs: DataFrame, similarity: float = 0.8, drop_empty: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the later lines, all columns kept; a document that loses all its lines with words goes (``drop_empty``)."""
    ws = Workspace(docs.sparkSession, "line-dedup")
    gone = similar_lines(docs, similarity, id_col, text_col, ws).groupBy("doc_id").agg(F.collect_list(F.struct("line", "h")).alias("gone"))  # a document's lines
    key, spans = fresh(docs, "gone_id"), fresh(docs, "gone_lines")
    gone = ws.write(gone.select(F.col("doc_id").alias(key), F.col("gone").alias(spans)), "gone", narrow=True)
    joined = docs.join(gone, named(id_col).cast("long") == F.col(key), "left").drop(key)
    where = [c.lower() for c in docs.columns].index(text_col.lower())
    return ws.write(joined.mapInArrow(_rewrite(where, len(docs.columns), drop_empty, len(docs.columns)), docs.schema), "rewritten")
