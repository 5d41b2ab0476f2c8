"""Spelling variants: words at one inserted, deleted or replaced code point, found by hashed deletions.

A word with one code point left out is the same string for two words that differ in that place, and is a word itself where the other one
lacks it. Its hash is the prefix's plus the shifted suffix's, so all deletions of a batch of words come from one array of running sums.
Keys are dealt to partitions by their leading bits and sorted there; words that meet under a key are compared as strings.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import BASE, BASE_INVERSE, U64, Text, Workspace, chunks, deal, mix, named, partitions, powers, settle, table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Words beyond so many bytes get their checksum from zlib; shorter ones go a byte at a time, all of a chunk at once.
SHORT_BYTES = 48
#: Keys of so many bytes of words are made at a time.
KEY_BYTES = 1 << 20

_LOWER = np.full(256, 0x20, np.uint8)
_LOWER[0x61:0x7B] = _LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, np.uint32(0xEDB88320) ^ (out >> np.uint32(1)), out >> np.uint32(1))
    return out


_CRC = _crc_table()


def _checksums(before: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of each [start, end) of ``data`` after bytes whose crc32 is ``before``."""
    crc, length = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF), end - start
    todo, k = np.flatnonzero(length <= SHORT_BYTES), 0
    todo = todo[length[todo] > 0]
    while len(todo):
        c = crc[todo]
        crc[todo] = _CRC[(c ^ data[start[todo] + k]) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
        k += 1
        todo = todo[length[todo] > k]
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > SHORT_BYTES):
        crc[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(before[i]))
    return crc


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte spans as strings."""
    length = end - start
    ends = np.cumsum(length)
    body = data[np.repeat(start - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]
    offsets = np.concatenate([np.zeros(1, np.int64), ends])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.tobytes()), pa.py_buffer(body.tobytes()))


def _words(text: Text, ids: list, least_length: int, modulus: int) -> pa.Array:
    """The words of a chunk of documents, each as often as it occurs."""
    raw = text.data
    wide = (raw & 0xC0) == 0x80  # second bytes of U+00C0 to U+00FF follow 0xC3, and 0xC3 leads nothing else
    wide[0:1] = False
    wide[1:] &= raw[:-1] == 0xC3
    data = np.where(wide | (raw == 0xC3), raw, _LOWER[raw])
    start, end, first = text.words(data)
    extra = np.concatenate([np.zeros(1, np.int64), np.cumsum(wide)])
    length = end - start - (extra[end] - extra[start])
    long_enough = np.flatnonzero(length >= least_length)
    prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    doc = np.searchsorted(first, long_enough, side="right") - 1
    start, end, length = start[long_enough], end[long_enough], length[long_enough]
    h = _checksums(prefix[doc], data, start, end)
    cut = h % modulus == 0
    out = [_strings(data, start[~cut], end[~cut])]
    edited = []
    for a, b, n, x in zip(start[cut].tolist(), end[cut].tolist(), length[cut].tolist(), h[cut].tolist(), strict=True):
        if n > least_length:
            word = data[a:b].tobytes().decode()
            edited.append(word[: x % n] + word[x % n + 1 :])
    out.append(pa.array(edited, pa.large_string()))
    return pa.concat_arrays(out)


COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _counted(least_length: int, modulus: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for text in chunks(batch.column(1), 4_000_000):
                counts = pc.value_counts(_words(text, ids[text.first : text.first + len(text)], least_length, modulus))
                yield table(COUNTS, counts.field(0).cast(pa.string()), counts.field(1))
        settle()

    return run


def word_counts(docs: DataFrame, least_length: int = 7, modulus: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z lower-cased, with the seeded deletions, by their counts. Counted in each chunk of a task,
    then in each task, and only then shuffled, so that a frequent word is a row of each task."""
    rows = docs.select(named(id_col).cast("string").alias("id"), named(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_counted(least_length, modulus), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


KEYS = pa.schema([("key", pa.int64()), ("place", pa.int32()), ("id", pa.int64())])
#: The place of a row that stands for the word itself.
WHOLE = -1


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of words (ASCII and U+00C0 to U+00FF), and where each word begins."""
    column = column.cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    lead = data == 0xC3
    points = np.where((data & 0xC0) == 0x80, data + np.uint8(0x40), data)[~lead]
    skipped = np.concatenate([np.zeros(1, np.int64), np.cumsum(lead)])
    at = offsets - offsets[0]
    return points, at - skipped[at]


def _deletions(column: pa.Array, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, place, id) of each word and of each of its deletions. ``place`` is twice the position, and one more where the same string
    came from the position before; the key is a hash of the string that is left."""
    points, starts = _points(column)
    n, length = len(points), np.diff(starts)
    own, pos = np.repeat(np.arange(len(length)), length), np.arange(n)
    begin, finish = starts[:-1][own], starts[1:][own]
    total = np.zeros(n + 1, U64)
    np.cumsum((points.astype(U64) + U64(1)) * powers(BASE_INVERSE, n + 1)[:n], out=total[1:])  # negative powers: shifting multiplies
    up = powers(BASE, n + 2)
    left = (total[pos] - total[begin]) * up[begin]
    right = (total[finish] - total[pos + 1]) * up[begin + 1]  # the suffix moves down by one
    same = np.zeros(n, bool)
    same[1:] = (points[1:] == points[:-1]) & (own[1:] == own[:-1])
    size = (length[own] - 1).astype(U64) * U64(0x9E3779B1)
    yield mix(left + right + size), ((pos - begin) * 2 + same).astype(np.int32), ids[own]
    whole = (total[starts[1:]] - total[starts[:-1]]) * up[starts[:-1]]
    yield mix(whole + length.astype(U64) * U64(0x9E3779B1)), np.full(len(length), WHOLE, np.int32), ids


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for text in chunks(batch.column(1), KEY_BYTES):
            some = slice(text.first, text.first + len(text))
            for key, place, own in _deletions(batch.column(1).slice(text.first, len(text)), ids[some]):
                for at in range(0, len(key), 1 << 18):
                    yield table(KEYS, key[at : at + (1 << 18)].view(np.int64), place[at : at + (1 << 18)], own[at : at + (1 << 18)])


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _met(key: np.ndarray, place: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows in order of key and place: a word and what leaves it by a deletion, and words left alike by a deletion at one place."""
    n = len(key)
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    group = np.cumsum(new) - 1
    wholes = np.bincount(group, weights=place == WHOLE, minlength=group[-1] + 1).astype(np.int64)  # 1 at most, but for collisions
    first = np.flatnonzero(new)
    once = (place >= 0) & (place % 2 == 0)
    for k in range(int(wholes.max(initial=0))):
        rows = np.flatnonzero(once & (wholes[group] > k))
        yield ids[first[group[rows]] + k], ids[rows]
    spot = place >> 1
    rows = np.flatnonzero(place[:-1] >= 0)
    step = 1
    while len(rows):
        rows = rows[rows + step < n]
        rows = rows[(key[rows] == key[rows + step]) & (spot[rows] == spot[rows + step])]
        if len(rows):
            yield ids[rows], ids[rows + step]
        step += 1


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and place to pairs. What waits between batches is one key: letters times places of a word at most."""
    waits = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]
    for batch in batches:
        rows = [np.concatenate([w, c.to_numpy(zero_copy_only=False)]) for w, c in zip(waits, batch.columns, strict=True)]
        end = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
        waits = [x[end:] for x in rows]
        if end:
            for a, b in _met(*(x[:end] for x in rows)):
                yield table(PAIRS, a, b)
    if len(waits[0]):
        for a, b in _met(*waits):
            yield table(PAIRS, a, b)


def near_words(words: DataFrame, ws: Workspace) -> DataFrame:
    """(word, n, near, near_n) of each two words of ``words`` (a written table of word, n, id) at one edit, both ways round.

    ``id`` is a hash that need not be unique: pairs are compared as strings after the texts are joined.
    """
    spark = words.sparkSession
    count = partitions(spark)
    keys = words.select("id", "word").mapInArrow(_keys, "key long, place int, id long")
    span = F.floor(F.shiftrightunsigned(F.col("key"), 33) * count / F.lit(1 << 31)).cast("int")  # the leading bits
    pairs = deal(keys.withColumn("span", span), count).select("key", "place", "id").sortWithinPartitions("key", "place").mapInArrow(_meet, "a long, b long")
    left = words.select(F.col("id").alias("a"), F.col("word").alias("word_a"), F.col("n").alias("n_a"))
    right = words.select(F.col("id").alias("b"), F.col("word").alias("word_b"), F.col("n").alias("n_b"))
    met = pairs.join(left, "a").join(right, "b").where(F.levenshtein("word_a", "word_b", 1) == 1)
    sides = F.array(F.struct(F.col("word_a").alias("word"), F.col("n_a").alias("n"), F.col("word_b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("word_b").alias("word"), F.col("n_b").alias("n"), F.col("word_a").alias("near"), F.col("n_a").alias("near_n")))
    return met.select(F.explode(sides).alias("x")).select("x.*")


def _roots(forms: DataFrame, hops: int, ws: Workspace) -> DataFrame:
    """(word, root) of words with a form. A form occurs ``factor`` times as often as its word, so chains are short, and each round doubles what a row has gone."""
    at = ws.write(forms.select("word", F.col("form").alias("root")), "root0")
    done, k = 1, 0
    while done < hops:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = ws.write(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"root{k + 1}")
        ws.drop(f"root{k}")
        at, done, k = moved, done * 2, k + 1
    return at


def spelling_variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, factor: int = 10, modulus: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of whole texts that have ``least_length`` code points and occur ``least_count`` times.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; where ``modulus`` divides the crc32 of ``<id>:<run>`` the run
    lacks the code point at that number modulo its length (a seeded misspelling; a null id is written as nothing). Two words are near if they
    differ by one inserted, deleted or replaced code point. ``form`` is the near word of largest count (ties: the smallest in code-point
    order) if it occurs ``factor`` times as often as the word, ``root`` the last of the forms of forms, or the word itself.

    Null and empty texts have no words, an empty table gives no rows, repeated rows count each time. Words of any length go: a word of L
    code points gives L + 1 rows of three numbers, and its string is in no row of them. Under one key meet at most as many words as there
    are letters times places, so no group grows with the data. Other columns of ``docs`` are not read, whatever their names.
    """
    ws = Workspace(docs.sparkSession, "spelling")
    counted = word_counts(docs, least_length, modulus, id_col, text_col).where(F.col("n") >= least_count)
    words = ws.write(counted.withColumn("id", F.xxhash64("word")), "words")
    most = words.agg(F.max("n")).first()[0] or least_count
    near = near_words(words, ws)
    no = F.lit(None)
    rows = near.select("word", "n", "near", "near_n").unionByName(words.select("word", "n", no.cast("string").alias("near"), no.cast("long").alias("near_n")))
    best = F.min_by(F.struct("near", "near_n"), F.when(F.col("near").isNotNull(), F.struct(-F.col("near_n"), F.col("near"))))
    summed = rows.groupBy("word").agg(F.first("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    chosen = F.coalesce(F.col("best.near_n") >= factor * F.col("n"), F.lit(False))
    found = ws.write(summed.select("word", "n", "n_near", F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, F.col("best.near_n")).alias("form_n")), "found")
    hops, reach = 1, least_count * factor
    while factor > 1 and reach * factor <= most:
        hops, reach = hops + 1, reach * factor
    roots = _roots(found.where("form is not null"), hops, ws)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
