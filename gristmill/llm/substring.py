"""Substring dedup on a compacted de Bruijn graph of word sequences.

Edges are the sequences of ``width`` (50) consecutive words of a document. Every edge belongs to the bucket of its minimizer, the least
hash among its 12-word sequences, so equal edges meet in one bucket wherever they occur. Consecutive edges of one bucket form a
nonbranching stretch of a document, which is kept as one row: its contents' hash and its source coordinates (document, first word, edges).
Equal stretches compact into one path with the smallest document that has it, and with the paths next to it: one that all its occurrences
are followed by, or preceded by, is a degree of one, other neighbours or the end of a document make a branch. A join of paths finds the
junctions at which both sides have a degree of one, and neighbouring stretches with such a junction are one longer nonbranching path.

* A bucket of one path has no branch: all edges of it occur exactly where the path does.
* In a bucket of several paths they may share some edges. Each path is opened at all its occurrences in its first document, in every row of
  that id, to its edges; longer paths don't open, only the stretches in them.

Hashes only find candidates. Paths that several documents have, and the edges of opened ones, are read again at their source coordinates, and
the words there are compared by 128 bits of their SHA-256, once for a path however long: what repeats is what has the digest of words in a
smaller document. Spans of repeated edges meet at their coordinates, and the words go.

Words ``[^\\x20\\x09-\\x0D]+`` are unchanged. Null texts have no words, and an empty table gives no rows. A row without an id has no
smaller or larger document: it keeps all words and removes none. Rows that repeat an id are one document to each other (neither removes
words of the other) and have a row each; they are told apart by the MD5 of their texts. Of documents that tie, that is, have the same
window, the smallest id keeps it. A long text is one row in a task; its stretches are many. Other columns are not read by
``substring_report`` and kept by ``remove_repeats``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import U64, Text, Workspace, chunks, fresh, id_and_text, mix, named, spans_hash, table, word_hash

#: Words of a minimizer.
SEED = 12


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step] if step else out, out[step:])
        have += step
    return out


def stretches(text: Text, width: int) -> tuple[np.ndarray, ...]:
    """(document, minimizer, contents, first word, edges) of all stretches, and the words' hashes and documents' first words."""
    start, end, first = text.words()
    words = word_hash(text.data, start, end)
    n = len(words)
    edges = n - width + 1
    if edges <= 0:
        none = np.zeros(0, np.int64)
        return none, none.astype(U64), none.astype(U64), none, none, words, first
    at = np.arange(n - SEED + 1)
    least = _least(mix(spans_hash(words, at, at + SEED)), width - SEED + 1)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.arange(edges) + width <= first[doc[:edges] + 1]
    opens = inside & np.r_[True, (least[1:] != least[:-1]) | ~inside[:-1] | (doc[1:edges] != doc[: edges - 1])]
    begin = np.flatnonzero(opens)
    many = np.diff(np.r_[np.cumsum(np.r_[0, inside])[np.r_[begin, edges]]])
    contents = mix(spans_hash(words, begin, begin + many + width - 1))
    return doc[begin], least[begin], contents, begin - first[doc[begin]], many, words, first


STRETCH = pa.schema([("m", pa.int64()), ("h", pa.int64()), ("n", pa.int32()), ("doc_id", pa.int64()), ("version", pa.binary()), ("at", pa.int32()), ("before", pa.int64()), ("after", pa.int64())])
STRETCH_DDL = "m long, h long, n int, doc_id long, version binary, at int, before long, after long"


def _stretches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = batch.column(0), batch.column(1)
            for text in chunks(batch.column(2)):
                doc, m, h, at, n, *_ = stretches(text, width)
                row, h = pa.array(doc + text.first), h.view(np.int64)
                same = doc[1:] == doc[:-1]  # contents of the neighbours; 0 at the ends of a document
                before, after = np.r_[0, np.where(same, h[:-1], 0)][: len(h)], np.r_[np.where(same, h[1:], 0), 0][: len(h)]
                yield table(STRETCH, m.view(np.int64), h, n.astype(np.int32), ids.take(row), versions.take(row), at.astype(np.int32), before, after)

    return run


WHOLE_DDL = "doc_id long, version binary, n_words long, sha256 string"
WHOLE = pa.schema([("doc_id", pa.int64()), ("version", pa.binary()), ("n_words", pa.int64()), ("sha256", pa.string())])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a document is if it keeps all words."""
    for batch in batches:
        words = [t.as_py().encode("utf-8", "surrogatepass").split() for t in batch.column(2)]
        yield table(WHOLE, batch.column(0), batch.column(1), list(map(len, words)), [hashlib.sha256(b" ".join(w)).hexdigest() for w in words])


EDGES = pa.schema([("n", pa.int32()), ("digest", pa.binary()), ("doc_id", pa.int64()), ("version", pa.binary()), ("at", pa.int32())])
EDGES_DDL = "n int, digest binary, doc_id long, version binary, at int"
DIGEST = 16


def _joined(text: Text) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a chunk joined by single spaces, where each begins and ends there, and the documents' first words."""
    start, end, first = text.words()
    length = end - start + 1
    ends = np.cumsum(length)
    own = np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
    flat = np.append(text.data, np.uint8(0x20))[own]
    flat[ends - 1] = 0x20
    return flat.tobytes(), ends - length, ends - 1, first


def _digests(width: int):
    """Rows (doc_id, version, text, spans of (at, n, whole, open)) to the digest of each path that whole spans make (1 begins a path, 2 goes on
    with that of the span before it), and of each edge of the open ones (n is 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for batch in batches:
            ids, versions, spans = batch.column(0), batch.column(1), batch.column(3)
            for text in chunks(batch.column(2)):
                flat, start, end, first = _joined(text)
                view = memoryview(flat)
                own = spans.slice(text.first, len(text))
                row = np.repeat(np.arange(len(text)), own.value_lengths().to_numpy())
                at, n, whole, open_ = (own.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
                edges = n * open_
                each = np.repeat(np.arange(len(n)), edges)
                begin = at[each] + np.arange(len(each)) - np.repeat(np.cumsum(edges) - edges, edges)
                some = np.flatnonzero(whole)
                some = some[np.lexsort((at[some], row[some]))]
                goes_on = (whole[some[1:]] == 2) & (row[some[1:]] == row[some[:-1]]) & (at[some[1:]] == at[some[:-1]] + n[some[:-1]])
                opens = np.flatnonzero(np.r_[True, ~goes_on][: len(some)])
                long_n = np.add.reduceat(n[some], opens) if len(some) else n[some]
                some = some[opens]
                place, long = np.r_[first[row[some]] + at[some], first[row[each]] + begin], np.r_[long_n + width - 1, np.full(len(each), width)]
                body = b"".join([sha(view[a:b]).digest()[:DIGEST] for a, b in zip(start[place].tolist(), end[place + long - 1].tolist(), strict=True)])
                offsets = pa.array(np.arange(len(place) + 1, dtype=np.int32) * DIGEST).buffers()[1]
                digest = pa.Array.from_buffers(pa.binary(), len(place), [None, offsets, pa.py_buffer(body)])
                rows = pa.array(np.r_[row[some], row[each]] + text.first)
                yield table(EDGES, np.r_[long_n, np.zeros(len(each), np.int64)].astype(np.int32), digest, ids.take(rows), versions.take(rows), np.r_[at[some], begin].astype(np.int32))

    return run


CUT = pa.schema([("doc_id", pa.int64()), ("version", pa.binary()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _cut(width: int, digest: bool):
    """Rows (doc_id, version, text, spans of (at, n)) without the words that the edges of the spans cover: kept words, or their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, spans in zip(batch.column(2), batch.column(3), strict=True):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                cover = np.zeros(len(words) + 1, np.int64)
                at, n = (spans.values.field(k).to_numpy().astype(np.int64) for k in range(2))
                np.add.at(cover, at, 1)
                np.add.at(cover, at + n + width - 1, -1)
                gone = np.cumsum(cover[:-1]) > 0
                joined = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                removed.append(int(gone.sum()))
                kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode("utf-8", "surrogatepass"))
            yield table(CUT, batch.column(0), batch.column(1), removed, kept)

    return run


def _repeats(rows: DataFrame, width: int, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Texts with candidates (doc_id, version, text), and the verified repeated spans (doc_id, version, at, n).

    All sides of the joins grow with the corpus, so they are merged at every size; hot keys are split by their skew.
    """
    all_ = ws.write(rows.where("doc_id is not null").select("doc_id", "version", "text").mapInArrow(_stretches(width), STRETCH_DDL), "stretches")
    buckets = all_.groupBy("m").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("m")
    shared = ws.write(all_.join(ws.write(buckets, "buckets", narrow=True).hint("merge"), "m"), "shared")  # stretches of minimizers that two documents have
    ws.drop("stretches", "buckets")
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)  # noqa: E731  the only neighbour, null at a branch
    paths = ws.write(shared.groupBy("m", "h", "n").agg(F.min("doc_id").alias("source"), (F.min("doc_id") < F.max("doc_id")).alias("whole"), one("before"), one("after")), "paths")
    branching = ws.write(paths.groupBy("m").agg(F.count("*").alias("c")).where("c > 1").select("m", F.lit(True).alias("branches")), "branching", narrow=True)
    known = paths.join(branching, "m", "left").withColumn("branches", F.coalesce("branches", F.lit(False))).where("whole or branches")
    known = ws.write(known, "known")
    leads = known.where("whole and after is not null").select(F.col("h").alias("before"), F.col("after").alias("h"), F.lit(True).alias("follows"))
    known = known.join(leads.hint("merge"), ["before", "h"], "left").select("m", "h", "n", "source", "branches", F.when(~F.col("whole"), 0).when(F.col("follows").isNull(), 1).otherwise(2).alias("whole"))
    placed = shared.select("m", "h", "n", "doc_id", "version", "at").join(known.hint("merge"), ["m", "h", "n"]).withColumn("open", F.col("branches") & (F.col("doc_id") == F.col("source")))
    placed = ws.write(placed.where("whole > 0 or open").select("doc_id", "version", "at", "n", "whole", "open"), "placed")
    ws.drop("shared", "paths", "branching", "known")
    wanted = ws.write(placed.groupBy("doc_id", "version").agg(F.collect_set(F.struct("at", "n", "whole", "open")).alias("spans")), "wanted")  # no more than a document has words; equal rows are one
    texts = rows.join(wanted.hint("merge"), ["doc_id", "version"]).select("doc_id", "version", "text", "spans").dropDuplicates(["doc_id", "version"])
    texts = ws.write(texts, "texts")
    ws.drop("placed", "wanted")
    edges = ws.write(texts.mapInArrow(_digests(width), EDGES_DDL), "edges")
    least = ws.write(edges.groupBy("n", "digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("n", "digest", "low"), "least")
    found = edges.join(least.hint("merge"), ["n", "digest"]).where("low < doc_id").select("doc_id", "version", "at", F.greatest("n", F.lit(1)).alias("n"))
    found = ws.write(found, "spans")
    ws.drop("edges", "least")
    return texts.drop("spans"), found


def _removals(rows: DataFrame, width: int, digest: bool, ws: Workspace) -> DataFrame:
    texts, spans = _repeats(rows, width, ws)
    listed = spans.groupBy("doc_id", "version").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    return ws.write(texts.join(listed, ["doc_id", "version"]).select("doc_id", "version", "text", "spans").mapInArrow(_cut(width, digest), "doc_id long, version binary, n_removed long, kept string"), "removals")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_and_text(docs, id_col, text_col).withColumn("version", F.unhex(F.md5("text")))


def substring_report(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row. Only texts with repeated edges are dealt by document."""
    if width < SEED:
        raise ValueError(f"width must be {SEED} or more")
    ws = Workspace(docs.sparkSession, "substring")
    rows = _rows(docs, id_col, text_col)
    whole = ws.write(rows.select("doc_id", "version", "text").mapInArrow(_whole, WHOLE_DDL), "whole")
    cut = _removals(rows, width, True, ws)
    joined = whole.join(cut, ["doc_id", "version"], "left")  # a null id finds nothing
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept", "sha256").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated words removed from their texts; a changed text has its kept words joined by one space, others stay as they are."""
    ws = Workspace(docs.sparkSession, "substring-remove")
    cut = _removals(_rows(docs, id_col, text_col), width, False, ws)
    key, version, kept = (fresh(docs, f"substring_{c}") for c in ("id", "version", "kept"))
    cut = cut.select(F.col("doc_id").alias(key), F.col("version").alias(version), F.col("kept").alias(kept))
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    joined = docs.join(cut, (named(id_col).cast("long") == F.col(key)) & (F.unhex(F.md5(text)) == F.col(version)), "left")
    return joined.select(*(F.coalesce(F.col(kept), named(c)).alias(c) if c.lower() == text_col.lower() else named(c) for c in docs.columns))
