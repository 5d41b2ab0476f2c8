"""Lempel-Ziv phrase fingerprints: what a dictionary compressor would share between two documents.

A text is parsed from left to right into phrases, each the shortest string of code points not yet in the document's dictionary. The
set of phrases is hashed and kept as a minimum-hash signature of one permutation: the values fall into ``BINS`` bins, and of each
bin the least value's 16 bits are kept (0: no phrase fell there). Likeness is the share of bins, among those that either has, in which
two signatures agree, freed of chance agreement; it estimates the Jaccard similarity of the phrase sets. Two empty texts are alike (1.0),
an empty and another one are not (0.0). Equal texts have equal fingerprints wherever they are parsed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import BASE, BASE_INVERSE, U64, balanced_cuts, deal, id_and_text, in_span, mix, partitions, powers, table

BINS = 128


def _parse(text: str, phrases: set[str], start: int) -> tuple[list[int], int]:
    """Ends of the phrases of ``text`` from ``start`` on, and where the last, unfinished one begins; ``phrases`` grows."""
    ends: list[int] = []
    add, note = phrases.add, ends.append
    for end in range(start + 1, len(text) + 1):
        if (piece := text[start:end]) not in phrases:
            add(piece)
            note(end)
            start = end
    return ends, start


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _signature(codes: np.ndarray, ends: list[int], last: int) -> np.ndarray:
    """Of the phrases that end at ``ends``, and the rest from ``last`` if any."""
    out = np.zeros(BINS, np.uint16)
    n = len(codes)
    if not n:
        return out
    end = np.array(ends, np.int64)
    start = np.r_[0, end[:-1]] if len(end) else end
    if last < n:
        start, end = np.r_[start, last], np.r_[end, n]
    total = np.zeros(n + 1, U64)
    np.cumsum((codes.astype(U64) + U64(1)) * powers(BASE_INVERSE, n), out=total[1:])
    hashes = mix((total[end] - total[start]) * powers(BASE, n + 1)[start])
    least = np.full(BINS, np.iinfo(U64).max, U64)
    np.minimum.at(least, (hashes & U64(BINS - 1)).astype(np.int64), hashes)
    has = least != np.iinfo(U64).max
    out[has] = (mix(least[has]) % U64(65535)).astype(np.uint16) + 1
    return out


def signature(text: str) -> np.ndarray:
    ends, last = _parse(text, set(), 0)
    return _signature(_codes(text), ends, last)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; of two signatures."""
    either = int(((a != 0) | (b != 0)).sum())
    if not either:
        return 1.0
    share = float(((a == b) & (a != 0)).sum()) / either
    return max(0.0, (share - 1 / 65535) / (1 - 1 / 65535))


def likeness_hex(a: str, b: str) -> float:
    return likeness(*(np.frombuffer(bytes.fromhex(x), ">u2") for x in (a, b)))


def _hex(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def _both(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Signatures of a text and of its edited text, and the edited text. What they share is parsed once."""
    keep = len(text) - len(text) // 3
    edited = text[:keep] + following[: len(text) // 3]
    phrases: set[str] = set()
    ends, last = _parse(text[:keep], phrases, 0)
    rest, rest_last = _parse(text, set(phrases), last)
    tail, tail_last = _parse(edited, phrases, last)
    return _signature(_codes(text), ends + rest, rest_last), _signature(_codes(edited), ends + tail, tail_last), edited


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (span, halo, doc_id, text) in order; each row is compared with the next one of its span, and halo rows are only that."""
    rows: list[list] = [[] for _ in SCHEMA]

    def give(doc_id: int | None, n: int, digest: str, own: np.ndarray, edited: np.ndarray, following: np.ndarray) -> None:
        for row, x in zip(rows, (doc_id, n, digest, _hex(own), _hex(edited), likeness(own, edited), likeness(own, following)), strict=True):
            row.append(x)

    at = last = done = None  # the span; a row that waits for the next text; one that waits for the next text's signature
    for batch in batches:
        for span, halo, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if span != at:
                at, last, done = span, None, None
            text = text.as_py()
            if last is not None:
                own, other, edited = _both(last[1], text)
                if done is not None:
                    give(*done, own)
                done = (last[0], len(last[1]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, other)
            last = None if halo else (doc_id, text)
            if halo and done is not None:
                give(*done, signature(text))
                done = None
        if rows[0]:
            yield table(SCHEMA, *rows)
            rows = [[] for _ in SCHEMA]


def lz_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and the likeness to the next document.

    The next document is the one after it by descending id (ids that repeat: by descending text; null ids last); after the last comes
    the first. The edited text has its last third of code points replaced by as many first ones of the next document.

    Ids are cut into as many spans as there are shuffle partitions, of about as many bytes of text each; each span also gets the row that follows its last one. Only the cuts
    and the spans' largest ids come to the driver. Texts cross one shuffle and are parsed once. Null texts are empty, a document alone is
    its own next one, an empty table gives no rows; equal rows each have their row. A text is parsed whole, however long, in memory that
    is some multiple of its length. Other columns of ``docs`` are not read, whatever their names.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    count = partitions(spark)
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))  # a null id sorts last
    rows = rows.withColumn("k", key)
    rows = rows.withColumn("span", in_span("k", balanced_cuts(rows, "k", F.octet_length("text") + 256, count)))
    tops = {r["span"]: r["top"] for r in rows.groupBy("span").agg(F.max("k").alias("top")).collect()}  # one row for each span
    if not tops:
        return spark.createDataFrame([], DDL)
    spans = sorted(tops)
    after = [(tops[below], above) for below, above in zip(spans, spans[1:] + spans[:1], strict=True)]  # the last row of `above` is followed by the top of `below`
    halo = F.broadcast(spark.createDataFrame(after, "k long, span int"))  # as many rows as spans
    first = rows.drop("span").join(halo, "k").withColumn("halo", F.lit(True))
    dealt = deal(rows.withColumn("halo", F.lit(False)).unionByName(first), count)
    ordered = dealt.sortWithinPartitions(F.desc("span"), F.asc("halo"), F.desc("k"), F.desc("text")).select("span", "halo", "doc_id", "text")
    return ordered.mapInArrow(_compare, DDL)
