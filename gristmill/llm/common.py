"""What the operators share: the shared folder, written tables, and word kernels over Arrow text columns."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.hashing import BASE as BASE
from gristmill.hashing import BASE_INVERSE as BASE_INVERSE
from gristmill.hashing import U64 as U64
from gristmill.hashing import mix as mix
from gristmill.hashing import powers as powers
from gristmill.hashing import spans_hash as spans_hash
from gristmill.storage import Workspace as Workspace

#: Bytes of text that a kernel handles at a time; a longer document is a chunk of its own.
CHUNK_BYTES = 1_000_000


try:  # glibc only
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):
    _TRIM = None


def settle() -> None:
    """Gives memory that a kernel has freed back to the system: workers live on, and their peaks would add up."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def named(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_1``, ``name_2``, ... that ``df`` lacks (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    k, out = 0, name
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator needs, as ``doc_id`` and ``text``; a null text is empty."""
    return df.select(named(id_col).cast("long").alias("doc_id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What of eight bytes belongs to a word of 0 to 8 bytes.
_PARTS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each [start, end), eight at a time, so the cost is by word and not by byte."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    length = end - start
    out = mix((eight[start] & _PARTS[np.minimum(length, 8)]) * U64(BASE) + (length + seed * 0x1000193).astype(U64))
    todo, k = np.flatnonzero(length > 8), 8
    while len(todo):
        left = length[todo] - k
        out[todo] = mix(out[todo] * U64(BASE) ^ (eight[start[todo] + k] & _PARTS[np.minimum(left, 8)]))
        todo, k = todo[left > 8], k + 8
    return out


SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of words without case and punctuation: A-Z lower-cased, other letters, digits and non-ASCII bytes as they are, all else a space.
PLAIN = np.full(256, 0x20, np.uint8)
PLAIN[0x80:] = np.arange(0x80, 0x100)
PLAIN[0x30:0x3A] = np.arange(0x30, 0x3A)
PLAIN[0x61:0x7B] = PLAIN[0x41:0x5B] = np.arange(0x61, 0x7B)


class Text:
    """Documents of one chunk: ``data`` their UTF-8 bytes, ``offsets`` where each begins (and the last ends)."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of ``data``, and for each document its first word's index."""
        data = self.data if data is None else data
        n = len(data)
        space = np.ones(n + 2, bool)
        np.take(SPACES, data, out=space[1:-1])
        inner = self.offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        begins = space[:-2] & ~space[1:-1]
        begins[inner] = ~space[inner + 1]
        ends = space[2:] & ~space[1:-1]
        ends[inner - 1] = ~space[inner]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return start, end, np.searchsorted(start, self.offsets)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Text]:
    """A string column in chunks of whole documents, of about ``limit`` bytes; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null may cover bytes
        column = pa.compute.fill_null(column, "")
        yield from chunks(column, limit)
        return
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        end = min(end, n)
        low, high = int(offsets[at]), int(offsets[end])
        yield Text(at, data[low:high], offsets[at : end + 1] - low)
        at = end


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for f, c in zip(schema, columns, strict=True)], schema=schema)


def _bin_of(starts: np.ndarray, ends: np.ndarray, widths: np.ndarray, some: int):
    """For each key the number of its range, times ``some`` + 1, and its bin there; -1 outside of the ranges."""

    @F.pandas_udf("long")
    def run(k: pd.Series) -> pd.Series:
        own = k.to_numpy().astype(np.int64)
        at = np.maximum(np.searchsorted(starts, own, side="right") - 1, 0)
        inside = (own >= starts[at]) & (own <= ends[at])
        off = (own.view(U64) - starts.view(U64)[at]) // widths[at]  # modulo 2**64, so ranges of any width do
        return pd.Series(np.where(inside, at * (some + 1) + off.astype(np.int64), -1))

    return run


def balanced_cuts(df: DataFrame, key: str, weight: Column, parts: int, bins: int = 4096) -> list[int]:
    """At most ``parts - 1`` cuts of the long column ``key`` that share out ``weight`` evenly; the same for the same rows.

    Exact sums over equal-width bins, and again within bins that weigh more than half a part, so clustered keys are cut finely. A round is
    one job, whatever the number of heavy bins; the driver gets ``bins`` sums in the first and at most 64 for each heavy bin in later ones, of
    which there are fewer than ``2 * parts``. No key is split.
    """
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None or parts < 2:
        return []
    ranges, done, goal = [(low, high)], [], 0.0
    while ranges:
        some = bins if not goal else 64
        starts, ends = np.array([a for a, _ in ranges], np.int64), np.array([b for _, b in ranges], np.int64)
        widths = [max(1, -(-(b - a + 1) // some)) for a, b in ranges]
        bin_of = _bin_of(starts, ends, np.array(widths, U64), some)
        sums = df.select(bin_of(key).alias("bin"), weight.alias("w")).where("bin >= 0").groupBy("bin").agg(F.sum("w").cast("double").alias("w")).collect()
        goal = goal or sum(r["w"] or 0 for r in sums) / parts or 1.0
        heavy: list[tuple[int, int]] = []
        for r in sorted(sums):
            at, off = divmod(r["bin"], some + 1)
            x = ranges[at][0] + off * widths[at]
            y = min(ranges[at][1], x + widths[at] - 1)
            if (r["w"] or 0) > goal / 2 and y > x:
                heavy.append((x, y))
            else:
                done.append((x, r["w"] or 0))
        ranges = heavy
    cuts, total, part = [], 0.0, 0
    for x, w in sorted(done):
        if (now := min(parts - 1, int((total + w / 2) / goal))) > part and total:  # by the total so far, so that parts don't drift
            cuts.append(x)
            part = now
        total += w
    return cuts


def in_span(key: str, cuts: list[int]) -> Column:
    """The number of ``cuts`` at or below ``key``, by binary search."""
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def span(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, k.to_numpy(), side="right").astype(np.int32))

    return span(F.col(key))


def deal(df: DataFrame, count: int, span: str = "span") -> DataFrame:
    """Rows by their ``span`` (0 to ``count`` - 1), each to a partition of its own: a hash of the number itself would put several in one."""
    return df.repartitionById(count, F.col(span))


def uri(path: str) -> str:
    """A path as pyarrow's file systems take it: ``s3a`` and ``s3n`` are ``s3``, ``dbfs`` is its mount; ``hdfs`` needs libhdfs on executors."""
    for old, new in (("file:///", "file:///"), ("file:/", "file:///"), ("s3a://", "s3://"), ("s3n://", "s3://"), ("dbfs:/", "file:///dbfs/")):
        if path.startswith(old):
            return new + path[len(old) :].lstrip("/")
    return path
