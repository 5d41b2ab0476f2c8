"""Best-fit packing into bins of several permitted lengths, planned on the counts of lengths.

Pieces of equal length are interchangeable, so best fit over all documents is decided on how many pieces there are of each length: the
driver plans with at most ``max(capacities)`` counts, however many documents there are, and tasks only look up where a piece goes.

Longest pieces first, each goes to the open bin that it fills best, of any capacity. If it fits none, bins open of the size that costs
least for each token they are likely to hold: a bin of capacity c costs ``overhead + c + attention * c * c``, and of the space beside its
first pieces as much counts as filled as shorter pieces are still to come. That is decided once for all pieces of a length that fit no open
bin. In the end each bin is downsized to the least permitted length that holds its contents.

A document longer than the largest capacity is cut into full pieces and a rest. Among pieces of a length the order is by a hash of id and
piece, then by these (a null id is one more id). Null and empty documents take no place: they have one row with a null bin. Rows that repeat
an id are packed each, equal rows too. Of sizes that cost the same the smaller opens, of bins that fit alike the first. An empty table gives
no rows. Texts are encoded whole, however long. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import Workspace, balanced_cuts, deal, id_and_text, in_span, partitions, settle, table
from gristmill.llm.encoder import encoder

#: Permitted sequence lengths, in tokens; what a sequence costs besides its length, and what attention adds for its square.
CAPACITIES, OVERHEAD, ATTENTION = (512, 1024, 2048, 4096), 32.0, 1 / 32768


class Plan:
    """Where the pieces of each length go.

    Segments (length, first rank, bin, per bin, offset): the piece of rank r goes to bin ``bin + (r - first) // per`` at ``offset + (r - first) % per * length``.
    Groups (first bin, capacity, used): bins of equal contents, numbered one after the other.
    """

    def __init__(self, counts: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD, attention: float = ATTENTION):
        self.capacities = tuple(sorted(capacities))
        self.segments: list[tuple[int, int, int, int, int]] = []
        open_bins: dict[int, list[tuple[int, int, int]]] = {}  # by space left: (first bin, bins, used), as heaps
        spaces: list[int] = []
        closed: list[tuple[int, int, int]] = []
        supply = sum(length * n for length, n in counts.items())
        self.bins = 0

        def put(left: int, first: int, n: int, used: int) -> None:
            if n and left:
                if left not in open_bins:
                    open_bins[left] = []
                    insort(spaces, left)
                heapq.heappush(open_bins[left], (first, n, used))
            elif n:
                closed.append((first, n, used))

        for length in sorted((x for x in counts if counts[x]), reverse=True):
            todo, rank = counts[length], 0
            supply -= length * todo
            while todo:
                at = bisect_left(spaces, length)
                if at < len(spaces):
                    left = spaces[at]
                    first, n, used = heapq.heappop(open_bins[left])
                    if not open_bins[left]:
                        del open_bins[left]
                        spaces.pop(at)
                else:
                    left, used, first = self._size(length, todo, supply, overhead, attention), 0, self.bins
                    n = -(-todo // (left // length))
                    self.bins += n
                per = left // length  # the fullest bin stays the best fit until it is too full
                whole = min(n, todo // per)
                over = min(todo - whole * per, per) if whole < n else 0
                self.segments.append((length, rank, first, per, used))
                taken = whole * per + over
                put(left - per * length, first, whole, used + per * length)
                if over:
                    put(left - over * length, first + whole, 1, used + over * length)
                put(left, first + whole + bool(over), n - whole - bool(over), used)
                todo, rank = todo - taken, rank + taken
        groups = sorted(closed + [g for heap in open_bins.values() for g in heap])
        self.groups = [(first, n, self.capacities[bisect_left(self.capacities, used)], used) for first, n, used in groups]

    def _size(self, length: int, todo: int, supply: int, overhead: float, attention: float) -> int:
        def cost(c: int) -> float:
            held = min(c // length, todo) * length
            return (overhead + c + attention * c * c) / (held + min(c - held, supply))

        return min((c for c in self.capacities if c >= length), key=lambda c: (cost(c), c))

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Segments in order of length and first rank, then groups."""
        segments = np.array(sorted(self.segments), np.int64).reshape(-1, 5)
        groups = np.array(self.groups, np.int64).reshape(-1, 4)
        return segments, groups


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int32())])
PIECES_DDL = "doc_id long, piece int, start long, n_tokens int"


def _cut(tokenizer: str, largest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        own = encoder(tokenizer)
        for batch in batches:
            n = np.concatenate([c for _, _, c in own.column(batch.column(1))] or [np.zeros(0, np.int64)]).astype(np.int64)
            many = np.maximum(1, -(-n // largest))
            row = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            yield table(PIECES, batch.column(0).take(pa.array(row)), piece.astype(np.int32), piece * largest, np.minimum(largest, n[row] - piece * largest).astype(np.int32))

    return run


PLACED = pa.schema([("bin_id", pa.int64()), ("capacity", pa.int32()), ("slot_start", pa.int32()), *PIECES])
PLACED_DDL = "bin_id long, capacity int, slot_start int, doc_id long, piece int, start long, n_tokens int"


def _place(segments: np.ndarray, groups: np.ndarray, before: dict[tuple[int, int], int]):
    """Ranks the pieces of a span, which come in order, from the counts of the spans before, and looks up their bins."""
    scale = 1 << 44  # above any rank
    keys = segments[:, 0] * scale + segments[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            spans, length = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 4))
            if not len(length):
                continue
            both = spans * scale + length
            cuts = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
            ends = np.r_[cuts[1:], len(both)]
            rank = np.arange(len(both))
            for a, b in zip(cuts.tolist(), ends.tolist(), strict=True):
                key = (int(spans[a]), int(length[a]))
                start = seen.get(key, before.get(key, 0))
                rank[a:b] += start - a
                seen[key] = start + b - a
            some = length > 0
            bin_id, offset, capacity = np.zeros(len(both), np.int64), np.zeros(len(both), np.int64), np.zeros(len(both), np.int64)
            if some.any():
                found = segments[np.searchsorted(keys, length[some] * scale + rank[some], side="right") - 1]
                at = rank[some] - found[:, 1]
                bin_id[some] = found[:, 2] + at // found[:, 3]
                offset[some] = found[:, 4] + at % found[:, 3] * length[some]
                capacity[some] = groups[np.searchsorted(groups[:, 0], bin_id[some], side="right") - 1, 2]
            own = (pa.array(x, mask=~some) for x in (bin_id, capacity.astype(np.int32), offset.astype(np.int32)))
            yield table(PLACED, *own, *(batch.column(k) for k in range(1, 5)))

    return run


def pack(docs: DataFrame, tokenizer: str, capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD, attention: float = ATTENTION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: bin, its final capacity, where in it the piece lies, document, piece, first token and tokens.

    Texts are encoded in one pass without a shuffle; only (id, piece, length) is dealt, by ranges of length and id, so that a length that a
    third of all pieces has is split among tasks. The driver sees counts by length and span: at most as many as there are lengths and spans.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    largest = max(capacities)
    pieces = ws.write(id_and_text(docs, id_col, text_col).mapInArrow(_cut(tokenizer, largest), PIECES_DDL), "pieces")
    count = partitions(spark)
    order = F.xxhash64("doc_id", "piece").bitwiseAND(F.lit((1 << 48) - 1))  # spreads the pieces of a length evenly
    keyed = pieces.withColumn("k", F.shiftleft(F.col("n_tokens").cast("long"), 48) + order)
    spans = keyed.withColumn("span", in_span("k", balanced_cuts(keyed, "k", F.lit(1), count)))
    by_span = spans.groupBy("n_tokens", "span").count().collect()  # a range of k has few lengths that others have too
    counts: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for r in sorted(by_span):
        before[r["span"], r["n_tokens"]] = counts.get(r["n_tokens"], 0)
        counts[r["n_tokens"]] = counts.get(r["n_tokens"], 0) + r["count"]
    segments, groups = Plan({x: n for x, n in counts.items() if x}, capacities, overhead, attention).arrays()
    dealt = deal(spans, count).sortWithinPartitions("span", "n_tokens", "k", "doc_id", "piece").select("span", "doc_id", "piece", "start", "n_tokens")
    return dealt.mapInArrow(_place(segments, groups, before), PLACED_DDL)
