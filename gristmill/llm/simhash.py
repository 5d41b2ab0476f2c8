"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within 4 bits share a variant within 2 bits of both, so every fingerprint emits its ball of radius 2 and equal
variants give the links. A ball of 64 bits has 2,081 variants. Rows are dealt by the variants' low bits: a fingerprint goes once to
each block that holds any of its variants (37 of 256 blocks, 211 of 2**20) and its variants there are written out in the block, in parts
of bounded size. So the shuffle is on variants, while 37 to 352 values cross it instead of 2,081. The number of blocks follows the data:
low bits are added until no block gets more than ``MOST`` fingerprints.

That links what differs in 4 bits, as ``near_duplicates`` returns it. Texts of a shingle similarity of 0.8 differ in about ten of 64 bits, where
a ball can't be written out; ``similar_texts`` finds them by several shorter fingerprints and verifies the shingles.

Fingerprints are those of the words ``[^\\x20\\x09-\\x0D]+`` in A-Z lower-cased text: a bit is 1 if over half of the XXH64 values
(seed 42) of the 4-word shingles, repeats included, have it. A text of fewer words is one shingle, one without words has fingerprint 0.
Null texts are empty; a row with a null id is fingerprinted and links others, but names no component. Repeated rows stay, and each has its
row. A bit that half of the values have is 0 (a tie). An empty table gives no rows. Texts are read whole, however long. Other columns are
not read by ``near_duplicates`` and kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import acos, ceil, comb, log, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import U64, Workspace, fresh, id_and_text, mix, named, settle, table
from gristmill.llm.components import components

BITS = 64
#: Variants that a block writes out at a time.
PART = 1 << 20
#: Fingerprints of a block at most, and the fewest and most low bits that blocks may have.
MOST, BLOCK_BITS = 1 << 18, (8, 26)
#: Where there are several fingerprints of a text: those of a block at most, and unrelated texts that a text may meet.
BAND_MOST, UNRELATED = 1 << 21, 4


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 values (seed 42) of the shingles of a text, in order."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and \x09-\x0D and \x20 only
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], U64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(lengths + 1) - 1
    start = (end - lengths)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(start, end[width - 1 :].tolist(), strict=True)], U64)


def _majority(hashes: np.ndarray) -> int:
    """Of each bit whether over half of the values have it."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        part = hashes[k : k + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str, width: int = 4) -> int:
    """The unsigned 64-bit SimHash of one text; 0 of one without words."""
    return _majority(shingle_hashes(text, width))


FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], U64)
            yield table(FINGERPRINTS, batch.column(0), pa.array(values.view(np.int64)))

    return run


def hex_fingerprint(text_col: str, width: int) -> Column:
    """The fingerprint of a text column, as 16 hex digits."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: f"{fingerprint(t or '', width):016x}")

    return run(named(text_col).cast("string"))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


@lru_cache(maxsize=64)
def _masks(low: int, weight: int, bits: int) -> np.ndarray:
    """All values with ``weight`` of the bits from ``low`` to ``bits`` - 1."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(low, bits), weight)], U64)


def _deal(block_bits: int, radius: int):
    """Each fingerprint to the blocks within ``radius`` bits of its low bits, packed by block."""
    near = np.array([sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(block_bits), k)], U64)
    schema = pa.schema([("block", pa.int32()), ("fps", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(U64)
            block = ((fps & U64((1 << block_bits) - 1))[:, None] ^ near[None, :]).ravel()
            values = np.repeat(fps, len(near))
            order = np.argsort(block, kind="stable")
            block, values = block[order], values[order]
            cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
            ends = np.r_[cuts[1:], len(block)]
            yield table(schema, block[cuts].astype(np.int32), pa.array([values[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()))

    return run


def _variants(fps: np.ndarray, index: np.ndarray, left: np.ndarray, low: int, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(variant, index) within ``left`` bits of each fingerprint, bits ``low`` and up, a part of bounded size at a time; equal variants share a part."""
    n, free = np.bincount(left, minlength=3), bits - low
    total = int(n[0] + n[1] * (1 + free) + n[2] * (1 + free + free * (free - 1) // 2))
    if total > PART and low < bits - 4:
        digit = (fps >> U64(low)) & U64(15)
        for value in range(16):
            away = popcount(digit ^ U64(value)).astype(np.int64)
            keep = away <= left
            flip = ((digit ^ U64(value)) << U64(low))[keep]
            yield from _variants(fps[keep] ^ flip, index[keep], left[keep] - away[keep], low + 4, bits)
        return
    out, own = [], []
    for weight in range(3):
        able = left >= weight
        if able.any():
            masks = _masks(low, weight, bits)
            out.append((fps[able][:, None] ^ masks[None, :]).ravel())
            own.append(np.repeat(index[able], len(masks)))
    yield (np.concatenate(out), np.concatenate(own)) if out else (np.zeros(0, U64), np.zeros(0, np.int64))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 the smallest node each reaches by the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (jump := label[label]) is not None and (jump != label).any():
            label = jump
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _links(block_bits: int, radius: int):
    """Within a block: variants, equal ones to links, links verified, and a spanning forest of them."""
    half = radius // 2

    def run(key: tuple, group: pa.Table) -> pa.Table:
        block = U64(key[0].as_py())
        fps = np.unique(np.concatenate([np.frombuffer(x, U64) for x in group.column("fps").to_pylist()]))
        off = (fps ^ block) & U64((1 << block_bits) - 1)
        index, left = np.arange(len(fps)), half - popcount(off).astype(np.int64)
        label = index
        for variant, own in _variants(fps ^ off, index, left, block_bits):
            order = np.argsort(variant, kind="stable")
            variant, own = variant[order], own[order]
            same = np.flatnonzero(variant[1:] == variant[:-1])
            pairs = np.unique(own[same] * len(fps) + own[same + 1])  # neighbours in a bucket chain all of it: any two there are within the radius
            a, b = pairs // len(fps), pairs % len(fps)
            keep = (a != b) & (popcount(fps[a] ^ fps[b]) <= radius)
            a, b = label[a[keep]], label[b[keep]]
            label = forest(len(fps), a, b)[label]
        linked = np.flatnonzero(label != index)
        settle()
        return pa.table([pa.array(fps[linked].view(np.int64)), pa.array(fps[label[linked]].view(np.int64))], schema=LINKS)

    return run


def block_bits(fps: DataFrame, radius: int = 4) -> int:
    """The fewest low bits, of ``BLOCK_BITS``, with which each block gets at most ``MOST`` of the distinct values ``fp``.

    A block gets the fingerprints whose low bits are within half the radius of its own, so what it gets is at most its copies times the
    fullest value of the low bits; that count is pre-aggregated, and the driver sees one number for each trial.
    """
    bits, most = BLOCK_BITS
    while bits < most:
        near = sum(comb(bits, k) for k in range(radius // 2 + 1))
        row = fps.groupBy(F.col("fp").bitwiseAND(F.lit((1 << bits) - 1)).alias("low")).agg(F.count("*").alias("n")).agg(F.max("n").alias("fullest"), F.sum("n").alias("n")).first()
        if not row["n"] or min(near * row["fullest"], row["n"]) <= MOST:
            break
        bits += 3
    return min(bits, most)


def fingerprint_links(fps: DataFrame, radius: int = 4, bits: int | None = None) -> DataFrame:
    """Links (u, v) that connect exactly the distinct values ``fp`` (longs) which chains of ``radius`` bits or fewer connect.

    ``radius`` is even, up to 4; ``bits`` are the low bits that make a block, ``block_bits`` of the data unless given.
    """
    if radius not in (0, 2, 4):
        raise ValueError("radius must be 0, 2 or 4")
    bits = bits or block_bits(fps, radius)
    return fps.select("fp").mapInArrow(_deal(bits, radius // 2), "block int, fps binary").groupBy("block").applyInArrow(_links(bits, radius), "u long, v long")


@dataclass(frozen=True)
class Bands:
    """Several fingerprints of few bits each instead of one of 64, for pairs that differ in more than 4 of 64 bits.

    Bits of two texts differ with probability ``p = arccos(2s / (1 + s)) / pi`` at a Jaccard similarity s of their shingles, so a fingerprint of
    ``bits`` finds the pair if no more than 4 of its bits differ, and ``many`` independent ones find it with the probability asked for. Fewer
    bits find more, but also more unrelated pairs: the bits follow the number of texts, so that a text meets about ``UNRELATED`` others. Fingerprints,
    and what crosses the shuffle, thus grow somewhat faster than the texts (8 of 36 bits for 10**5 texts, 15 of 44 for 10**7).
    """

    bits: int
    many: int
    most: int
    low: int
    near: int
    sure: int

    @property
    def words(self) -> int:
        return -(-self.bits * self.many // BITS)


def bands(texts: int, similarity: float, recall: float = 0.95, radius: int = 4) -> Bands:
    p = acos(2 * similarity / (1 + similarity)) / pi
    for bits in range(28, BITS + 1, 4):
        found = sum(comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(radius + 1))
        many = max(1, ceil(log(1 - recall) / log(1 - found)))
        if texts * many * sum(comb(bits, k) for k in range(radius + 1)) <= UNRELATED << bits:
            break
    low, used = 4, bits * many
    while low < 20 and texts * sum(comb(low, k) for k in range(radius // 2 + 1)) >> low > BAND_MOST:
        low += 1
    seen = bits + BITS  # what a block knows of a text: a fingerprint, and a word of the others
    spread = sqrt(seen * p * (1 - p))
    return Bands(bits, many, ceil(used * p + 5 * sqrt(used * p * (1 - p))), low, ceil(seen * p + 5 * spread), max(0, int(seen * p - 2 * spread)))


def _signatures(width: int, plan: Bands):
    """Rows (doc_id, t, text) to (doc_id, t, the words of all fingerprints)."""
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), *((f"s{k}", pa.int64()) for k in range(plan.words))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, plan.words), U64)
            for row, text in enumerate(batch.column(2)):
                hashes = shingle_hashes(text.as_py(), width)
                out[row] = [_majority(hashes if not k else mix(hashes + U64(k * 0x9E3779B97F4A7C15 % (1 << 64)))) for k in range(plan.words)]
            yield table(schema, batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in out.T))

    return run


def _deal_bands(plan: Bands, radius: int):
    """Each fingerprint, with a word of the text's other ones and the text's number, to the blocks within ``radius`` bits of its low bits; packed by
    fingerprint and block."""
    near = np.array([sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(plan.low), k)], U64)
    schema = pa.schema([("block", pa.int32()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column(0).to_numpy(zero_copy_only=False)
            words = np.stack([batch.column(k + 1).to_numpy(zero_copy_only=False).view(U64) for k in range(plan.words)], 1)
            flat = np.unpackbits(words.astype(">u8").view(np.uint8), axis=1)
            for number in range(plan.many if len(t) else 0):
                own = flat[:, number * plan.bits : (number + 1) * plan.bits].astype(U64) @ (U64(1) << np.arange(plan.bits, dtype=U64))
                other = np.ascontiguousarray(words[:, (number * plan.bits // BITS + 2) % plan.words])
                block = ((own & U64((1 << plan.low) - 1))[:, None] ^ near[None, :]).ravel()
                order = np.argsort(block, kind="stable")
                block, row = block[order], order // len(near)
                cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
                bodies = [np.concatenate([own[r], other[r], t[r].view(U64)]).tobytes() for r in np.split(row, cuts[1:])]
                yield table(schema, (block[cuts].astype(np.int64) + (number << plan.low)).astype(np.int32), pa.array(bodies, pa.binary()))

    return run


def _led(bucket: np.ndarray, own: np.ndarray, value: np.ndarray, other: np.ndarray, plan: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b) of texts that share a bucket, and which rows lead. Rows are in order of bucket and text.

    All buckets take a round together: the first row that nothing covers leads, is paired with every row of the bucket that may be similar (led
    before or not), and covers those that surely are. So a row that is no copy of a leader leads itself, and a pair is missed only if both of its texts
    are sure of other leaders in every bucket that they share. Copies take few rounds; rows that merely resemble each other take one each.
    """
    covered, leads = np.zeros(len(own), bool), np.zeros(len(own), bool)
    rows, a, b = np.arange(len(own)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(todo := rows[~covered[rows]]):
        heads = todo[np.r_[True, bucket[todo[1:]] != bucket[todo[:-1]]]]
        leads[heads] = covered[heads] = True
        at = np.minimum(np.searchsorted(bucket[heads], bucket[rows]), len(heads) - 1)
        active = bucket[heads[at]] == bucket[rows]
        rows, head = rows[active], heads[at[active]]
        away = (popcount(value[own[rows]] ^ value[own[head]]) + popcount(other[own[rows]] ^ other[own[head]])).astype(np.int64)
        covered[rows[away <= plan.sure]] = True
        some = (away <= plan.near) & (rows != head)
        a.append(own[rows[some]])
        b.append(own[head[some]])
    return np.concatenate(a), np.concatenate(b), leads


def _band_pairs(plan: Bands, radius: int):
    """Within a block pairs (u, v) of texts that share a fingerprint, or a variant of it, and may be similar."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, U64).reshape(3, -1) for x in group.column("body").to_pylist()]
        value, other, t = np.concatenate(parts, 1)
        order = np.lexsort((t, value))
        value, other, t = value[order], other[order], t[order]
        n = len(t)
        same = np.cumsum(np.r_[True, value[1:] != value[:-1]])
        u, v, leads = _led(same, np.arange(n), value, other, plan)
        pairs = [np.unique(np.minimum(u, v) * n + np.maximum(u, v))]
        lead = np.flatnonzero(leads)
        off = (value[lead] ^ U64(key[0].as_py())) & U64((1 << plan.low) - 1)
        for variant, own in _variants(value[lead] ^ off, lead, radius // 2 - popcount(off).astype(np.int64), plan.low, plan.bits):
            order = np.lexsort((own, variant))
            variant, own = variant[order], own[order]
            begins = np.r_[True, variant[1:] != variant[:-1]]
            shared = ~begins | np.r_[~begins[1:], False]  # variants that one text has are most of them
            u, v, _ = _led(np.cumsum(begins)[shared], own[shared], value, other, plan)
            pairs.append(np.unique(np.minimum(u, v) * n + np.maximum(u, v)))
        both = np.unique(np.concatenate(pairs))
        settle()
        return pa.table([pa.array(t[both // n].view(np.int64)), pa.array(t[both % n].view(np.int64))], schema=LINKS)

    return run


SHINGLES = pa.schema([("t", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def _shingle_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                part = batch.slice(k, 100)
                yield table(SHINGLES, part.column(0), [np.unique(shingle_hashes(x.as_py(), width)).view(np.int64) for x in part.column(1)])

    return run


def similar_texts(docs: DataFrame, width: int = 5, similarity: float = 0.8, recall: float = 0.95, id_col: str = "doc_id", text_col: str = "text", ws: Workspace | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: components of texts whose sets of ``width``-word shingles have a Jaccard similarity of
    ``similarity`` or more. ``fingerprint`` tells texts apart (16 hex digits of their 64-bit hash).

    Candidates come from the balls of several fingerprints (``Bands``), are ruled out by all their bits, and verified on the shingles, so no
    link is wrong; a pair at the threshold is a candidate with probability ``recall``, a closer one more surely, equal texts always. In a bucket all texts are
    paired but those that are surely copies of others there (see ``_led``), which are paired with the ones they are copies of.
    """
    ws, radius = ws or Workspace(docs.sparkSession, "simhash-texts"), 4
    rows = id_and_text(docs, id_col, text_col).withColumn("t", F.xxhash64("text")).select("doc_id", "t", "text")
    plan = bands(rows.count(), similarity, recall, radius)
    words = [f"s{k}" for k in range(plan.words)]
    prints = ws.write(rows.mapInArrow(_signatures(width, plan), "doc_id long, t long, " + ", ".join(f"{w} long" for w in words)), "prints")
    distinct = ws.write(prints.groupBy("t").agg(F.min("doc_id").alias("least"), *(F.min(w).alias(w) for w in words)), "distinct", narrow=True)
    dealt = distinct.select("t", *words).mapInArrow(_deal_bands(plan, radius // 2), "block int, body binary")
    pairs = ws.write(dealt.groupBy("block").applyInArrow(_band_pairs(plan, radius), "u long, v long").distinct(), "pairs", narrow=True)
    side = lambda of: distinct.select(F.col("t").alias(of), *(F.col(w).alias(f"{of}_{w}") for w in words))
    apart = F.lit(0)
    for w in words:
        apart = apart + F.bit_count(F.col(f"u_{w}").bitwiseXOR(F.col(f"v_{w}")))
    spare = ceil(5 * sqrt(BITS * plan.words - plan.bits * plan.many)) if BITS * plan.words > plan.bits * plan.many else 0  # bits that are in no fingerprint
    close = ws.write(pairs.join(side("u"), "u").join(side("v"), "v").where(apart <= plan.most + spare).select("u", "v"), "close", narrow=True)
    wanted = close.select(F.col("u").alias("t")).unionByName(close.select(F.col("v").alias("t"))).distinct()
    sets = rows.select("t", "text").join(ws.write(wanted, "wanted", narrow=True), "t", "left_semi").dropDuplicates(["t"]).mapInArrow(_shingle_sets(width), "t long, shingles array<bigint>")
    sets = ws.write(sets, "sets")
    both = close.join(sets.select(F.col("t").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("t").alias("v"), F.col("shingles").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    links = ws.write(both.where(common >= similarity * (F.size("a") + F.size("b") - common) - 1e-9).select("u", "v"), "links", narrow=True)
    members = components(links, ws).join(distinct.select(F.col("t").alias("node"), "least"), "node")
    members = ws.write(members, "members", narrow=True)
    roots = members.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = ws.write(members.join(roots, "root").select(F.col("node").alias("t"), "component_id"), "classes", narrow=True)
    known = distinct.join(classes, "t", "left").select("t", F.coalesce("component_id", "least").alias("component_id"))
    return prints.select("doc_id", "t").join(known, "t").select("doc_id", _hex(F.col("t")).alias("fingerprint"), "component_id")


def _hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: 16 hex digits, and the smallest id that links of fingerprints reach."""
    ws = Workspace(docs.sparkSession, "simhash")
    prints = ws.write(id_and_text(docs, id_col, text_col).mapInArrow(_fingerprints(width), "doc_id long, fp long"), "prints")
    distinct = ws.write(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct", narrow=True)
    labels = ws.write(components(fingerprint_links(distinct, radius), ws), "labels", narrow=True)
    members = ws.write(labels.join(distinct, labels.node == distinct.fp).select("fp", "root", "least"), "members", narrow=True)
    roots = ws.write(members.groupBy("root").agg(F.min("least").alias("component_id")), "roots", narrow=True)
    linked = members.join(roots, "root").select("fp", "component_id")
    classes = ws.write(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "classes", narrow=True)
    return prints.join(classes, "fp").select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, similarity: float | None = None) -> DataFrame:
    """``docs`` without the rows that a near copy with a smaller id stands for. All columns stay; rows with a null id stay.

    Near copies are what links of fingerprints connect, or, with ``similarity``, what verified similarity of texts connects. A row is
    judged by its id and fingerprint (its text's hash): it goes if its component has a smaller id. Rows that repeat an id and have one
    fingerprint are one document, so of them only one stays, that whose text has the least MD5.
    """
    ws = Workspace(docs.sparkSession, "simhash-keep")
    key, mark, row, print_ = (fresh(docs, f"simhash_{c}") for c in ("id", "text", "row", "print"))
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    if similarity is None:
        found, own = near_duplicates(docs, id_col, text_col, width, radius), hex_fingerprint(text_col, width)
    else:
        found, own = similar_texts(docs, width, similarity, id_col=id_col, text_col=text_col, ws=ws), _hex(F.xxhash64(text))
    repeated = docs.select(named(id_col).cast("long").alias(key)).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    repeated = ws.write(repeated, "repeated", narrow=True)  # ids that several rows have, usually none
    gone = ws.write(found.where("doc_id <> component_id").select(F.col("doc_id").alias(key), F.col("fingerprint").alias(print_)).distinct(), "gone", narrow=True)
    same = named(id_col).cast("long") == F.col(key)
    once = docs.join(gone.select(key).distinct(), same, "left_anti")
    if repeated.isEmpty():
        return once
    again = docs.withColumns({mark: F.md5(text), key: named(id_col).cast("long")}).join(repeated, key, "left_semi").withColumn(print_, own)
    again = ws.write(again.join(gone, [key, print_], "left_anti"), "again")
    order = Window.partitionBy(key, print_).orderBy(mark)  # rows of one id and fingerprint
    again = again.withColumn(row, F.row_number().over(order)).where(F.col(row) == 1)
    return once.join(repeated, same, "left_anti").unionByName(again.select(*(named(c) for c in docs.columns)))
