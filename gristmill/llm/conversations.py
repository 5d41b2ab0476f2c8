"""Conversation structure repair: the cheapest edits that give each conversation alternating turns, by dynamic programming over tensors.

Turns are the time axis: all conversations of a bucket of similar length take a step together, and the costs of every state after every
turn are kept, so that the edits are traced for all of them together too. States say what the repaired rows end in: nothing, a system row,
a user row, an assistant row. A conversation of any length is cut into segments; the costs from each state to each state over a segment are
a matrix, such matrices multiply, and so no task holds more of a conversation than an Arrow batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import Workspace, named, partitions, table

#: What a keep, rerole, deletion and insertion cost, and what a truncated row that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a row that is put in, or that gets the role which fits.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: The state after a kept row, by state and initial (s, u, a, other); -1 where it may not stay.
KEPT = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
#: What is left to pay at the end: a user row lacks its answer, a system row lacks both.
END = np.array([0, 2 * INSERT, INSERT, 0])
LEGAL = np.zeros((4, 4), bool)
LEGAL[0, 1] = LEGAL[1, 2] = LEGAL[2, 1] = True
NEVER = 1 << 60
ROLE = {USER: "user", ASSISTANT: "assistant"}
SPACES = " \t\n\x0b\x0c\r"
NO_FAULT, BLANK, DUPLICATE, SHORT = range(4)


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, has, t, role, text, m): rows after the seeded damage. ``c`` names the conversation (nulls are one), ``has`` and ``t`` the turn (nulls
    first), ``m`` how often the row stands there."""
    conv, turn = named(conv_col).cast("string"), named(turn_col).cast("long")
    space = F.lit(" ")
    h = F.crc32(F.concat(F.coalesce(conv, space), F.lit(":"), F.coalesce(turn.cast("string"), space)).cast("binary")) % 20
    text = F.coalesce(named(text_col).cast("string"), space)
    return rows.where(h != 0).select(
        F.coalesce(F.concat(F.lit("="), conv), F.lit("")).alias("c"), turn.isNotNull().cast("int").alias("has"), F.coalesce(turn, F.lit(0)).alias("t"),
        F.when(h == 4, "user").otherwise(F.coalesce(named(role_col).cast("string"), space)).alias("role"),
        F.when(h == 1, "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(h == 3, 2).otherwise(1).alias("m"),
    )


#: The order of a conversation's rows: by turn, ties by role and by the text's digest.
ORDER = ("c", "has", "t", "role", "digest")


def _narrow(rows: DataFrame, ws: Workspace) -> DataFrame:
    """A row for each distinct (turn, role, text) of a conversation, without the text: its count, faults, and whether its text is new there."""
    kept = F.rtrim("text", F.lit(SPACES))
    flags = rows.select("c", "has", "t", "role", F.unhex(F.sha2("text", 256)).alias("digest"), (kept == "").alias("blank"), (~F.substring(kept, -1, 1).isin(".", "!", "?")).alias("short"), "m")
    counted = ws.write(flags.groupBy(*ORDER).agg(F.any_value("blank").alias("blank"), F.any_value("short").alias("short"), F.sum("m").alias("m")), "rows")
    first = counted.groupBy("c", "role", "digest").agg(F.min(F.struct("has", "t")).alias("f")).select("c", "role", "digest", "f.has", "f.t", F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("new").isNull(), DUPLICATE).when(F.col("short"), SHORT).otherwise(NO_FAULT)
    at = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    initial = F.when((F.length("role") > 0) & (at > 0), at - 1).otherwise(3)
    joined = counted.join(first, list(ORDER), "left")  # a key for each row: a text said at a third of all turns is no hot key
    return joined.select(*ORDER, initial.cast("byte").alias("initial"), fault.cast("byte").alias("fault"), "m")


# ---- kernels


class Rows:
    """Segments of one length bucket, time-major and padded at the end. ``extra``: further copies, which go."""

    def __init__(self, initial: np.ndarray, fault: np.ndarray, m: np.ndarray, begin: np.ndarray, length: np.ndarray):
        self.steps = int(length.max())
        self.place = np.minimum(begin + np.arange(self.steps)[:, None], max(len(m) - 1, 0))
        self.there = np.arange(self.steps)[:, None] < length
        self.initial = initial[self.place]
        self.must = np.isin(fault[self.place], (BLANK, DUPLICATE))
        self.pay = np.where(fault[self.place] == SHORT, TRUNCATED, 0)
        self.extra = m[self.place] - 1

    def backward(self, end: np.ndarray) -> np.ndarray:
        """(steps + 1, segments, states, ends): the least cost from each state before each row, given costs after the last."""
        out = np.empty((self.steps + 1, *end.shape), np.int64)
        out[-1] = end
        for t in range(self.steps - 1, -1, -1):
            after = out[t + 1] + DELETE * self.extra[t][:, None, None]
            to = KEPT[:, self.initial[t]].T
            keep = np.where(to[..., None] < 0, NEVER, np.take_along_axis(after, np.maximum(to, 0)[..., None], axis=1))
            stays = np.minimum(keep, after[:, NEXT] + REROLE) + self.pay[t][:, None, None]
            row = np.minimum(after + DELETE, np.where(self.must[t][:, None, None], NEVER, stays))
            put_in = np.minimum(row, np.minimum(row[:, NEXT] + INSERT, row[:, NEXT[NEXT]] + 2 * INSERT))
            out[t] = np.where(self.there[t][:, None, None], np.minimum(put_in, NEVER), out[t + 1])
        return out

    def trace(self, costs: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows put in before each row, the first of their states, each row's edit (D, K, R; 0 beyond the end) with the state after it, all
        time-major, and the states at the end. Of the cheapest edits the ones that come first by ASCII."""
        n, every = len(entry), np.arange(len(entry))
        put_in, first = np.zeros((self.steps, n), np.int64), np.zeros((self.steps, n), np.int64)
        edit, state = np.zeros((self.steps, n), np.uint8), np.zeros((self.steps, n), np.int64)
        q = entry.copy()
        for t in range(self.steps):
            after = costs[t + 1] + DELETE * self.extra[t][:, None]
            first[t] = NEXT[q]
            todo = self.there[t].copy()
            while todo.any():
                now = costs[t][every, q]
                gone = todo & (now == after[every, q] + DELETE)
                more = todo & ~gone & (now == costs[t][every, NEXT[q]] + INSERT)
                to = KEPT[q, self.initial[t]]
                fits = todo & ~gone & ~more
                keep = fits & (to >= 0) & (now == after[every, np.maximum(to, 0)] + self.pay[t])
                change = fits & ~keep
                edit[t][gone], edit[t][keep], edit[t][change] = ord("D"), ord("K"), ord("R")
                put_in[t] += more
                q = np.where(more | change, NEXT[q], np.where(keep, to, q))
                todo = more
            state[t] = q
        return put_in, first, edit, state, q


def _buckets(length: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of segments by the power of two of their length."""
    size = np.ceil(np.log2(np.maximum(length, 1))).astype(int)
    for s in np.unique(size):
        yield np.flatnonzero(size == s)


def _solved(initial, fault, m, begin, length, end: np.ndarray, entry: np.ndarray):
    """Per row: rows put in before it, the first of their states, its edit and the state after it; per segment: the cost and the state at the end."""
    rows = len(m)
    put_in, first, edit, state = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.uint8), np.zeros(rows, np.int64)
    cost, last = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for some in _buckets(length):
        part = Rows(initial, fault, m, begin[some], length[some])
        costs = part.backward(end[some][..., None])[..., 0]
        cost[some] = costs[0][np.arange(len(some)), entry[some]]
        found = part.trace(costs, entry[some])
        at = part.place[part.there]
        for out, x in zip((put_in, first, edit, state), found, strict=False):
            out[at] = x[part.there]
        last[some] = found[-1]
    return put_in, first, edit, state, cost, last


def _matrices(initial, fault, m, begin, length) -> np.ndarray:
    """(segments, 4, 4): the least cost over a segment from each state to each state."""
    out = np.empty((len(length), 4, 4), np.int64)
    unit = np.where(np.eye(4, dtype=bool), 0, NEVER)
    for some in _buckets(length):
        out[some] = Rows(initial, fault, m, begin[some], length[some]).backward(np.broadcast_to(unit, (len(some), 4, 4)))[0]
    return out


ROW_LISTS = {"has": pa.int32(), "t": pa.int64(), "role": pa.string(), "digest": pa.binary(), "initial": pa.int8(), "fault": pa.int8(), "m": pa.int64()}
SEGMENTS = pa.schema([("c", pa.string()), ("part", pa.int32()), ("seq", pa.int64()), ("whole", pa.bool_()), *((k, pa.list_(v)) for k, v in ROW_LISTS.items()), ("matrix", pa.list_(pa.int64()))])
SEGMENTS_DDL = "c string, part int, seq long, whole boolean, has array<int>, t array<long>, role array<string>, digest array<binary>, initial array<byte>, fault array<byte>, m array<long>, matrix array<long>"


def _numbers(column: pa.Array, kind=np.int64) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(kind)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to segments: what an Arrow batch has of a conversation. The first and the last of a batch may go on beside it, so they get a matrix."""
    seq = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        codes = _numbers(pa.compute.dictionary_encode(batch.column(1)).indices)
        begin = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        length = np.diff(np.append(begin, n))
        whole = np.ones(len(begin), bool)
        whole[[0, -1]] = False
        offsets = pa.array(np.append(begin, n).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, batch.column(k + 2)) for k in range(len(ROW_LISTS))]
        initial, fault, m = (_numbers(batch.column(k)) for k in (6, 7, 8))
        edges = np.flatnonzero(~whole)
        matrices: list = [None] * len(begin)
        for k, x in zip(edges.tolist(), _matrices(initial, fault, m, begin[edges], length[edges]), strict=True):
            matrices[k] = x.reshape(-1).tolist()
        yield table(SEGMENTS, batch.column(1).take(pa.array(begin)), batch.column(0).take(pa.array(begin)), seq + np.arange(len(begin)), whole, *lists, matrices)
        seq += len(begin)


EDGES_DDL = "c string, part int, seq long, ends array<long>, shared boolean, joint boolean, last boolean"


def _ends(rows: pd.DataFrame) -> pd.DataFrame:
    """A conversation's segments in order: what each has to pay after it, and what it shares with the one before: a turn, and an illegal joint."""
    rows = rows.sort_values(["part", "seq"])
    end, ends = END.astype(np.int64), []
    for matrix in reversed(list(rows["matrix"])):
        ends.append(end.tolist())
        end = (np.asarray(matrix, np.int64).reshape(4, 4) + end).min(axis=1)
    before = rows.shift(1)
    shared = (rows["first_has"] == 1) & (before["last_has"] == 1) & (rows["first_t"] == before["last_t"])
    joint = [k > 0 and not LEGAL[int(a), int(b)] for k, (a, b) in enumerate(zip(before["last_initial"].fillna(3), rows["first_initial"], strict=True))]
    return pd.DataFrame({"c": rows["c"], "part": rows["part"], "seq": rows["seq"], "ends": ends[::-1], "shared": shared, "joint": joint, "last": np.arange(len(rows)) == len(rows) - 1})


def _flat(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(name).flatten()


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    length = _numbers(pa.compute.list_value_length(batch.column("m")))
    return (*(_numbers(_flat(batch, k)) for k in ("initial", "fault", "m")), np.cumsum(length) - length, length)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each segment at an edge the state at its end, from each state at its beginning."""
    schema = pa.schema([("c", pa.string()), ("part", pa.int32()), ("seq", pa.int64()), ("exits", pa.list_(pa.int64()))])
    for batch in batches:
        if batch.num_rows:
            initial, fault, m, begin, length = _lists(batch)
            end = np.array(batch.column("ends").to_pylist(), np.int64)
            out = [_solved(initial, fault, m, begin, length, end, np.full(len(length), q))[-1] for q in range(4)]
            yield table(schema, batch.column("c"), batch.column("part"), batch.column("seq"), np.stack(out, axis=1).tolist())


def _entries(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["part", "seq"])
    at, entry = NOTHING, []
    for exits in rows["exits"]:
        entry.append(at)
        at = int(exits[at])
    return pd.DataFrame({"c": rows["c"], "part": rows["part"], "seq": rows["seq"], "entry": entry})


REPAIRED = pa.schema(
    [("c", pa.string()), ("part", pa.int32()), ("seq", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("turns", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]
    + [("has", pa.list_(pa.int32())), ("t", pa.list_(pa.int64())), ("role", pa.list_(pa.string())), ("digest", pa.list_(pa.binary())), ("before", pa.list_(pa.string())), ("out", pa.list_(pa.string())), ("after", pa.list_(pa.string()))]
)
REPAIRED_DDL = (
    "c string, part int, seq long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, cost long, audit string,"
    " has array<int>, t array<long>, role array<string>, digest array<binary>, before array<string>, out array<string>, after array<string>"
)
#: Rows put in, by their number and the first one's state.
PUT_IN = np.array([["", "", "", ""], ["", "", "u", "a"], ["", "", "ua", "au"]], object)
TRAILING = np.array(["", "ua", "a", ""], object)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments, with what is to pay after them and the state before them, to their counts, costs and edits."""
    for batch in batches:
        if not batch.num_rows:
            continue
        initial, fault, m, begin, length = _lists(batch)
        last = _numbers(batch.column("last"), bool)
        put_in, first, edit, state, cost, at_end = _solved(initial, fault, m, begin, length, np.array(batch.column("ends").to_pylist(), np.int64), _numbers(batch.column("entry")))
        owner = np.repeat(np.arange(len(length)), length)
        count = lambda weights: np.bincount(owner, weights=weights, minlength=len(length)).astype(np.int64)
        blank = count(np.where(fault == BLANK, m, 0))
        duplicate = count(np.where(fault == DUPLICATE, m, np.where(fault == BLANK, 0, m - 1)))
        meets = np.append(False, owner[1:] == owner[:-1])  # a row with one before it in its segment
        left = np.append(initial[:1], initial[:-1])
        illegal = count(m - 1 + (meets & ~LEGAL[left, initial]))
        has, t = _numbers(_flat(batch, "has")), _numbers(_flat(batch, "t"))
        turns = count((has == 1) & ~(meets & (np.append(0, has[:-1]) == 1) & (t == np.append(0, t[:-1]))))
        low, high = np.full(len(length), np.iinfo(np.int64).max), np.full(len(length), np.iinfo(np.int64).min)
        np.minimum.at(low, owner[has == 1], t[has == 1])
        np.maximum.at(high, owner[has == 1], t[has == 1])
        some = low <= high
        # the audit's letters: rows put in before, the edit, further copies deleted
        letters = np.stack([np.full(len(m), ord("I"), np.uint8), edit, np.full(len(m), ord("D"), np.uint8)], axis=1).reshape(-1)
        each = np.stack([put_in, np.ones(len(m), np.int64), m - 1], axis=1)
        body = np.repeat(letters, each.reshape(-1)).tobytes().decode("ascii")
        ends = np.cumsum(count(each.sum(axis=1)))
        audits = [body[a:b] + "I" * len(TRAILING[q]) * int(z) for a, b, q, z in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), at_end.tolist(), last.tolist(), strict=True)]
        roles = np.array(_flat(batch, "role").to_pylist(), object)
        new = np.array([None, None, ROLE[USER], ROLE[ASSISTANT]], object)[state]
        out = np.where(edit == ord("K"), roles, np.where(edit == ord("R"), new, None))
        after = np.full(len(m), "", object)
        tail = (begin + length - 1)[last]
        after[tail] = TRAILING[at_end[last]]
        offsets = pa.array(np.append(begin, len(m)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (*(_flat(batch, k) for k in ("has", "t", "role", "digest")), *(pa.array(list(x), pa.string()) for x in (PUT_IN[put_in, first], out, after)))]
        masked = lambda x: pa.array(x, pa.int64(), mask=~some)
        yield table(REPAIRED, batch.column("c"), batch.column("part"), batch.column("seq"), blank, duplicate, count(fault == SHORT), illegal, turns, masked(low), masked(high), cost, audits, *lists)


HASHES = pa.schema([("c", pa.string()), ("repaired_sha256", pa.string())])
_PUT = {"u": b"user:", "a": b"assistant:"}


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order (conversations whole) to the digest of each conversation's repaired lines, a line at a time."""
    at = key = digest = None
    lines = 0
    for batch in batches:
        done: tuple[list, list] = ([], [])
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            c, before, out, after, text = row[0], *row[5:]
            if c != at:
                if at is not None:
                    done[0].append(at)
                    done[1].append(digest.hexdigest())
                at, key, digest, lines = c, None, hashlib.sha256(), 0
            if row[:5] == key:  # a repeated row of the source
                continue
            key = row[:5]
            own = [*map(_PUT.get, before), *([f"{out}:{text}".encode()] if out is not None else []), *map(_PUT.get, after)]
            for line in own:
                digest.update(b"\n" + line if lines else line)
                lines += 1
        if done[0]:
            yield table(HASHES, *done)
    if at is not None:
        yield table(HASHES, [at], [digest.hexdigest()])


def repair_report(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after seeded damage.

    The damage (by the crc32 of ``conv_id:turn``; a null there, in a role or in a text is one space) and the edits are those of the module's
    costs. Rows are in order of turn, nulls first; rows of one turn by role, then by the SHA-256 of their text (the order of ties is free).
    The first letter of a role counts, an empty role has none and fits nowhere. Rows alike in turn, role and text are one with a count: the
    first is judged, the others are duplicates (or all are blank). A null conv_id is a conversation. One without rows after the damage has
    zeros, an empty audit and the digest of nothing; an empty table gives no rows. Other columns are not read, whatever their names.

    Texts cross one shuffle, at the end: everything before works on digests. Rows are range-sorted, so that a conversation with a third of all rows lies
    in many partitions, and cut into segments of an Arrow batch at most; only segments at the edges of a batch (two in some thousand rows) meet by
    conversation, as matrices of 16 numbers, to learn what comes after and before them. The digest of a conversation's repaired text is
    one pass over its lines in order, by the definition of SHA-256: one task streams them and keeps nothing but the digest's state, and its audit is one
    string.
    """
    spark = conversations.sparkSession
    ws = Workspace(spark, "conversations")
    count = partitions(spark)
    rows = damaged(conversations, conv_col, turn_col, role_col, text_col)
    narrow = ws.write(_narrow(rows, ws), "narrow")
    ordered = narrow.repartitionByRange(count, *ORDER).sortWithinPartitions(*ORDER).select(F.spark_partition_id().alias("part"), *ORDER, "initial", "fault", "m")
    segments = ws.write(ordered.mapInArrow(_segments, SEGMENTS_DDL), "segments")
    edge = segments.where("not whole")
    facts = edge.select("c", "part", "seq", "matrix", *(F.element_at(k, i).alias(f"{n}_{k}") for n, i in (("first", 1), ("last", -1)) for k in ("has", "t", "initial")))
    ends = ws.write(facts.groupBy("c").applyInPandas(_ends, EDGES_DDL), "ends")
    keys = ["c", "part", "seq"]
    exits = edge.join(ends.select(*keys, "ends"), keys).mapInArrow(_exits, "c string, part int, seq long, exits array<long>")
    entries = exits.groupBy("c").applyInPandas(_entries, "c string, part int, seq long, entry int")
    known = ws.write(ends.join(entries, keys), "known")
    inner = segments.join(known, keys, "left").withColumns({"ends": F.coalesce("ends", F.array(*(F.lit(int(x)).cast("long") for x in END))), "entry": F.coalesce("entry", F.lit(NOTHING)), "last": F.coalesce("last", F.lit(True))})
    repaired = ws.write(inner.select("c", "part", "seq", "has", "t", "role", "digest", "initial", "fault", "m", "ends", "entry", "last").mapInArrow(_repaired, REPAIRED_DDL), "repaired")
    ws.drop("rows", "narrow", "segments")

    corrected = repaired.drop("has", "t", "role", "digest", "before", "out", "after").join(known.select(*keys, "shared", "joint", "entry"), keys, "left")
    place = F.struct("part", "seq")
    sums = corrected.groupBy("c").agg(
        *(F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated")), F.sum(F.col("illegal") + F.coalesce("joint", F.lit(False)).cast("int")).alias("illegal"),
        F.sum(F.col("turns") - F.coalesce("shared", F.lit(False)).cast("int")).alias("turns"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min_by("cost", place).alias("cost"), F.array_sort(F.collect_list(F.struct("part", "seq", "audit"))).alias("audits"),
    )
    sums = sums.select("c", "blank", "duplicate", "truncated", "illegal", "cost", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps"), F.array_join(F.transform("audits", lambda x: x["audit"]), "").alias("audit"))

    lines = repaired.select("c", F.explode(F.arrays_zip("has", "t", "role", "digest", "before", "out", "after")).alias("r")).select("c", "r.*")
    lines = lines.where("out is not null or before <> '' or after <> ''").repartition(count, "c")
    texts = rows.withColumn("digest", F.unhex(F.sha2("text", 256))).select(*ORDER, "text").repartition(count, "c")
    said = lines.join(texts, list(ORDER)).sortWithinPartitions(*ORDER).select(*ORDER, "before", "out", "after", "text")
    digests = said.mapInArrow(_hashed, "c string, repaired_sha256 string")

    named_c = F.coalesce(F.concat(F.lit("="), named(conv_col).cast("string")), F.lit(""))
    every = conversations.select(named_c.alias("c"), named(conv_col).alias("conv_id")).groupBy("c").agg(F.any_value("conv_id").alias("conv_id"))
    zero = lambda k: F.coalesce(k, F.lit(0)).cast("long").alias(k)
    empty = hashlib.sha256(b"").hexdigest()
    whole = every.join(sums, "c", "left").join(digests, "c", "left")
    return whole.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
