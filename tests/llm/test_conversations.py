"""Repair of conversations against a search of all cheapest edits, row by row."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from gristmill.llm import queries
from gristmill.llm.conversations import repair_report
from gristmill.session import load

SF = "/root/testdata/sf0.001"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
DDL = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def after_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out[conv] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    return out


def cheapest(rows, faults):
    """(cost, audit, repaired rows) of least cost, then least audit: a best-first search over edits, one at a time."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, state, out = heapq.heappop(heap)
        if k == len(rows) and state in ("", "a"):
            return cost, audit, out
        if (k, state) in seen:
            continue
        seen.add((k, state))
        fits = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for x in fits.replace("s", ""):
            heapq.heappush(heap, (cost + 2, audit + "I", k, x, (*out, ({"u": "user", "a": "assistant"}[x], ""))))
        if k == len(rows):
            continue
        _, role, text = rows[k]
        heapq.heappush(heap, (cost + 3, audit + "D", k + 1, state, out))
        if faults[k] not in ("blank", "duplicate"):
            pay = faults[k] == "truncated"
            if role[:1] and role[:1] in fits:
                heapq.heappush(heap, (cost + pay, audit + "K", k + 1, role[:1], (*out, (role, text))))
            for x in fits.replace("s", ""):
                heapq.heappush(heap, (cost + 2 + pay, audit + "R", k + 1, x, (*out, ({"u": "user", "a": "assistant"}[x], text))))


def plain(table):
    out = []
    for conv, rows in after_damage(table).items():
        faults, seen = [], set()
        for _, role, text in rows:
            body = text.rstrip(SPACE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[0] for r in rows if r[0] is not None]
        cost, audit, kept = cheapest(rows, faults)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=str)


def rows_of(df):
    assert set(df.columns) == set(COLUMNS)
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in load(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.queries()["op12_conversation_repair"](spark, SF)) == plain(rows)


def made(rng, conversations, most):
    roles = ["user", "assistant", "system", "tool", "ufo", "", None, "agent"]
    rows = []
    for c in conversations:
        for _ in range(rng.randint(1, most)):
            turn = rng.choice([None, *range(-2, most)])
            rows.append((c, turn, rng.choice(roles if rng.random() < 0.4 else roles[:2]), rng.choice(["Yes.", "No!", "What?", "cut", " \t\n", "", None, "Long. text \x0b", "x.\xa0", f"t{rng.random():.2f}."])))
    return rows


@pytest.mark.parametrize("batch", [10_000, 7])
def test_all_kinds_of_rows(spark, batch):
    rng = random.Random(batch)
    rows = made(rng, [None, *range(150)], 9)
    rows += [rows[k] for k in range(0, len(rows), 5)]  # repeated rows
    df = spark.createDataFrame(rows, DDL).selectExpr("*", "1 as c", "2 as has", "3 as t", "4 as m", "'x' as digest")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))  # segments of seven rows: conversations lie in several
    try:
        assert rows_of(repair_report(df)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_long_conversation_over_many_segments(spark):
    rng = random.Random(9)
    rows = [(1, k // 2, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Ok.", "cut", f"n{k}.", f"n{k}"])) for k in range(3000)] + made(rng, range(2, 8), 5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert rows_of(repair_report(spark.createDataFrame(rows, DDL).repartition(5))) == plain(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_nothing_left_and_no_rows(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert rows_of(repair_report(spark.createDataFrame([(gone, 0, "user", "Hi.")], DDL))) == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
    assert repair_report(spark.createDataFrame([], DDL)).count() == 0
