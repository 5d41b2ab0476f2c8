"""Stratified splits of multi-label rows with exact sizes (after iterative stratification, Sechidis et al. 2011), planned on counts.

Rows with the same set of labels are alike, so the plan is made for sets and their counts, which are as many as labels allow and not as rows are.
Rows then find their split by the rank of a seeded hash within their set.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.constants import DIMENSIONS

#: The split whose rows are left out.
DROP = "drop"
#: Hashes are ranked by so many leading bits, and beyond them only where a split ends.
BITS = 12


def exact_sizes(sizes: Mapping[str, float], n: int) -> list[int]:
    """Rows of each split. Whole numbers are taken as they are and must add up to ``n``; shares are rounded half to even, the last takes the rest."""
    if all(isinstance(x, int) for x in sizes.values()):
        if sum(sizes.values()) != n:
            raise ValueError(f"sizes {dict(sizes)} do not add up to {n} rows")
        return list(sizes.values())
    counts = [round(n * x) for x in list(sizes.values())[:-1]]
    while sum(counts) > n:
        counts[counts.index(max(counts))] -= 1
    return [*counts, n - sum(counts)]


def dealt(n: int, lacking: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many of ``n`` rows each split gets if one after the other goes to the split that lacks most, then to that with most room: all that are
    above one level at once, and the few on the level one by one."""
    out = np.zeros(len(room), np.int64)
    low, high = float((lacking - room).min()) - n - 1, float(lacking.max()) + 1
    above = lambda level: np.clip(np.ceil(lacking - level), 0, room).astype(np.int64)
    for _ in range(80):
        level = (low + high) / 2
        if above(level).sum() <= n:
            high, out = level, above(level)
        else:
            low = level
    while out.sum() < n:
        out[max((s for s in range(len(room)) if out[s] < room[s]), key=lambda s: (lacking[s] - out[s], room[s] - out[s], -s))] += 1
    return out


def shared_out(counts: Sequence[int], shares: np.ndarray, have: Sequence[Sequence[int]], lacking: np.ndarray, want: np.ndarray) -> np.ndarray:
    """``counts`` by splits, in whole numbers with the rows' and the splits' sums exact (the latter are ``shares``): each count in proportion, and what rounding leaves one by
    one to the split that, of all its labels (``have``), lacks the largest part of what it wants. ``lacking`` is brought up to date."""
    given = np.array([n * shares // max(int(shares.sum()), 1) for n in counts], np.int64).reshape(len(counts), len(shares))
    rest = shares - given.sum(axis=0)
    for i, own in enumerate(have):
        lacking[own] -= given[i]
    for i, (n, own) in enumerate(zip(counts, have, strict=True)):
        for _ in range(n - int(given[i].sum())):
            need = (lacking[own] / want[own]).sum(axis=0)
            s = max(np.flatnonzero(rest > 0), key=lambda s: (need[s], rest[s], -s))
            given[i, s] += 1
            rest[s] -= 1
            lacking[own, s] -= 1
    return given


def evened(given: np.ndarray, have: Sequence[Sequence[int]], want: np.ndarray) -> np.ndarray:
    """``given`` after exchanges of a row between two splits, each of which brings the labels' counts nearer to what is wanted (by sums of squares)."""
    labels, splits = want.shape
    index = np.full((len(have), max(map(len, have), default=0)), labels)
    for i, own in enumerate(have):
        index[i, : len(own)] = own
    if not index.size:
        return given
    off = np.zeros((labels + 1, splits))  # the last row pads
    off[:labels] = -want
    for i, own in enumerate(have):
        off[own] += given[i]
    size = (index < labels).sum(axis=1)

    def cost(s: int, t: int) -> np.ndarray:
        """Of each set, what half the sum grows by if one of its rows goes from ``s`` to ``t``."""
        step = off[:, t] - off[:, s]
        step[labels] = 0
        return np.where(given[:, s] > 0, step[index].sum(axis=1) + size, np.inf)

    better = True
    while better:
        better = False
        for s in range(splits):
            for t in range(s + 1, splits):
                while True:
                    there, back = cost(s, t), cost(t, s)
                    i, j = int(there.argmin()), int(back.argmin())
                    both = 2 * len(set(have[i]) & set(have[j]))  # labels that both have stay as they are
                    if i == j or not there[i] + back[j] - both < -1e-9:
                        break
                    for row, a, b in ((i, s, t), (j, t, s)):
                        given[row, a] -= 1
                        given[row, b] += 1
                        off[have[row], a] -= 1
                        off[have[row], b] += 1
                    better = True
    return given


def plan(sets: Sequence[tuple[Sequence[str], int]], sizes: Sequence[int]) -> np.ndarray:
    """(sets, splits): how many rows of each set of labels go to each split.

    Again and again the label with the fewest rows left is dealt out, its rows to the splits that lack it most; the sets among them share
    them in proportion. Rows without labels fill what is left. Then rows are exchanged while that evens out the labels dealt out last.
    """
    room = np.array(sizes, np.int64)
    n = int(room.sum())
    if sum(c for _, c in sets) != n:
        raise ValueError(f"sizes {list(sizes)} do not add up to {sum(c for _, c in sets)} rows")
    labels = sorted({x for own, _ in sets for x in own})
    number = {x: k for k, x in enumerate(labels)}
    have = [[number[x] for x in dict.fromkeys(own)] for own, _ in sets]
    of: list[list[int]] = [[] for _ in labels]
    for i, own in enumerate(have):
        for x in own:
            of[x].append(i)
    left = np.array([sum(sets[i][1] for i in own) for own in of], float)
    lacking = np.outer(left, room / max(n, 1))
    want = np.maximum(lacking, 1e-9)
    out, done = np.zeros((len(sets), len(room)), np.int64), np.zeros(len(sets), bool)

    def give(some: list[int], shares: np.ndarray) -> None:
        nonlocal room
        given = shared_out([sets[i][1] for i in some], shares, [have[i] for i in some], lacking, want)
        for i, own in zip(some, given, strict=True):
            out[i], done[i] = own, True
            left[have[i]] -= sets[i][1]
        room = room - shares

    while (left > 0).any():
        label = int(np.argmin(np.where(left > 0, left, np.inf)))
        give([i for i in of[label] if not done[i]], dealt(int(left[label]), lacking[label], room))
    give([i for i in range(len(sets)) if not done[i]], room)
    return evened(out, have, want)


def score_labels(dimensions: Iterable[str] = DIMENSIONS) -> Column:
    """The labels of a row: a dimension and its score, a null one included."""
    return F.array(*(F.concat(F.lit(f"{d}="), F.coalesce(F.col(d).cast("string"), F.lit("null"))) for d in dimensions))


def stratified_split(df: DataFrame, sizes: Mapping[str, float], group: str = "language", key: str = "doc_id", seed: int = 42, labels: Column | None = None) -> DataFrame:
    """``df`` with its split in each group. ``sizes``: rows of each split (whole numbers that add up to the group's), or shares; ``drop`` is left out.
    ``labels``: an array of strings for each row, by default of its scores.

    The driver plans on the count of each group's label sets (7,776 for five scores of six values), whatever the rows. A set's rows are in
    the order of a seeded hash of the key: counts by the hash's leading bits show in which step each split ends, rows of other steps have
    their split by that alone, and only rows of these steps are ranked, so no task sorts a group or a set. Repeated keys, which no order
    tells apart, are split anyhow.
    """
    names = list(sizes)
    sets = F.array_sort(F.array_distinct(F.coalesce(labels if labels is not None else score_labels(), F.array().cast("array<string>"))))
    hashed = F.xxhash64(F.lit(seed), F.col(key))
    rows = df.withColumns({"__set": F.xxhash64(sets), "__labels": sets, "__hash": hashed, "__step": F.shiftrightunsigned(hashed, 64 - BITS).cast("int")})
    counts = rows.groupBy(group, "__labels").agg(F.count("*").alias("n")).collect()
    by_group: dict = {}
    for r in sorted(counts, key=lambda r: (str(r[group]), r["__labels"])):
        by_group.setdefault(r[group], []).append((tuple(r["__labels"]), r["n"]))
    bounds = []
    for name, own in by_group.items():
        for (labels_, _), given in zip(own, plan(own, exact_sizes(sizes, sum(n for _, n in own))), strict=True):
            bounds.append((name, list(labels_), [int(x) for x in np.cumsum(given)[:-1]]))
    schema = f"__group {df.schema[group].dataType.simpleString()}, __planned array<string>, __bounds array<long>"
    planned = df.sparkSession.createDataFrame(bounds, schema)
    same = F.col(group).eqNullSafe(F.col("__group")) & (F.col("__labels") == F.col("__planned"))

    steps = rows.groupBy(group, "__labels", "__step").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group, "__labels").orderBy("__step").rowsBetween(Window.unboundedPreceding, -1)  # 4096 steps at most
    steps = steps.withColumn("__from", F.coalesce(F.sum("__n").over(before), F.lit(0))).join(planned, same)
    # of each bound the step in which it lies, and how many rows of that step are below it
    cut = lambda b: F.struct(F.col("__step").alias("step"), (b - F.col("__from")).alias("below"))
    inside = F.filter(F.transform("__bounds", lambda b, k: F.struct(k.alias("k"), b.alias("b"))), lambda x: (x["b"] >= F.col("__from")) & (x["b"] < F.col("__from") + F.col("__n")))
    found = steps.select("__group", "__planned", F.explode(F.transform(inside, lambda x: F.struct(x["k"].alias("k"), cut(x["b"]).alias("cut")))).alias("x"))
    cuts = found.groupBy("__group", "__planned").agg(F.collect_list("x.cut").alias("__cuts"))  # as many as splits; a bound at the end of a set cuts nothing

    marked = rows.join(cuts, same, "left").withColumn("__cuts", F.coalesce("__cuts", F.array().cast("array<struct<step:int,below:bigint>>"))).drop("__group", "__planned")
    lower = F.size(F.filter("__cuts", lambda c: c["step"] < F.col("__step")))
    here = F.exists("__cuts", lambda c: c["step"] == F.col("__step"))
    rank = F.row_number().over(Window.partitionBy(group, "__labels", "__step").orderBy("__hash", key)) - 1  # one step of a set
    own = F.size(F.filter("__cuts", lambda c: (c["step"] == F.col("__step")) & (c["below"] <= F.col("__rank"))))
    away = marked.where(~here).withColumn("__split", lower)
    near = marked.where(here).withColumn("__rank", rank).withColumn("__split", lower + own).drop("__rank")
    named = F.element_at(F.array(*map(F.lit, names)), F.col("__split") + 1)
    out = away.unionByName(near).withColumn("split", named).select(*(F.col(f"`{c}`") for c in df.columns), "split")
    return out.where(F.col("split") != DROP)
