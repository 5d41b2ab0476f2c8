import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from gristmill.llm import simhash, warc
from gristmill.llm.common import Workspace
from gristmill.llm.components import components
from pyspark.sql import functions as F

LONG = "<p>é</p>" * 50
PAGES = [(1, "http://a/ b\n", LONG), (2, None, LONG), (3, "http://c", "short"), (4, "http://d", "short"), (5, "u", None), (6, "u", ""), (7, "u", "z" * 99), (8, "u", "z" * 99), (9, "u", "z" * 100), (10, "u", "z" * 100), (None, "n", LONG), (11, "x", "big" * 40_000), (12, "twice", "t" * 200), (12, "twice", "t" * 200)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("k", "digest", "mark", "large", "shard")}).repartition(3)


def test_archives(spark):
    got = sorted((tuple(r) for r in warc.archive_round_trip(pages(spark), roll_bytes=2000).collect()), key=str)
    want = []
    first = {}
    for i, _, h in sorted((p for p in PAGES if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(h or "", i)
    seen = set()
    for i, _, h in PAGES:
        raw = (h or "").encode()
        revisit = len(raw) >= 100 and (i is None or first[h] < i or (i, h) in seen)
        seen.add((i, h))
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.archive_round_trip(pages(spark, [])).count() == 0


def test_archives_are_the_same_bytes(spark, tmp_path):
    import json

    manifests = []
    for k in range(2):
        folder = f"file://{tmp_path}/{k}"
        warc.write_archives(pages(spark, PAGES[::-1] if k else PAGES).coalesce(1 + k), folder, roll_bytes=2000)
        manifests.append(json.loads((tmp_path / str(k) / "manifest.json").read_text()))
        assert sorted(p.name for p in (tmp_path / str(k)).iterdir()) == sorted([*(f["name"] for f in manifests[-1]["files"]), "manifest.json"])
    assert manifests[0] == manifests[1] and len(manifests[0]["files"]) > 2
    name = manifests[0]["files"][0]["name"]
    path = tmp_path / "0" / name
    path.write_bytes(path.read_bytes()[:-20])
    with pytest.raises(Exception):
        warc.read_archives(spark, f"file://{tmp_path}/0").collect()


def plain_fingerprint(text, width=4):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_near_duplicates_against_all_pairs(spark, docs):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 30, 300]))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words).upper()
            rows.append((len(rows) * 7 % 97 + 3, " ".join(copy)))
    rows += [(200, None), (201, ""), (202, " \t"), (None, rows[0][1]), (203, "É é A"), (203, "É é a"), (204, "x " * 20_000)]
    prints = [plain_fingerprint(t) for _, t in rows]
    near = np.array([[(a ^ b).bit_count() <= 4 for b in prints] for a in prints])
    label = simhash.forest(len(rows), *np.nonzero(near))
    want = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        want.append((i, f"{prints[k]:016x}", min(ids) if ids else None))
    got = simhash.near_duplicates(docs(rows, extra=True))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    kept = simhash.keep_one(docs(rows, extra=True), width=4)
    stay = [str(i) for i, _, c in want if i is None] + [str(i) for i, _ in {(i, f) for i, f, c in want if i is not None and c == i}]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(stay)
    assert simhash.near_duplicates(docs([])).count() == 0


def test_rows_that_repeat_an_id_are_judged_one_by_one(docs):
    near, other = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, near), (2, near), (2, other), (3, "thirteen fourteen"), (3, "thirteen fourteen"), (None, near)]
    kept = simhash.keep_one(docs(rows, extra=True))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, near), (2, other), (3, "thirteen fourteen"), (None, near)], key=str)
    assert kept.columns == docs(rows, extra=True).columns


def shingle_set(text, width=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def test_texts_of_similar_shingles(spark, docs):
    rng = random.Random(21)
    words = [f"v{k}" for k in range(500)]
    rows = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([40, 200, 500]))]
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 40)):
                copy[rng.randrange(len(copy))] = rng.choice(words).upper()
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, " \t"), (None, rows[0][1]), (1003, "One two"), (1004, "one  TWO"), (1005, "z " * 20_000), (2, rows[8][1]), (2, rows[8][1])]
    sets = [shingle_set(t) for _, t in rows]
    near = np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    label = simhash.forest(len(rows), *np.nonzero(near))
    want = {k: min((rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None)) for k in range(len(rows))}
    got = {}
    for r in simhash.similar_texts(docs(rows, extra=True)).collect():
        got.setdefault((r["doc_id"], r["fingerprint"]), r["component_id"])
    by_row = {}
    marks = {r["text"]: r["m"] for r in docs(rows).select("text", F.lower(F.lpad(F.hex(F.xxhash64(F.coalesce("text", F.lit("")))), 16, "0")).alias("m")).distinct().collect()}
    for k, (i, t) in enumerate(rows):
        by_row[k] = got[i, marks[t]]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if near[a, b] and sets[a] != sets[b]]
    found = sum(by_row[a] == by_row[b] for a, b in pairs)
    assert len(pairs) > 150 and found >= 0.9 * len(pairs)  # candidates are found by chance, more surely the closer they are
    assert all(by_row[a] == by_row[b] for a in range(len(rows)) for b in range(a) if sets[a] == sets[b])
    assert all(want[k] <= by_row[k] for k in by_row)  # verified: nothing is joined that isn't connected
    same = {}
    for k, c in by_row.items():
        same.setdefault(c, set()).add(int(label[k]))
    assert all(len(x) == 1 for x in same.values())
    kept = simhash.keep_one(docs(rows, extra=True), width=5, similarity=0.8)
    assert kept.columns == docs(rows, extra=True).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([i for i, c in {(rows[k][0], c) for k, c in by_row.items()} if i is None or i == c])
    assert simhash.similar_texts(docs([])).count() == 0 and simhash.keep_one(docs([]), similarity=0.8).count() == 0


def test_bands_find_what_they_promise():
    for n, s in ((10**4, 0.8), (10**6, 0.8), (10**7, 0.9)):
        plan = simhash.bands(n, s)
        p = np.arccos(2 * s / (1 + s)) / np.pi
        rng = np.random.default_rng(0)
        apart = rng.binomial(plan.bits, p, (20_000, plan.many))
        assert (apart <= 4).any(1).mean() > 0.94 and (apart.sum(1) <= plan.most).mean() > 0.999


def test_blocks_follow_the_data(spark, monkeypatch):
    rng = random.Random(2)
    spread = spark.createDataFrame([(rng.getrandbits(64) - (1 << 63),) for _ in range(3000)], "fp long")
    tight = spark.createDataFrame([(k << 8,) for k in range(3000)], "fp long")  # one value of the low bits
    assert simhash.block_bits(spread) == 8
    monkeypatch.setattr(simhash, "MOST", 400)
    assert 8 < simhash.block_bits(spread) < 26
    monkeypatch.setattr(simhash, "MOST", 10)
    assert simhash.block_bits(tight) == 26
    assert simhash.block_bits(spread.limit(0)) == 8


@pytest.mark.parametrize("part,bits", [(1 << 21, None), (3000, 8), (3000, 14)])
def test_balls_miss_no_link(spark, monkeypatch, part, bits):
    rng = random.Random(1)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values):
        for _ in range(3):
            x = v
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
            values.add(x)
    fps = np.array(sorted(values), np.uint64)
    monkeypatch.setattr(simhash, "PART", part)
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    links = simhash.fingerprint_links(df, bits=bits).collect()
    index = {int(v): k for k, v in enumerate(fps.view(np.int64))}
    got = simhash.forest(len(fps), np.array([index[r["u"]] for r in links]), np.array([index[r["v"]] for r in links]))
    d = np.bitwise_count(fps[:, None] ^ fps[None, :])
    assert (got == simhash.forest(len(fps), *np.nonzero((d <= 4) & (d > 0)))).all()


def test_components(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(8, 60)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark, "test")).collect()}
    label = simhash.forest(400, *np.array(edges).T)
    assert got == {n: label[n] for e in edges if e[0] != e[1] for n in e}
    assert components(spark.createDataFrame([], "u long, v long"), Workspace(spark, "test")).count() == 0


def jaccard(a, b):
    return len(a & b) / len(a | b)


def shingles(text, width=5):
    w = text.split()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}


@pytest.mark.parametrize("members", [600])
def test_pairs_within_a_family_of_looser_relatives_are_linked(spark, docs, members):
    """Each text of a family has a near copy, and all resemble each other below the threshold."""
    rng = random.Random(members)
    word = lambda: f"w{rng.randint(0, 99999)}"
    base = [word() for _ in range(300)]
    rows = []
    for k in range(members):
        own = [word() if rng.random() < 0.03 else w for w in base]
        copy = list(own)
        for at in rng.sample(range(300), 4):
            copy[at] = word()
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(copy))]
    sets = [shingles(t) for _, t in rows[:60]]
    assert all(jaccard(sets[2 * k], sets[2 * k + 1]) >= 0.8 for k in range(30)) and max(jaccard(sets[0], x) for x in sets[2:]) < 0.8
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(docs(rows), 5, 0.8).collect()}
    linked = sum(found[2 * k + 1] == found[2 * k] for k in range(members))
    assert linked >= 0.98 * members
    apart = len({found[2 * k] for k in range(members)})
    assert apart > 0.5 * members  # no link is wrong


def test_leaders_pair_what_may_be_similar():
    plan = simhash.bands(10**5, 0.8)
    value = np.array([0, 1, (1 << 20) - 1, (1 << 20) - 2, 0], np.uint64)
    other = np.array([0, 3, (1 << 30) - 1, (1 << 30) - 1, 1], np.uint64)
    a, b, leads = simhash._led(np.array([1, 1, 1, 1, 2]), np.arange(5), value, other, plan)
    assert {frozenset(x) for x in zip(a.tolist(), b.tolist(), strict=True)} == {frozenset((0, 1)), frozenset((2, 3))}
    assert leads.tolist() == [True, False, True, False, True]
