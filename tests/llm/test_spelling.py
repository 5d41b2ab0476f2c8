"""Spelling variants against all neighbours of each word by brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from gristmill.llm import queries
from gristmill.llm.spelling import _checksums, _deletions, _met, spelling_variants
from gristmill.session import load

SF = "/root/testdata/sf0.001"
LETTERS = [chr(x) for x in (*range(0x61, 0x7B), *range(0xC0, 0x100))]


def plain(rows, least_length=7, least_count=2, factor=10, modulus=31):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            counts[word if h % modulus else word[: h % len(word)] + word[h % len(word) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    near, form = {}, {}
    for w in counts:
        shorter = {w[:k] + w[k + 1 :] for k in range(len(w))}
        other = {w[:k] + x + w[k + 1 :] for k in range(len(w)) for x in LETTERS} | {w[:k] + x + w[k:] for k in range(len(w) + 1) for x in LETTERS}
        near[w] = [x for x in (shorter | other) - {w} if x in counts]
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= factor * counts[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query_on_the_whole_table(spark):
    docs = load(spark, SF, "documents")
    assert rows_of(queries.queries()["op11_spelling_variants"](spark, SF)) == plain([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()])


def test_chains_ties_long_words_and_edges(spark, docs):
    rng = random.Random(5)
    chain = " ".join(["abcdefgh"] * 4000 + ["abcdefg"] * 300 + ["abcdefx"] * 25 + ["abcdxfx"] * 2)
    alike = " ".join("".join(rng.choice("ab") for _ in range(rng.randint(6, 9))) for _ in range(3000))
    long = "aab" * 70
    rows = [
        (1, chain), (2, alike), (3, f"{long} {long} {long}a {long}a {long[:-1]} {long[:-1]}"), (4, None), (5, ""), (6, "ÀÉÎõü×÷é ÀÉÎõü×÷é àÉÎõü×÷é àÉÎõü×÷é 日本語 ÀÉÎõü×÷é"),
        (None, "Nullable NULLABLE nullables"), (7, alike), (7, alike), (8, " ".join("a" * n for n in (200, 200, 201, 201))),
    ]
    got = rows_of(spelling_variants(docs(rows, extra=True)))
    assert got == plain(rows)
    assert {r[0]: r[2] for r in got}["abcdxfx"] == "abcdefgh"
    again = plain(rows, 6, 3, 2, 5)
    assert rows_of(spelling_variants(docs(rows), 6, 3, 2, 5)) == again


def test_no_rows(spark, docs):
    assert spelling_variants(docs([(1, None), (2, "short")])).count() == 0
    assert spelling_variants(docs([(1, "x")]).limit(0)).count() == 0


def test_checksums_continue():
    data = np.frombuffer(("word" * 40).encode(), np.uint8)
    start, end = np.array([0, 3, 5, 0]), np.array([4, 3, 100, 160])
    before = np.array([zlib.crc32(x) for x in (b"7:", b":", b"12345:", b"-3:")], np.uint32)
    assert _checksums(before, data, start, end).tolist() == [zlib.crc32(data[a:b].tobytes(), int(p)) for a, b, p in zip(start, end, before, strict=True)]


def test_keys_are_those_of_the_strings():
    words = ["", "a", "aa", "abé", "éé×", "hello", "world"]
    keys = {}
    for key, place, own in _deletions(pa.array(words), np.arange(len(words))):
        for k, p, i in zip(key.tolist(), place.tolist(), own.tolist(), strict=True):
            w = words[i]
            left = w if p < 0 else w[: p >> 1] + w[(p >> 1) + 1 :]
            assert keys.setdefault(left, k) == k
            assert p < 0 or p % 2 == int((p >> 1) > 0 and w[(p >> 1) - 1] == w[p >> 1])
    assert len(set(keys.values())) == len(keys)


def test_words_that_share_a_key_by_chance_all_meet():
    key = np.zeros(5, np.int64)
    pairs = {(int(a), int(b)) for x, y in _met(key, np.array([-1, -1, 0, 0, 2], np.int32), np.arange(5)) for a, b in zip(x, y, strict=True)}
    assert pairs == {(0, 2), (0, 3), (0, 4), (1, 2), (1, 3), (1, 4), (2, 3)}
