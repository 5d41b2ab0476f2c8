import hashlib
import random

import pytest
from gristmill.llm import line_dedup, substring


def near_lines(seed, n=50):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghij") + str(rng.randint(0, 9)) for _ in range(rng.randint(1, 30))] for _ in range(10)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(1, 4)):
            words = list(rng.choice(base))
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = rng.choice("abcdef") + str(rng.randint(0, 99))
            lines.append(" ".join(words))
        rows.append((i, "\n".join(lines)))
    return rows


LIMITS = [{}, {"FEW": 1}, {"FEW": 2, "LARGE": 5, "BLOCK_WORDS": 40}, {"MANY": 3, "BLOCK_WORDS": 30}, {"FAN": 2}]


def classes(rows, t=0.8):
    """(doc_id, line) to (class, links, earliest similar line or None), by all pairs of distinct sets."""
    lines = sorted((i, k, frozenset(line.encode().split())) for i, text in rows if i is not None for k, line in enumerate((text or "").split("\n")))
    first = {}
    for i, k, words in lines:
        if words:
            first.setdefault(words, (i, k))
    near = {a: {b for b in first if len(a & b) >= t * len(a | b) - 1e-9} for a in first}
    out, root = [], {}
    for a in first:
        todo, seen = [a], {a}
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        root[a] = min(first[b] for b in seen)
    for i, k, words in lines:
        if words:
            earliest = min((first[b] for b in near[words] if first[b] < (i, k)), default=None)
            out.append((i, k, *root[words], len(near[words]) - 1, earliest is not None, *(earliest or (None, None))))
    return out


@pytest.mark.parametrize("limits", LIMITS)
def test_lines_against_all_pairs(docs, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(line_dedup, name, value)
    y = [f"y{k}" for k in range(10)]
    rows = near_lines(4) + [(100, None), (101, ""), (102, "\n \n"), (None, "a1 b2"), (103, "a b c d"), (104, "a b c d e"), (105, "d c b a"), (106, "y " * 5000), (107, "y\ny"), (103, "a b c d"), (103, "e f\na b c")]
    rows += [(110, " ".join(y[2:])), (111, " ".join(y[:2] + y[4:])), (112, " ".join(y)), (113, " ".join(y[::-1])), (None, " ".join(y))]
    rows += [(120 + k, " ".join([f"z{j}" for j in range(20)] + [f"own{k}"])) for k in range(80)]
    want = classes(rows)
    got = line_dedup.line_links(docs(rows, extra=True)).collect()
    assert sorted(map(str, (tuple(r)[:8] for r in got))) == sorted(map(str, want))
    texts = {}
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            texts.setdefault((i, k), []).append(set(line.split()))
    for r in got:
        if r["removed"]:
            pairs = [(a, b) for a in texts[r["doc_id"], r["line"]] for b in texts[r["kept_doc_id"], r["kept_line"]]]
            assert any(abs(len(a & b) / len(a | b) - r["similarity"]) < 1e-6 for a, b in pairs)
    if limits:
        return
    gone = line_dedup.similar_lines(docs(rows, extra=True)).collect()
    assert {(r["doc_id"], r["line"]) for r in gone} == {(i, k) for i, k, *_, out, _, _ in want if out}
    assert line_dedup.line_links(docs([])).count() == 0


def test_chunks_of_very_many_lines(monkeypatch):
    import numpy as np

    raw = "\n".join(t for _, t in near_lines(7)).encode()
    rank = np.random.default_rng(1).integers(0, 9, 1 << line_dedup.SKETCH_BITS).astype(np.uint8)
    text = line_dedup.Text(0, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    usual = line_dedup.Lines(text, rank)
    monkeypatch.setattr(line_dedup, "KEYED", 0)
    long = line_dedup.Lines(text, rank)
    assert all((getattr(usual, k) == getattr(long, k)).all() for k in ("doc", "number", "n", "h", "parity", "parity2", "offset", "words"))


def test_lines_are_removed(docs):
    rows = [(1, "one two three\nfour five six"), (2, "one two three\nseven eight nine"), (3, "four five six"), (4, None), (5, ""), (None, "one two three"), (6, "six five four\n\n")]
    out = line_dedup.remove_lines(docs(rows, extra=True))
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == {(1, rows[0][1]), (2, "seven eight nine"), (4, None), (5, ""), (None, "one two three")}
    assert out.columns == docs(rows, extra=True).columns
    assert line_dedup.remove_lines(docs([])).count() == 0


def removed(rows, width):
    low = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for s in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[s : s + width])
                low[key] = min(low.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if i is not None and low[tuple(w[s : s + width])] < i:
                gone[s : s + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,width", [(1, 13), (2, 50)])
def test_substrings_against_all_windows(docs, seed, width):
    rng = random.Random(seed)
    source = [rng.choice("abcdefgh") for _ in range(400)]
    rows = []
    for i in range(40):
        a = rng.randrange(300)
        words = source[a : a + rng.randint(0, 3 * width)]
        for _ in range(rng.randint(0, 2)):
            if words:
                words[rng.randrange(len(words))] = rng.choice("abx")
        rows.append((i // 2 * 3 if rng.random() < 0.2 else i * 3 + 1, " ".join(words) + rng.choice(["", "\n", " a" * 2 * width])))
    rows += [(200, None), (201, ""), (None, " ".join(source)), (202, " ".join(source)), (202, " ".join(source)), (203, "q " * 3000), (204, "q " * 3000)]
    got = substring.substring_report(docs(rows, extra=True), width=width).collect()
    assert sorted((tuple(r) for r in got), key=str) == removed(rows, width)
    kept = substring.remove_repeats(docs(rows, extra=True), width=width)
    digest = lambda t: hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest()
    assert sorted(digest(r["text"]) for r in kept.collect()) == sorted(r[3] for r in removed(rows, width))


def test_substrings_of_blocks_that_a_document_doubles(docs):
    rng = random.Random(5)
    for width in (13, 50):
        a, b, c = ([f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (3 * width, width + 7, 3 * width))
        twice, other = " ".join((a + b + c) * 2), " ".join(a + b + c)
        rows = [(1, " ".join(b)), (5, twice), (5, other + " x"), (5, twice), (7, other), (9, " ".join(c + b + a + b))]
        got = substring.substring_report(docs(rows), width=width).collect()
        assert sorted((tuple(r) for r in got), key=str) == removed(rows, width)


def test_passages_that_a_first_document_repeats(docs):
    rng = random.Random(11)
    rows = []
    for k in range(30):
        whole = [f"s{k}x{j}" for j in rng.sample(range(10**6), 200)]
        rows.append((2 * k, " ".join(whole[: rng.randint(60, 190)])))
        rows.append((2 * k + 1, " ".join([*whole, *(f"o{k}x{j}" for j in range(60)), *whole])))
    rows += [(200, rows[1][1] + " tail"), (200, " ".join(rows[1][1].split()[30:])), (200, rows[1][1])]
    got = substring.substring_report(docs(rows), width=50).collect()
    assert sorted((tuple(r) for r in got), key=str) == removed(rows, 50)


def test_equal_hashes_of_other_words_remove_nothing(docs, monkeypatch):
    """Verification at the source coordinates: with a hash of words that only sees their length, all stretches look alike."""
    monkeypatch.setattr(substring, "word_hash", lambda data, start, end, seed=0: (end - start).astype("uint64"))
    rng = random.Random(3)
    rows = [(k, " ".join(f"{rng.randrange(10**5):05d}" for _ in range(120))) for k in range(6)]
    rows.append((9, rows[2][1]))
    text = substring.Text(0, *_one(rows[0][1]))
    assert len(set(substring.stretches(text, 50)[2].tolist())) == 1
    edges = [b for t in (rows[0][1], rows[1][1]) for b in substring._digests(50)(iter([_batch(t)]))]
    assert edges[0].column(0).to_pylist() == edges[1].column(0).to_pylist() and edges[0].column(1) != edges[1].column(1)


def test_neighbouring_paths_compact_to_one(docs):
    """A passage that documents share between branches is one path, and one span of each later document."""
    passage, own = ([f"{p}{k}" for k in range(600)] for p in "po")
    rows = [(1, " ".join(own[:100] + passage + own[300:400])), (2, " ".join(own[100:200] + passage + own[200:300])), (3, " ".join(passage))]
    rows = substring._rows(docs(rows), "doc_id", "text")
    spans = substring._repeats(rows, 50, substring.Workspace(rows.sparkSession, "compact"))[1].collect()
    longest = {i: max(r["n"] for r in spans if r["doc_id"] == i) for i in (2, 3)}
    assert {r["doc_id"] for r in spans} == {2, 3} and min(longest.values()) > 451 - 2 * 39
    assert longest[2] == longest[3] and len([r for r in spans if r["n"] > 1]) == 2
    cut = substring.substring_report(rows.select("doc_id", "text")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in cut} == {1: 0, 2: 600, 3: 600}


def _one(text):
    import numpy as np

    raw = text.encode()
    return np.frombuffer(raw, np.uint8), np.array([0, len(raw)])


def _batch(text):
    import pyarrow as pa

    spans = pa.array([[{"at": 0, "n": 71, "whole": True, "open": True}]], pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("whole", pa.bool_()), ("open", pa.bool_())])))
    return pa.record_batch([pa.array([1]), pa.array([b"v"]), pa.array([text]), spans], ["doc_id", "version", "text", "spans"])


def test_no_documents(docs):
    assert substring.substring_report(docs([])).count() == 0 and line_dedup.similar_lines(docs([])).count() == 0
