"""The classifier's posteriors and the whole pipeline by plain loops, on a small fixture."""

import math
import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from gristmill.llm import packing, quality, simhash
from gristmill.llm.queries import tokenizer_path
from test_decontaminate_and_quality import holds
from test_lines_and_substrings import classes
from test_token_files_and_packing import best_fit
from test_warc_and_simhash import plain_fingerprint

GOOD = [f"{a}{b}" for a in ("stone", "river", "light", "field", "house", "winter") for b in ("", "s", "ly", "ing", "ed")]
BAD = ["$$$", "%%%", "###", "***"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(spark, folder):
    rng = random.Random(12)
    line = lambda words, n: " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n))
    items = [(k, line(GOOD, 14)) for k in range(3)]
    rows = []
    for i in range(120):
        bad = i % 4 == 3
        text = "\n".join(line(BAD if bad else GOOD, rng.randint(6, 30)) for _ in range(rng.randint(1, 4)))
        if i % 10 == 5 and rows:  # an earlier document, some words changed, or one of its lines
            words = (rows[rng.randrange(len(rows))][1] or "x y z").split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        if i % 10 == 6 and rows:
            text += "\n" + (rows[rng.randrange(len(rows))][1] or "").split("\n")[0]
        if i % 20 == 12:  # its lines are other ones, its shingles the same
            text = rows[0][1].replace("\n", " ") + f" end{i}"
        if i % 20 == 8:
            text += " " + rng.choice(items)[1]
        rows.append((i, text, rng.choice(["en", "de"]), "rich" if not bad else rng.choice(["rich", "poor", f"rare{i}"]), len(text)))
    rows += [(120, None, "en", "rich", 0), (121, "", None, None, 0), (122, rows[0][1], "de", "rich", rows[0][4]), (123, line(GOOD, 3000), "en", "rich", 9)]
    labels = [(i, int(i % 4 != 3), 0) for i in range(0, 120, 2)] + [(i, 1, 1) for i in (3, 7)] + [(1, None, 0), (500, 1, 0)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, labels, items


def strength(groups):
    """Method of moments over (n, share, mean toward which it shrinks): the prior weighs as many documents as chance is larger than the spread."""
    total = sum(n for n, _, _ in groups)
    if not total or len(groups) <= 1:
        return 1e4
    spread = sum(n * (s - m) ** 2 for n, s, m in groups) - sum(m * (1 - m) for _, _, m in groups)
    between = spread / max(total - sum(n * n for n, _, _ in groups) / total, 1.0)
    within = sum(n * m * (1 - m) for n, _, m in groups) / total
    return min(max(round(within / max(between, 1e-9) - 1, 6), 1.0), 1e4)


def posteriors(rows, prior):
    """(host posterior, path posterior, posterior) of (host, path, evidence) rows."""
    p = [round(1e6 / (1 + math.exp(-(e + prior)))) / 1e6 for *_, e in rows]
    n, s = Counter(), defaultdict(float)
    for (h, w, _), x in zip(rows, p):
        for g in ((h,), (h, w)):
            n[g] += 1
            s[g] += x
    mean = min(max(sum(p) / len(p), 1e-4), 1 - 1e-4)
    hosts, paths = [g for g in n if len(g) == 1], [g for g in n if len(g) == 2]
    a = strength([(n[g], s[g] / n[g], mean) for g in hosts])
    host = lambda g, x=0.0, k=0: (a * mean + s[g] - x) / (a + n[g] - k)
    b = strength([(n[g], s[g] / n[g], host(g[:1])) for g in paths])
    out = []
    for (h, w, e), x in zip(rows, p):
        others = (b * host((h,), x, 1) + s[h, w] - x) / (b + n[h, w] - 1)
        others = min(max(others, 1e-6), 1 - 1e-6)
        out.append((host((h,)), (b * host((h,)) + s[h, w]) / (b + n[h, w]), 1 / (1 + math.exp(-(e + math.log(others / (1 - others)))))))
    return out


def prior_of(rows, labels):
    known = {i: q == 1 and t != 1 for i, q, t in labels if q is not None or t == 1}
    good = [known[r[0]] for r in rows if r[0] in known]
    return math.log(sum(good) / (len(good) - sum(good)))


def test_posteriors_by_plain_sums(spark, tmp_path):
    rows, labels, _ = fixture(spark, str(tmp_path))
    docs, known = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality.score(docs, known).collect()}
    want = posteriors([(r[3], r[2], got[r[0]]["evidence"]) for r in rows], prior_of(rows, labels))
    for r, (host, path, posterior) in zip(rows, want):
        g = got[r[0]]
        assert (g["host_posterior"], g["path_posterior"], g["posterior"]) == pytest.approx((host, path, posterior), abs=1e-4)
        assert g["keep"] == (g["posterior"] >= 0.5)
    kept = {i for i, g in got.items() if g["keep"]}
    assert {i for i in range(120) if i % 4 != 3 and i % 10 not in (5, 6)} <= kept and not {i for i in range(120) if i % 4 == 3 and i % 10 not in (5, 6, 8)} & kept


def test_labelled_rows_are_bounded_by_id(spark, monkeypatch):
    rows = [(k % 4, f"{'fine words' if k % 2 else '%%% ###'} {k}", "h", "p") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(4)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda dense, own, bucket, good, **_: seen.append(len(good)) or quality.NEUTRAL)
    quality.train(docs, labels, max_labelled=2)
    quality.train(docs, labels)
    assert seen == [2, 4]


def shingles(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def plain_pipeline(spark, folder, rows, labels, items):
    docs, known = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    evidence = {r["doc_id"]: r["evidence"] for r in quality.score(docs, known).collect()}
    found = posteriors([(r[3], r[2], evidence[r[0]]) for r in rows], prior_of(rows, labels))
    texts = {r[0]: r[1] for r, (*_, p) in zip(rows, found) if p >= 0.5}
    after = [dict(texts)]
    gone = {(i, k) for i, k, *_, removed, _, _ in classes(texts.items()) if removed}
    for i, t in list(texts.items()):
        lines = (t or "").split("\n")
        left = [x for k, x in enumerate(lines) if (i, k) not in gone]
        if len(left) < len(lines):
            texts[i] = "\n".join(left)
            if not any(x.strip() for x in left):
                del texts[i]
    after.append(dict(texts))
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {}
    for i in sorted(sets):
        if i not in root:
            todo = [i]
            while todo:
                a = todo.pop()
                root[a] = i
                todo += [b for b in sets if b not in root and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    texts = {i: t for i, t in texts.items() if root[i] == i}
    after.append(dict(texts))
    texts = {i: t for i, t in texts.items() if not any(holds(t, b) for _, b in items)}
    after.append(dict(texts))
    return after


def test_pipeline_by_plain_loops(spark, tmp_path):
    from gristmill.llm.encoder import Encoder

    folder = str(tmp_path)
    rows, labels, items = fixture(spark, folder)
    want = plain_pipeline(spark, folder, rows, labels, items)
    assert len(rows) > len(want[0]) > len(want[1]) > len(want[2]) > len(want[3]) > 20
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), texts in zip(corpus_pipeline.STAGES, want):
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == texts, name
    packed = corpus_pipeline.run(spark, folder).toPandas()
    tokenizer = Encoder(tokenizer_path()).tokenizer
    lengths = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in want[-1].items()}
    assert packed.groupby("doc_id").n_tokens.sum().to_dict() == lengths
    pieces = [x for n in lengths.values() for x in [4096] * (n // 4096) + [n % 4096] if x]
    used = packed[packed.n_tokens > 0].groupby("bin_id").n_tokens.sum()
    assert sorted(used) == best_fit(pieces, packing.CAPACITIES, packing.OVERHEAD, packing.ATTENTION)


def test_fingerprints_of_the_pipeline_are_the_plain_ones():
    rng = random.Random(3)
    for n in (0, 1, 4, 5, 300):
        text = " ".join(rng.choice(GOOD) for _ in range(n))
        assert simhash.fingerprint(text, 5) == plain_fingerprint(text, 5)
