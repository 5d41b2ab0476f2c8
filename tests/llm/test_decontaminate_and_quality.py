import random
import re
from itertools import combinations

import numpy as np
import pytest
from gristmill.llm import decontaminate, quality
from gristmill.session import load
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_masks_are_lossless():
    looks = [[k for k, c in enumerate(m) if c == "1"] for m in decontaminate.MASKS]
    for size in range(5, 21):
        for missed in combinations(range(size), size // 5):
            assert any(all(p + k not in missed for k in own) for m, own in zip(decontaminate.MASKS, looks, strict=True) for p in range(size - len(m) + 1))


def tokens(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def holds(doc, item, window=20):
    d, b = np.array(tokens(doc), object), np.array(tokens(item), object)
    size = min(window, len(b))
    if len(b) < 5:
        return False
    for at in range(size - len(b), len(d) - size + 1):
        start, end = max(0, -at), min(len(b), len(d) - at)
        if end - start >= size:
            same = np.cumsum(np.r_[0, (d[at + start : at + end] == b[start:end]).astype(int)])
            if (same[size:] - same[:-size]).max() * 5 >= 4 * size:
                return True
    return False


@pytest.mark.parametrize("block", [200_000, 10])
def test_leaks_against_all_alignments(spark, docs, block):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([3, 5, 8, 15, 30])))) for k in range(12)] + [(50, None), (None, "alpha beta gamma delta epsilon zeta")]
    rows = []
    for i in range(80):
        text = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.7:
            own = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randint(0, max(1, len(own) // 4))):
                if own:
                    own[rng.randrange(len(own))] = "SUBST"
            at = rng.randrange(len(text) + 1)
            text[at:at] = own
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(text).upper()))
    rows += [(100, None), (101, ""), (None, "Alpha, beta gamma-delta epsilon zeta"), (102, "w1 " * 10_000), (7, rows[7][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(docs(rows, extra=True), table, block_words=block).collect()
    want = sorted(((i, j) for i, t in rows for j, b in items if holds(t, b)), key=str)
    assert sorted(((r["doc_id"], r["item_id"]) for r in got), key=str) == want and want
    kept = decontaminate.drop_leaks(docs(rows, extra=True), table, block_words=block)
    assert kept.columns == docs(rows, extra=True).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, t in rows if not any(holds(t, b) for _, b in items))
    assert decontaminate.find_leaks(docs([]), table).count() == 0
    assert decontaminate.find_leaks(docs(rows), table.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    docs, labels = load(spark, "/root/testdata/sf0.1", "documents"), load(spark, "/root/testdata/sf0.1", "labels")
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0
    got = quality.score(docs, labels.where(~held)).join(labels.where(held), "doc_id").toPandas()
    good = (got.quality == 1) & (got.toxic == 0)
    assert len(got) > 800 and (got.keep == good).mean() > 0.97
    assert got.keep[good].mean() > 0.99 and (~got.keep[~good]).mean() > 0.9


def test_posteriors_shrink_sparse_sites(spark):
    rows = [(k, "fine words here and there", "rich", "p") for k in range(200)] + [(200 + k, "%%% $$$ ***", "bad", "p") for k in range(200)] + [(400, "%%% $$$ ***", "sparse", "p"), (401, None, None, None), (None, "fine words here and there", "rich", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({c: F.lit(0) for c in ("quality_host", "g_host", "keep", "path_n")})
    labels = spark.createDataFrame([(k, int(k < 200), 0) for k in range(0, 400, 2)] + [(3, None, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score(docs, labels).collect()}
    assert got[1]["keep"] and not got[201]["keep"] and len(got) == len(rows)
    assert got[201]["host_posterior"] < got[400]["host_posterior"] < got[1]["host_posterior"]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id = 201").isEmpty() and kept.where("doc_id is null").count() == 1
    everything = quality.score(docs, labels.where("quality = 1")).collect()
    assert all(r["keep"] for r in everything) and len(everything) == len(rows)
    assert quality.score(docs.limit(0), labels).count() == 0 and quality.score(docs, labels.limit(0)).where("keep").count() == len(rows)


def test_toxic_labels_of_unknown_quality_teach(spark):
    rows = [(k, "fine words here and there" if k < 100 else "%%% $$$ ***", "host", "p") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) if k < 100 else (k, None, 1) for k in range(0, 200, 2)] + [(1, None, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"] for r in quality.score(docs, labels).where("keep").collect()} == set(range(100))
