"""Kneser-Ney bigrams against plain loops."""

import math
import random
import re
from collections import Counter

from gristmill.operators import ngram
from gristmill.storage import Workspace
from pyspark.sql import functions as F

DDL = "doc_id long, language string, text string"


def plain_pairs(texts):
    out = Counter()
    for t in texts:
        w = re.findall("[^ \t\n\x0b\x0c\r]+", (t or "").lower())
        out.update(zip(["", *w], w))
    return out


def plain_probability(texts, size):
    """P(w | v) by the definition."""
    c = plain_pairs(texts)
    discount = lambda counts: counts[1] / (counts[1] + 2 * counts[2]) if counts[1] else 0.5
    t, u, a = Counter(), Counter(), Counter()
    for (v, w), n in c.items():
        t[v] += n
        u[v] += 1
        a[w] += 1
    d, e = discount(Counter(c.values())), discount(Counter(a.values()))

    def p(v, w):
        low = max(a[w] - e, 0) / len(c) + e * len(a) / len(c) / size if c else 1 / size
        return max(c[v, w] - d, 0) / t[v] + d * u[v] / t[v] * low if t[v] else low

    return p


def made(rng, n, first):
    words = [f"w{k}" for k in range(40)]
    text = lambda: " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(40)], k=rng.randint(0, 60)))
    return [(first + k, rng.choice(["xx", "yy"]), None if k % 17 == 3 else text()) for k in range(n)]


def test_losses_of_several_models_are_those_of_plain_ones(spark):
    rng = random.Random(1)
    base, pool, held = made(rng, 20, 0), made(rng, 60, 100), [*made(rng, 20, 200), (300, "zz", "never seen words\tNever")]
    chosen = {"a": [r[0] for r in pool[::3]], "b": [r[0] for r in pool[::2]], "c": []}
    frame = lambda rows: spark.createDataFrame(rows, DDL)
    selected = spark.createDataFrame([(m, i) for m, ids in chosen.items() for i in ids] + [("a", pool[0][0])], "model string, doc_id long")
    got = {(r["model"], r["language"]): (r["loss"], r["n_tokens"]) for r in ngram.continued_losses(frame(base), frame(pool), selected, frame(held), ["a", "b", "c"], with_base="base").collect()}
    size = len({w for _, w in plain_pairs([r[2] for r in base + pool + held])})
    want = {}
    for model, ids in {**chosen, "base": []}.items():
        p = plain_probability([r[2] for r in base] + [r[2] for r in pool if r[0] in ids], size)
        for lang in ("xx", "yy", "zz"):
            seen = plain_pairs([r[2] for r in held if r[1] == lang])
            want[model, lang] = (round(-sum(n * math.log(p(v, w)) for (v, w), n in seen.items()) / sum(seen.values()), 6), sum(seen.values()))
    assert got.keys() == want.keys()
    for k, (loss, n) in want.items():
        assert abs(got[k][0] - loss) <= 1.1e-6 and got[k][1] == n
    assert got["c", "xx"] == got["base", "xx"] and got["a", "xx"][0] < got["base", "xx"][0]


def test_probabilities_add_up_to_one(spark):
    texts = ["a b a c", "b a", "a b a", "d"]
    docs = spark.createDataFrame([(k, "xx", t) for k, t in enumerate(texts)], DDL).withColumns(dict.fromkeys(ngram.mask_columns(["all", "nothing"]), F.lit(1).cast("long")))
    vocabulary = spark.createDataFrame([(w,) for w in "a b c d e f".split()], "w string")
    fitted = ngram.fit(docs, ["all", "nothing"], vocabulary, Workspace(spark, "test"))
    events = spark.createDataFrame([(v, w) for v in ("", "a", "b", "zz") for w in "a b c d e f".split()], "v string, w string")
    rows = events.join(fitted.counts, ["v", "w"], "left").join(fitted.contexts, "v", "left").join(fitted.continued, "w", "left")
    for k in range(2):
        sums = rows.groupBy("v").agg(F.sum(fitted.probability(k)).alias("p")).collect()
        assert len(sums) == 4 and all(abs(r["p"] - 1) < 1e-12 for r in sums)


def test_empty_tables(spark):
    empty, some = spark.createDataFrame([], DDL), spark.createDataFrame([(1, "xx", "a b")], DDL)
    none = spark.createDataFrame([], "model string, doc_id long")
    assert ngram.continued_losses(some, some, none, empty, ["a"]).count() == 0
    (row,) = ngram.continued_losses(empty, empty, none, some, ["a"]).collect()
    assert row["loss"] == round(math.log(2), 6)


def test_more_models_than_bits_of_a_mask(spark):
    models = [f"m{k}" for k in range(70)]
    texts = spark.createDataFrame([(k, "xx", f"a b{k % 3} a") for k in range(70)], DDL)
    selected = spark.createDataFrame([(m, k) for k, m in enumerate(models)], "model string, doc_id long")
    held = spark.createDataFrame([(1, "xx", "a b0 a")], DDL)
    got = {r["model"]: r["loss"] for r in ngram.continued_losses(texts.limit(0), texts, selected, held, models).collect()}
    p = [plain_probability([f"a b{k} a"], 4) for k in range(3)]
    for k, m in enumerate(models):
        want = -sum(math.log(p[k % 3](v, w)) for v, w in (("", "a"), ("a", "b0"), ("b0", "a"))) / 3
        assert abs(got[m] - want) < 1.1e-6


def test_losses_are_one_expression_for_all_models(spark):
    """As many expressions as models make a method that the JVM doesn't compile."""
    names = [f"m{k}" for k in range(26)]
    texts = spark.createDataFrame([(1, "xx", "a b a"), (2, "xx", "\tb  c\n\x0bb\r\x0c"), (3, "xx", ""), (4, "xx", None)], DDL)
    docs = texts.withColumns(dict.fromkeys(ngram.mask_columns(names), F.lit(-1).cast("long")))
    ws = Workspace(spark, "test")
    found = ngram.losses(ngram.fit(docs, names, texts.select(F.explode(ngram.words(F.col("text"))).alias("w")).distinct(), ws), texts, ["language"], ws)
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("ln(") == 1
    rows = found.collect()
    assert len(rows) == 26 and {r["n_tokens"] for r in rows} == {6} and len({r["loss"] for r in rows}) == 1
    assert sorted((r["v"], r["w"]) for r in ngram.pairs(texts, []).collect()) == [("", "a"), ("", "b"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]
