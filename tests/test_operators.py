"""Selection, splits, packing, metrics, proxy choice and evaluation on literal rows."""

import random

import numpy as np
import pandas as pd
import pytest
from gristmill.constants import BASELINES, DIMENSIONS, WEIGHTS
from gristmill.functions import scoring
from gristmill.functions.normalize import converted_share, nfc, repair
from gristmill.operators import blocks, corpus, evaldata, evaluate, metrics, proxy, rater, selection, split
from pyspark.sql import functions as F


def scored(spark, n=20, seed=1):
    rng = random.Random(seed)
    rows = [(f"d{k}", "vi", "clean", 4 * rng.randint(1, 50), k, *(rng.choice([0.5, 1.0, 2.5, 4.0]) for _ in DIMENSIONS)) for k in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id string, language string, source string, char_len int, pos int, " + ", ".join(f"{d} double" for d in DIMENSIONS))


def taken(ordered, budget):
    out, total = [], 0.0
    for r in ordered:
        if total >= budget:
            break
        out.append(r[0])
        total += r[3] / 4
    return out


@pytest.mark.parametrize("budget", [-1, 0, 1, 60, 150, 1e9])
def test_selection_takes_the_best_until_the_budget(spark, budget):
    rows, df = scored(spark)
    got = selection.select_for_weight(df, {"educational_value": 1.0}, budget).orderBy(F.desc("weighted_score"), "pos").collect()
    assert [r["doc_id"] for r in got] == taken(sorted(rows, key=lambda r: -r[5]), budget)


def test_all_weights_agree_with_one_by_one(spark):
    _, df = scored(spark, 60)
    both = selection.select_all_weights(df, selection.weights_table(spark), 100).collect()
    for w in WEIGHTS[::5]:
        one = selection.select_for_weight(df, dict(zip(DIMENSIONS, w[1:-1], strict=True)), 100)
        assert {r["doc_id"] for r in both if r["weight_id"] == w[0]} == {r["doc_id"] for r in one.collect()}
    assert selection.weights_table(spark, ["W02", "none"]).count() == 1


def test_baselines(spark):
    _, df = scored(spark)
    features = df.withColumns({"language_score": F.lit(0.9), "repetition_score": F.when(F.col("pos") % 2 == 0, 0.1).otherwise(0.2), "target_script_ratio": F.when(F.col("pos") != 4, 0.9)})
    picked = selection.select_baseline("clean_heuristic", features, 1e9)
    assert sorted(r["pos"] for r in picked.collect()) == [k for k in range(0, 20, 2) if k != 4]
    random_ = lambda seed: [r["doc_id"] for r in selection.select_random(df.repartition(3), 100, seed).collect()]
    assert sorted(random_(42)) == sorted(random_(42)) and sorted(random_(42)) != sorted(random_(43))
    assert selection.select_baseline("equal_average", df, 50).count() > 0
    with pytest.raises(ValueError):
        selection.select_baseline("other", df, 50)
    none = selection.select_clean_heuristic(features.withColumn("language_score", F.lit(None).cast("double")), 100)
    assert selection.selection_report(none, df.select("language").distinct(), 100).first()["warning"] == "empty"


def test_join_and_missing(spark):
    _, df = scored(spark, 4)
    cand = spark.createDataFrame([("d0", "vi", "x", 1, 0, 0.9), ("d0", "vi", "y", 1, 9, 0.9), ("d1", "id", "z", 1, 1, 0.9)], "doc_id string, language string, text string, char_len int, pos int, language_score double")
    joined = selection.join_scores(df.drop("char_len", "pos"), cand).collect()
    assert [(r["doc_id"], r["text"]) for r in joined] == [("d0", "y")]
    assert selection.missing_text(df, cand).first()["n_missing"] == 3


def test_pool_sizes_round_half_to_even():
    assert corpus.pool_sizes(20) == (16, 4)
    assert scoring.split_size(5, 0.5) == 2 and scoring.split_size(7, 0.5) == 4


def test_numbered_positions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = corpus.numbered(df, [F.col("v")]).collect()
    assert all(r["v"] == r["pos"] for r in got) and len(got) == 1000


def test_skip_takes_one_row_at_least(spark):
    df = spark.createDataFrame([(str(k), f" {'x' * 8} ", 0.9, k) for k in range(10)], "id string, text string, language_score double, pos long")
    assert corpus.stream_after_skip(df, 3, 0, "clean").count() == 1
    assert [r["pos"] for r in corpus.stream_after_skip(df, 3, 4, "clean").orderBy("pos").collect()] == [3, 4]
    assert corpus.stream_docs(df, 4, "clean").first()["char_len"] == 10


def test_keep_first(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), ("b", 5, None), (None, 1, "n")], "k string, pos int, v string")
    assert {(r["k"], r["v"]) for r in corpus.keep_first(df, ["k"], [F.col("pos")]).collect()} == {("a", "first"), ("b", None), (None, "n")}


@pytest.mark.parametrize("size", [1, 3, 7])
def test_blocks(spark, size):
    texts = ["ab c", "", "dé", None, "x" * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "pos long, text string")
    flat = [i for t in texts for i in [*(ord(c) for c in t or ""), 0]]
    got = blocks.pack_blocks(df, blocks.character_tokens(F.col("text")), size, 0, span=2).orderBy("block_id").collect()
    assert [r["tokens"] for r in got] == [flat[k : k + size] for k in range(0, len(flat) - size + 1, size)]
    with pytest.raises(ValueError):
        blocks.require_blocks(blocks.pack_blocks(df, blocks.character_tokens(F.col("text")), 1000, 0))


def test_stratified_split(spark):
    rng = random.Random(3)
    rows = [(f"{lang}{k}", lang, *(rng.randint(0, 5) for _ in DIMENSIONS)) for lang in ("vi", "th") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id string, language string, " + ", ".join(f"{d} int" for d in DIMENSIONS))
    got = split.stratified_split(df, {"train": 0.8, "dev": 0.1, "test": 0.1}).toPandas()
    assert len(got) == got.doc_id.nunique() == 200
    assert got.groupby(["language", "split"]).size().to_dict() == {(a, b): n for a in ("vi", "th") for b, n in (("train", 80), ("dev", 10), ("test", 10))}
    again = split.stratified_split(df.repartition(5), {"train": 0.8, "dev": 0.1, "test": 0.1}).toPandas()
    assert dict(zip(got.doc_id, got.split, strict=True)) == dict(zip(again.doc_id, again.split, strict=True))
    for d in DIMENSIONS:
        share = got[got.split == "train"].groupby(["language", d]).size() / got.groupby(["language", d]).size()
        assert share.between(0.55, 1.0).all()


def test_spearman(spark):
    rng = random.Random(5)
    rows = [(g, rng.randint(0, 5), round(rng.random(), 1)) for g in "ab" for _ in range(50)] + [("c", 1, 0.5), ("c", 1, 0.7), ("d", 1, 2.0)]
    df = spark.createDataFrame(rows, "g string, t int, p double")
    got = {r["g"]: r["spearman"] for r in metrics.spearman(df, ["g"], "t", "p").collect()}
    for g in "ab":
        own = pd.DataFrame([r for r in rows if r[0] == g])
        assert got[g] == pytest.approx(np.corrcoef(own[1].rank(), own[2].rank())[0, 1])
    assert got["c"] == got["d"] == 0.0  # constant, or a single row


# Macro and worst-language losses of a published comparison of the 26 vectors, in order of their ids.
PUBLISHED = dict(zip(
    [w[0] for w in WEIGHTS],
    zip(
        (2.1903, 2.1820, 2.2211, 2.1644, 2.1687, 2.1832, 2.1863, 2.1881, 2.1896, 2.1760, 2.1741, 2.1875, 2.1879, 2.1855, 2.1792, 2.1863, 2.1816, 2.1818, 2.1837, 2.1868, 2.1725, 2.1885, 2.1785, 2.1778, 2.1836, 2.1822),
        (3.4137, 3.4169, 3.4699, 3.3816, 3.3815, 3.4039, 3.4123, 3.4190, 3.4309, 3.4038, 3.3758, 3.4206, 3.4155, 3.4156, 3.3919, 3.4166, 3.3998, 3.4044, 3.4163, 3.4072, 3.3833, 3.4188, 3.3850, 3.3965, 3.4067, 3.4027),
        strict=True,
    ), strict=True,
))


def test_published_ranking(spark):
    results = spark.createDataFrame([(k, *v) for k, v in PUBLISHED.items()], "weight_id string, macro_loss double, worst_language_loss double")
    ranked = proxy.ranking(results, selection.weights_table(spark))
    rows = ranked.orderBy("rank").collect()
    assert [r["weight_id"] for r in rows[:5]] == ["W04", "W05", "W21", "W11", "W10"]
    assert sum(r["tie"] for r in rows) == 16 and [r["weight_id"] for r in rows if r["selected"]] == ["W11"]
    assert rows[15]["weight_id"] == "W14" and rows[16]["weight_id"] == "W07" and not rows[16]["tie"]
    assert proxy.best_weight(results, selection.weights_table(spark)).first()["weights"]["cultural_nuance"] == 0.4
    report = proxy.ranking_markdown(ranked, "W10")
    assert "W11" in report and "no longer" in report


def test_latest_result_wins(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)], "weight_id string, pos int, macro_loss double")
    assert {(r["weight_id"], r["macro_loss"]) for r in proxy.latest(df).collect()} == {("a", 2.0), ("b", 3.0)}


def test_prediction_ties_go_to_the_first(spark):
    docs = spark.createDataFrame([(1, ["A", "B", "C"], ["x", "y", "z"], 1)], "doc_id int, choices array<string>, choice_texts array<string>, gold int")
    scores = spark.createDataFrame([("m", 1, k, s, 2) for k, s in enumerate([-2.0, -1.0, -1.0])], "model string, doc_id int, choice int, sum_log_prob double, num_tokens int")
    r = evaluate.predictions(docs, scores).first()
    assert (r["predicted"], r["predicted_letter"], r["gold_choice"], r["correct"]) == (1, "B", "y", True)
    assert r["token_normalized_prob_correct"] == pytest.approx(np.exp(-0.5))


def test_results_merge_and_totals(spark):
    make = lambda rows: spark.createDataFrame(rows, "model string, task string, bucket string, metric string, value double")
    old = make([("base", "t", "a", "accuracy", 0.5), ("base", "t", "b", "accuracy", 0.25), ("m", "t", "a", "accuracy", 0.75), ("m", "held_out", "a", "perplexity", 9.0), ("m", "held_out", "b", "perplexity", 8.0)])
    new = make([("m", "t", "b", "accuracy", 0.25), ("m", "t", "a", "accuracy", 1.0), ("m", "held_out", "a", "perplexity", 4.0)])
    once = evaluate.merge(old, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, evaluate.merge(once, new).collect()))
    totals = {(r["model"], r["metric"]): (r["macro"], r["worst"]) for r in evaluate.rollup(once).collect()}
    assert totals == {("base", "accuracy"): (0.375, 0.25), ("m", "accuracy"): (0.625, 0.25), ("m", "perplexity"): (4.0, 4.0)}
    gain = {r["model"]: r["relative_improvement"] for r in evaluate.improvements(once).collect()}
    assert gain == {"m": pytest.approx((0.625 - 0.375) / 0.375)}
    wanted = make([("m", "t", x, "accuracy", 0.0) for x in "abc"]).select("model", "task", "bucket")
    assert [r["bucket"] for r in evaluate.remaining(wanted, once).collect()] == ["c"]
    assert evaluate.remaining(wanted, once, force=True).count() == 3
    assert {r["model"] for r in evaluate.missing_baselines(once).where("task = 't'").collect()} == set(BASELINES)


def test_held_out_rows_leave_one(spark):
    df = spark.createDataFrame([(k, "s", ["A"], 0, "c") for k in range(2)], "pos int, subject string, choices array<string>, gold int, context string")
    held, rest = evaldata.hold_out(df, ["subject"], 5)
    assert (held.count(), rest.count()) == (1, 1)
    prefix = evaldata.fewshot_prefix(held, ["subject"])
    assert evaldata.with_prefix(rest, prefix, ["subject"]).first()["context"] == "c A\n\nc"
    held, rest = evaldata.hold_out(df, ["subject"], 0)
    assert held.isEmpty() and evaldata.with_prefix(rest, evaldata.fewshot_prefix(held, ["subject"]), ["subject"]).count() == 2


def test_retry_halves_batches():
    tried = []

    def score(rows, batch):
        tried.append(batch)
        if batch > 2:
            raise MemoryError
        return sum(rows)

    assert evaluate.with_retry(score, [1, 2], 8) == 3 and tried == [8, 4, 2]
    assert evaluate.with_retry(lambda rows, batch: (_ for _ in ()).throw(MemoryError), [1], 4) is None


def test_signed_percent_and_huber(spark):
    df = spark.createDataFrame([(0.1234, 3.0, 0.5), (-0.05, 0.2, 0.0), (None, 1.0, 0.0)], "x double, p double, t double")
    rows = df.select(scoring.signed_percent(F.col("x")).alias("s"), scoring.huber(F.col("p"), F.col("t")).alias("h"), scoring.improvement(F.lit(0.0), F.col("p"), True).alias("i")).collect()
    assert [r["s"] for r in rows] == ["+12.34%", "-5.00%", "—"]
    assert [r["h"] for r in rows] == [2.0, pytest.approx(0.02), 0.5] and rows[0]["i"] is None


def test_normalization(spark):
    df = spark.createDataFrame([("e\u0301",), (None,), ("old",)], "t string")
    assert [r[0] for r in df.select(nfc("t")).collect()] == ["\u00e9", None, "old"]
    fixed = repair(df, "t", lambda t: float(t == "old"), lambda t: "new")
    assert [(r["t"], r["converted"]) for r in fixed.collect()] == [("\u00e9", False), (None, False), ("new", True)]
    assert converted_share(fixed).first()["n_converted"] == 1


def plain_heads(x, y, hidden, epochs, rate, decay=1e-2, seed=0):
    """Full-batch AdamW on the mean of the heads' Huber losses (delta 1), in one process."""
    heads = {d: [np.array(p, float) for p in h] for d, h in rater.initial_heads(x.shape[1], hidden, tuple(y), seed).items()}
    moments = {d: [[0.0, 0.0] for _ in h] for d, h in heads.items()}
    for step in range(1, epochs + 1):
        for d, (w1, b1, w2, b2) in heads.items():
            inner = x @ w1.T + b1
            act = np.maximum(inner, 0)
            slope = np.clip(act @ w2 + b2 - y[d], -1, 1) / len(x) / len(heads)
            back = np.outer(slope, w2) * (inner > 0)
            for k, g in enumerate((back.T @ x, back.sum(0), act.T @ slope, slope.sum())):
                m = moments[d][k]
                m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
                heads[d][k] = heads[d][k] - rate * (m[0] / (1 - 0.9**step) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8) + decay * heads[d][k])
    return heads


def test_heads_learn_and_come_back(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 6))
    y = {"a": 2 + x[:, 0], "b": 2 - x[:, 1]}
    frame = lambda some: spark.createDataFrame([([float(v) for v in x[k]], float(y["a"][k]), float(y["b"][k])) for k in some], "embedding array<double>, a double, b double")
    rows, held = frame(range(300)).repartition(5), frame(range(300, 400))
    few, _ = rater.train(rows, held, ["a", "b"], hidden=8, epochs=3, every=3, rate=0.01)
    plain = plain_heads(x[:300], {k: v[:300] for k, v in y.items()}, 8, 3, 0.01)
    for d in "ab":
        assert all(np.allclose(p, q) for p, q in zip(few[d], plain[d], strict=True))  # gradients of five partitions add up to the whole one
    heads, best = rater.train(rows, held, ["a", "b"], hidden=8, epochs=30, batches=2, every=15, rate=0.05)
    assert best > 0.9
    rater.save_heads(spark, heads, str(tmp_path / "heads"))
    again = rater.load_heads(spark, str(tmp_path / "heads"))
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x[300:320])], "k int, embedding array<float>")
    got = rater.infer(df, again).orderBy("k").collect()
    assert [r["a"] for r in got] == pytest.approx(list(rater.apply_head(x[300:320], heads["a"])), abs=1e-4)


def test_training_takes_nulls_and_needs_rows(spark):
    rows = [([1.0, 0.0], 1.0, None), (None, 5.0, 1.0), ([0.0, 1.0], None, 2.0), ([0.5, 0.5], 0.5, 1.5)]
    df = spark.createDataFrame(rows, "embedding array<double>, a double, b double")
    heads, best = rater.train(df, df, ["a", "b"], hidden=2, epochs=2, every=1)
    assert all(np.isfinite(p).all() for h in heads.values() for p in h) and -1 <= best <= 1
    with pytest.raises(ValueError):
        rater.train(df.limit(0), df, ["a", "b"])


def test_ranks_of_many_distinct_values(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=6000), np.full(3000, 0.25)])
    y = np.round(x * 3 + rng.normal(size=9000), 2)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "t double, p double").withColumn("g", F.lit(None).cast("string"))
    import pandas as pd

    want = pd.Series(x).rank().corr(pd.Series(y).rank())
    (row,) = metrics.spearman(df, ["g"], "t", "p").collect()
    assert row["spearman"] == pytest.approx(want, abs=1e-12) and row["g"] is None


def test_embedding_plugin(spark):
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    got = rater.embed(df, "t", lambda texts: np.array([[len(t), 1.0] for t in texts])).collect()
    assert np.linalg.norm(got[0]["embedding"]) == pytest.approx(1, abs=1e-6) and got[1]["embedding"][0] == pytest.approx(9 / np.hypot(9, 1), abs=1e-6)
    v = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [1, 0]), ([[1.0, 2.0], [3.0, 4.0]], [0, 0])], "v array<array<double>>, m array<int>")
    assert [r[0] for r in v.select(rater.masked_mean(F.col("v"), F.col("m"))).collect()] == [[1.0, 2.0], [0.0, 0.0]]
