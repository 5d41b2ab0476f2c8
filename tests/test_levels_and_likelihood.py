"""Budgets over tied scores, positions over many spans, log-likelihoods by a plug-in, splits by plain loops, and the report's files."""

import hashlib
import json
import random
import sys
from collections import Counter

import numpy as np
import pytest
from gristmill.constants import DIMENSIONS
from gristmill.operators import blocks, corpus, evaluate, likelihood, prefix, rater, selection, split
from gristmill.plans import evaluation_queries as Q
from gristmill.plans import registry
from gristmill.sources import readers, writers
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def until(rows, budget):
    out, total = [], 0.0
    for r in rows:
        if total >= budget:
            break
        out.append(r)
        total += r[2]
    return out


@pytest.mark.parametrize("budget", [0.5, 7, 40, 41.5, 1000])
def test_budget_over_equal_scores_and_amounts_of_nothing(spark, budget):
    rng = random.Random(3)
    rows = [(k * 3000, rng.choice([1.0, 1.0, 1.0, 0.5, 0.5001]), float(rng.choice([0, 0, 1, 2.5]))) for k in range(60)]
    df = spark.createDataFrame(rows, "pos long, score double, n double").repartition(5)
    levels = [-F.floor(F.col("score") * 256), -F.round(F.col("score") * 10**9), *prefix.by_position()]
    got = prefix.take_until(df, [], levels, [F.desc("score"), F.asc("pos")], F.col("n"), budget).collect()
    want = until(sorted(rows, key=lambda r: (-r[1], r[0])), budget)
    assert sorted(map(tuple, got)) == sorted(want)


def test_one_score_for_all_rows_is_cut_by_position(spark):
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("vi").alias("language"), F.lit("clean").alias("source"), F.lit(4).alias("char_len"), F.col("id").alias("pos"), *(F.lit(1.0).alias(d) for d in DIMENSIONS))
    got = selection.select_for_weight(df, {DIMENSIONS[0]: 1.0}, 30_000.0)
    assert got.agg(F.count("*"), F.max("pos")).first()[:] == (30_000, 29_999)
    assert "text" not in got.columns and selection.with_text(got.limit(3), df.withColumn("text", F.lit("t"))).where("text = 't'").count() == 3


@pytest.mark.parametrize("span", [2, 1024])
def test_blocks_over_spans_of_spans(spark, span):
    rng = random.Random(5)
    texts = [" ".join("x" * rng.randint(1, 9) for _ in range(rng.randint(0, 12))) for _ in range(90)]
    df = spark.createDataFrame(list(enumerate(texts)), "pos long, text string").repartition(4)
    got = {r["block_id"]: r["tokens"] for r in blocks.pack_blocks(df, blocks.word_tokens(F.col("text")), 16, 0, span=span).collect()}
    ids = [i for t in texts for i in [*(len(w) for w in t.split()), 0]]
    assert got == {k: ids[16 * k : 16 * k + 16] for k in range(len(ids) // 16)}


def test_packed_once_and_library_tokens(spark):
    pytest.importorskip("tokenizers")
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(0, "one two"), (1, None), (2, "three")], "pos long, text string")
    made = []

    def make():
        made.append(1)
        return blocks.pack_blocks(df, blocks.library_tokens(path)(F.col("text")), 2, 0)

    once = blocks.PackedOnce(spark)
    assert once.blocks("a", make).collect() == once.blocks("a", make).collect() and len(made) == 1
    from tokenizers import Tokenizer

    ids = [i for t in ("one two", "", "three") for i in [*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 0]]
    assert [x for r in once.blocks("a", make).orderBy("block_id").collect() for x in r["tokens"]] == ids[: len(ids) // 2 * 2]


def narrow(most, never=-1):
    """A model that fails where a batch has more than ``most`` rows, or any row of a word that is never scored."""

    class Narrow(Q.PairModel):
        def log_probs(self, ids, mask):
            if len(ids) > most or (ids == never).any():
                raise MemoryError
            assert (mask.sum(1)[1:] >= mask.sum(1)[:-1]).all()  # the shortest first
            return Q.PairModel.log_probs(self, ids, mask)

    return Narrow()


def test_log_likelihoods_in_the_order_given():
    rng = random.Random(2)
    words = lambda n: " ".join("x" * rng.randint(1, 9) for _ in range(n))
    contexts, after = [words(rng.randint(1, 9)) for _ in range(30)], [words(rng.randint(0, 4)) for _ in range(30)]
    weight = lambda i, j: 1 + (i * 7 + j * 3) % 5
    want = []
    for c, t in zip(contexts, after):
        ids = [len(w) for w in f"{c} {t}".split()]
        at = len(c.split())
        want.append((sum(np.log(weight(a, b) / sum(weight(a, v) for v in range(16))) for a, b in zip(ids[at - 1 :], ids[at:])), len(t.split())))
    for batch in (1, 4, 100):
        total, n = likelihood.log_likelihoods(contexts, after, Q.PairModel(), batch)
        assert list(n) == [b for _, b in want] and total == pytest.approx([a for a, _ in want])
    with pytest.raises(ValueError):
        likelihood.log_likelihoods([""], ["a"], Q.PairModel(), 1)


def test_task_skips_buckets_that_never_fit(spark):
    docs = Q.quiz(spark, SF)
    whole, skipped = likelihood.predict_task(docs, Q.PairModel(), "m", "quiz")
    few, none = likelihood.predict_task(docs, narrow(1), "m", "quiz", batch=8)
    columns = ["doc_id", "bucket", "predicted", "correct"]
    assert sorted(whole.select(columns).collect()) == sorted(few.select(columns).collect()) and skipped.isEmpty() and none.isEmpty()
    odd = docs.withColumn("context", F.when(F.col("bucket") == "subject1", F.concat("context", F.lit(" " + "x" * 15))).otherwise(F.regexp_replace("context", r"\b\w{15}\b", "word")))
    rows, skipped = likelihood.predict_task(odd.repartition(1), narrow(100, never=15), "m", "quiz")
    assert {r["bucket"] for r in skipped.collect()} >= {"subject1"} and rows.where("bucket = 'subject1'").isEmpty()
    assert likelihood.task_results(rows.limit(0)) is None and likelihood.task_results(whole).count() == 6


def plain_split(rows, sizes, seed=42):
    """The published method by dictionaries: the rarest label first, each of its rows to the split that lacks it most, then has most room."""
    names, n = list(sizes), len(rows)
    order = sorted(range(n), key=lambda k: hashlib.md5(f"{seed}:{rows[k]['doc_id']}".encode()).hexdigest())
    have = [[(d, str(r[d])) for d in DIMENSIONS] for r in rows]
    labels = sorted({x for own in have for x in own}, key=lambda x: (DIMENSIONS.index(x[0]), x[1]))
    left = {x: [k for k in order if x in have[k]] for x in labels}
    lacks = {x: {s: sizes[s] / n * len(left[x]) for s in names} for x in labels}
    room, out = dict(sizes), {}
    while any(left.values()):
        rare = min((x for x in labels if left[x]), key=lambda x: len(left[x]))
        for k in list(left[rare]):
            pick = max((s for s in names if room[s] > 0), key=lambda s: (lacks[rare][s], room[s], -names.index(s)))
            out[rows[k]["doc_id"]] = pick
            room[pick] -= 1
            for x in have[k]:
                lacks[x][pick] -= 1
                left[x].remove(k)
    return out


def marginals(rows, split):
    out = Counter()
    for r in rows:
        out.update((split[r["doc_id"]], d, r[d]) for d in DIMENSIONS)
    return out


def test_stratified_query_is_as_even_as_the_greedy_method(spark):
    got = {r["doc_id"]: r["split"] for r in registry.queries()["stratified_split"](spark, SF).collect()}
    rows = [r.asDict() for r in Q.annotated(spark, SF).collect()]
    assert len(got) == len(rows)
    for lang in {r["language"] for r in rows}:
        own = sorted((r for r in rows if r["language"] == lang), key=lambda r: r["doc_id"])
        n = len(own)
        sizes = dict(zip(("train", "dev", "test"), split.exact_sizes({"train": 0.8, "dev": 0.1, "test": 0.1}, n), strict=True))
        assert Counter(got[r["doc_id"]] for r in own) == +Counter(sizes)
        mine, greedy = marginals(own, got), marginals(own, plain_split(own, sizes))
        ideal = {(s, *x): c * sizes[s] / n for s in sizes for x, c in Counter((d, r[d]) for r in own for d in DIMENSIONS).items()}
        off = lambda found: [abs(found[k] - x) for k, x in ideal.items()]
        assert max(off(mine)) <= max(off(greedy)) + 1 and np.mean(off(mine)) <= np.mean(off(greedy)) + 0.05


def test_dealing_at_once_is_dealing_one_by_one():
    rng = np.random.default_rng(4)
    for _ in range(300):
        room = rng.integers(0, 30, 4)
        lacking = rng.uniform(-5, 20, 4) if rng.random() < 0.7 else rng.integers(-5, 20, 4) / 2
        n = int(rng.integers(0, room.sum() + 1))
        out = np.zeros(4, np.int64)
        for _ in range(n):
            out[max((s for s in range(4) if out[s] < room[s]), key=lambda s: (lacking[s] - out[s], room[s] - out[s], -s))] += 1
        found = split.dealt(n, lacking, room)
        assert found.sum() == n and (found <= room).all() and np.abs(found - out).max() <= 1  # ties of lacking go by room


def test_sharing_out_keeps_both_sums():
    rng = np.random.default_rng(5)
    for _ in range(300):
        counts = rng.integers(0, 40, rng.integers(1, 30))
        cuts = np.sort(rng.integers(0, counts.sum() + 1, 3))
        shares = np.diff([0, *cuts, counts.sum()])
        have = [[k % 3, 3 + k % 2] for k in range(len(counts))]
        want = np.array([sum(n for n, own in zip(counts, have, strict=True) if x in own) * shares / max(counts.sum(), 1) for x in range(5)])
        lacking = want.copy()
        found = split.shared_out(counts.tolist(), shares, have, lacking, np.maximum(want, 1e-9))
        assert (found >= 0).all() and (found.sum(axis=1) == counts).all() and (found.sum(axis=0) == shares).all()
        for x in range(5):
            assert np.allclose(lacking[x], want[x] - sum(row for row, own in zip(found, have, strict=True) if x in own))


def test_large_sets_are_cut_at_their_bounds(spark):
    df = spark.range(40_000).selectExpr("id AS doc_id", "if(id % 2 = 0, 'vi', null) AS language", "1 AS unused")
    labels = F.when(F.col("doc_id") % 4 < 2, F.array(F.lit("a"))).when(F.col("doc_id") % 8 < 6, F.array(F.lit("b"), F.lit("a")))
    got = split.stratified_split(df, {"x": 0.25, "y": 0.5, "z": 0.25}, labels=labels)
    sizes = {(r["language"], r["split"]): r["count"] for r in got.groupBy("language", "split").count().collect()}
    assert sizes == {(a, b): n for a in ("vi", None) for b, n in (("x", 5000), ("y", 10000), ("z", 5000))}
    sets = {tuple(r)[:3]: r["count"] for r in got.withColumn("s", labels).groupBy("language", "split", "s").count().withColumn("s", F.to_json("s")).collect()}
    assert sets["vi", "y", '["a"]'] == 5000 and sets[None, "x", '["b","a"]'] == 1250
    assert sorted(got.collect(), key=str) == sorted(split.stratified_split(df.repartition(7), {"x": 0.25, "y": 0.5, "z": 0.25}, labels=labels).collect(), key=str)
    assert split.stratified_split(df.limit(0), {"x": 0.5, "y": 0.5}, labels=labels).count() == 0


def test_exact_sizes_and_a_split_to_drop(spark):
    rows = [(k, "vi", *(k % 3 for _ in DIMENSIONS)) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, language string, " + ", ".join(f"{d} int" for d in DIMENSIONS))
    got = split.stratified_split(df, {"train": 12, "dev": 3, "drop": 5})
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 12, "dev": 3}
    with pytest.raises(ValueError):
        split.exact_sizes({"train": 3, "dev": 3}, 7)


def test_a_missing_bucket_is_an_error(spark):
    rows = [("base", "t", "a", "accuracy", 0.5), ("base", "t", "b", "accuracy", 0.25), ("random", "t", "a", "accuracy", 0.75), ("random", "t", "b", "accuracy", 0.5)]
    make = lambda r: spark.createDataFrame(r, "model string, task string, bucket string, metric string, value double")
    assert sorted(r["delta"] for r in evaluate.bucket_deltas(make(rows)).collect()) == [0.25, 0.25]
    with pytest.raises(Exception, match="random has no accuracy of t for b"):
        evaluate.bucket_deltas(make(rows[:3])).collect()
    text = evaluate.summary_markdown(evaluate.summary(make(rows)))
    assert "| base | 0.3750 | 0.2500 | — |" in text and "| random | 0.6250 | 0.5000 | +66.67% |" in text


def test_files_by_bucket_and_by_language(spark, tmp_path):
    docs = spark.createDataFrame([("c", ["A"], "vi", "é"), ("d", ["A"], "th", None)], "context string, choices array<string>, bucket string, note string").withColumns({"model": F.lit("m"), "task": F.lit("t")})
    writers.bucketed(docs, str(tmp_path / "a"), ["model", "task"])
    writers.bucketed(docs.where("bucket = 'vi'").withColumn("context", F.lit("new")), str(tmp_path / "a"), ["model", "task"])
    lines = [json.loads(x) for p in sorted((tmp_path / "a/model=m/task=t").glob("bucket=*/*.json")) for x in p.read_text(encoding="utf-8").splitlines()]
    assert [x["context"] for x in lines] == ["d", "new"] and lines[0]["note"] is None
    writers.bucketed(docs, str(tmp_path / "b"), ["model", "task"], combined=True)
    assert {r["bucket"] for r in readers.json_lines(spark, str(tmp_path / "b"), "context string, bucket string, model string, task string", task="t").collect()} == {"vi", "th"}
    rows = spark.createDataFrame([("W01", "vi", "d1", "clean", 1.0, 2.0, "text", 9)], "weight_id string, language string, doc_id string, source string, weighted_score double, estimated_tokens double, text string, extra int")
    writers.selected_records(rows, str(tmp_path / "s"))
    record = json.loads(next((tmp_path / "s/weight_id=W01/lang=vi").glob("*.json")).read_text())
    assert record == {"doc_id": "d1", "language": "vi", "source": "clean", "weighted_score": 1.0, "estimated_tokens": 2.0, "text": "text"}


def test_loaders(spark, tmp_path):
    (tmp_path / "r.csv").write_text("weight_id,w_educational_value,loss_vi,macro_loss\nW01,0.5,2.25,2.5\n")
    names = ["weight_id", *(f"w_{d}" for d in DIMENSIONS), "loss_vi", "macro_loss", "worst_language_loss"]
    (tmp_path / "p.csv").write_text(",".join(names) + "\nW01," + ",".join(["0.2"] * 5) + ",2.25,2.5,3\n")
    row = readers.proxy_results(spark, str(tmp_path / "p.csv"), ["vi"]).first()
    assert row["weight_id"] == "W01" and row["loss_vi"] == 2.25 and row["worst_language_loss"] == 3.0
    assert readers.text_csv(spark, str(tmp_path / "r.csv")).first()["macro_loss"] == "2.5"
    spark.createDataFrame([("q", "a")], "text string, category string").write.parquet(str(tmp_path / "b/vie_Latn"))
    got = readers.benchmark_rows(spark, str(tmp_path / "b"), {"vi": "vie_Latn", "th": "tha_Thai"}, "text string, category string").collect()
    assert [(r["text"], r["bucket"]) for r in got] == [("q", "vi")]
    assert readers.benchmark_rows(spark, str(tmp_path / "none"), {"vi": "x"}, "text string").columns == ["text", "bucket"]
    assert list(evaluate.with_files(spark, {"a": str(tmp_path / "b"), "c": str(tmp_path / "nothing")})) == ["a"]
    doc = {"context": "c", "choices": ["A"], "choice_texts": ["x"], "gold": 0, "subject": "s"}
    (tmp_path / "quiz.jsonl").write_text(json.dumps(doc) + "\n")
    assert readers.downstream(spark, str(tmp_path), "quiz", per_language=False).first()["bucket"] == "s"
    with pytest.raises(Exception):
        readers.downstream(spark, str(tmp_path), "missing", per_language=False).collect()
    spark.createDataFrame([("d", "vi", [0.5, 0.25], *([1.0] * 5))], "doc_id string, language string, embedding array<float>, " + ", ".join(f"{d} float" for d in DIMENSIONS)).write.parquet(str(tmp_path / "e"))
    assert readers.embeddings(spark, str(tmp_path / "e")).first()["embedding"] == [0.5, 0.25]
    spark.createDataFrame([("a", "train"), ("b", "dev")], "text string, split string").write.partitionBy("split").json(str(tmp_path / "splits"))
    assert [r["text"] for r in readers.split_rows(spark, str(tmp_path / "splits"), "text string, split string", "dev").collect()] == ["b"]
    rater.save_report(spark, str(tmp_path / "report"), best=0.5)
    assert spark.read.json(str(tmp_path / "report")).first()["best"] == 0.5


def test_languages_in_order(spark):
    assert corpus.chosen_languages(["th", "vi"]) == ["vi", "th"]
    with pytest.raises(ValueError, match="xx"):
        corpus.chosen_languages(["xx"])
    one = lambda t: spark.createDataFrame([(t,)], "t string")
    assert [tuple(r) for r in corpus.union_languages({"th": one("b"), "vi": one("a")}).collect()] == [("a", "vi", 0), ("b", "th", 1)]


def test_a_cluster_without_a_shared_folder_is_an_error():
    from gristmill.storage import shared_folder

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(Conf)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())


@pytest.mark.parametrize("missing,fails", [("corpus_pipeline", False), ("gristmill.llm", False), ("xxhash", True)])
def test_the_entry_hides_only_a_missing_subpackage(monkeypatch, missing, fails):
    import builtins
    import importlib

    import __spark_entry__

    real = builtins.__import__

    def no(name, *rest, **more):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {missing!r}", name=missing)
        return real(name, *rest, **more)

    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    monkeypatch.setattr(builtins, "__import__", no)
    if fails:
        with pytest.raises(ImportError):
            importlib.reload(__spark_entry__)
    else:
        importlib.reload(__spark_entry__)
        assert "select_for_weight" in __spark_entry__.queries() and not any(n.startswith("op1_") for n in __spark_entry__.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


def test_rows_of_one_length_go_together_over_the_whole_table(spark):
    rng = random.Random(8)
    rows = [(k, "x" * rng.choice([5, 5, 5, *range(1, 400)]), "y") for k in range(4000)]
    df = spark.createDataFrame(rows, "k int, a string, b string").repartition(8)
    sizes = lambda d: [[len(r["a"]) + 1 for r in part] for part in d.rdd.glom().collect()]
    dealt = likelihood.dealt_by_length(df, "a", "b")
    assert dealt.columns == df.columns and sorted(dealt.collect()) == sorted(df.collect())
    whole, before = sizes(dealt), sizes(df)
    assert all(p == sorted(p) for p in whole)
    share = lambda parts: sum(likelihood.padding(p, 16) * len(p) for p in parts if p) / 4000
    assert share(whole) < 0.02 < 0.4 < share(before)
    hot = likelihood.dealt_by_length(spark.range(3000).selectExpr("cast(id as string) AS k", "lpad(id, 5, '0') AS a"), "a")
    assert max(len(p) for p in hot.rdd.glom().collect()) < 2000  # one length in many partitions
