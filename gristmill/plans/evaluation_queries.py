"""Metric, proxy, evaluation, packing and model queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gristmill.constants import ANSWER_LINE, BASELINES, DIMENSIONS, LETTERS, TOPICS
from gristmill.functions import scoring
from gristmill.functions.normalize import nfc
from gristmill.operators import blocks as B
from gristmill.operators import corpus as C
from gristmill.operators import evaldata as D
from gristmill.operators import evaluate as E
from gristmill.operators import likelihood as L
from gristmill.operators import metrics as M
from gristmill.operators import rater as R
from gristmill.operators.split import stratified_split
from gristmill.plans.base import CAND, FORMULA, WEIGHTS_SQL, scored
from gristmill.plans.proxy_queries import PAIRS, RECORDED, baseline_losses_sql, loss_rows
from gristmill.session import constants, load

MODELS = ["base", *BASELINES]


def values(name, columns, rows):
    return f"{name}({', '.join(columns)}) AS (VALUES " + ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows) + ")"


# ---- annotations: integer scores (truth) and formula scores (predicted) of each dimension


def rated(spark, sf):
    """(language, dimension, score, predicted)."""
    whole = {d: F.struct((F.round(F.col(d) * 100).cast("int") % 6).cast("double").alias("score"), F.col(d).alias("predicted")) for d in DIMENSIONS}
    rows = scored(spark, sf).select("language", F.explode(F.map_from_arrays(F.array(*map(F.lit, whole)), F.array(*whole.values()))).alias("dimension", "r"))
    return rows.select("language", "dimension", "r.*")


def annotated(spark, sf):
    """Candidates with integer scores, and a split by id."""
    rows = scored(spark, sf).withColumns({d: F.round(F.col(d) * 100).cast("int") % 6 for d in DIMENSIONS})
    tenth = F.col("doc_id") % 10
    return rows.withColumn("split", F.when(tenth < 8, "train").when(tenth == 8, "dev").otherwise("test"))


RATED = f"WITH {CAND}, rated AS (" + " UNION ALL ".join(f"SELECT language, doc_id, '{d}' AS dimension, CAST((doc_id * {a} + char_len * {b}) % 501 % 6 AS INT) AS score, {d} AS predicted FROM scored" for d, (a, b) in FORMULA.items()) + ")"
SPLIT = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'dev' ELSE 'test' END"
RHO = f"""{RATED}, k AS (SELECT language, dimension,
  rank() OVER (PARTITION BY language, dimension ORDER BY score) + (count(*) OVER (PARTITION BY language, dimension, score) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY language, dimension ORDER BY predicted) + (count(*) OVER (PARTITION BY language, dimension, predicted) - 1) / 2.0 AS b FROM rated),
c AS (SELECT language, dimension, corr(a, b) AS spearman FROM k GROUP BY ALL)"""


def spearman_cells(spark, sf):
    return M.spearman(rated(spark, sf), ["language", "dimension"], "score", "predicted")


def spearman_by_group(spark, sf):
    return spearman_cells(spark, sf).withColumn("spearman", F.round("spearman", 9))


def macro_worst_spearman(spark, sf):
    out = M.spearman_summary(spearman_cells(spark, sf))
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


def huber_loss(spark, sf):
    rows = rated(spark, sf).withColumn("loss", scoring.huber(F.col("predicted"), F.col("score"), 1.0))
    return rows.groupBy("dimension").agg(F.avg("loss").alias("l")).select("dimension", F.round("l", 9).alias("huber"))


def batch_losses(spark, sf):
    """Losses of batches of 16 documents; the last batch of a language is shorter."""
    rows = scored(spark, sf).groupBy("language", F.floor(F.col("doc_id") / 16).alias("batch")).agg(F.avg("reasoning").alias("loss"), F.count("*").alias("n"))
    both = M.batch_mean(rows, ["language"]).withColumnRenamed("mean_loss", "by_batch").join(M.sample_mean(rows, ["language"]).withColumnRenamed("mean_loss", "by_row"), "language")
    return both.select("language", F.round("by_batch", 9).alias("by_batch"), F.round("by_row", 9).alias("by_row"))


# ---- multiple choice


def questions(spark, sf):
    """Benchmark items as questions: their first four words are the choices."""
    words = F.split("text", " ")
    rows = load(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("item_id").alias("pos"), F.col("text").alias("question"), F.slice(words, 1, 4).alias("choices"), (F.col("item_id") % 4).cast("int").alias("answer"))
    return rows.withColumn("subject", F.concat(F.lit("subject"), (F.col("doc_id") % 3).cast("string")))


def mcq(spark, sf):
    return D.subject_docs(questions(spark, sf))


def _listed(choices):
    return " || ".join(f"chr(10) || '{LETTERS[k]}. ' || {c}" for k, c in enumerate(choices))


CONTEXT = f"text || {_listed([f'w[{k}]' for k in range(1, 5)])} || chr(10) || '{ANSWER_LINE}' || chr(10) || 'Answer:'"
MCQ = f"mcq AS (SELECT item_id AS doc_id, item_id AS pos, {CONTEXT} AS context, w, CAST(item_id % 4 AS INT) AS gold, 'subject' || (item_id % 3) AS subject FROM (SELECT *, string_split(text, ' ') AS w FROM benchmark))"
EXEMPLAR = f"context || ' ' || substr('{''.join(LETTERS)}', gold + 1, 1) || chr(10) || chr(10)"


def topic_docs(spark, sf):
    category = F.element_at(F.array(*map(F.lit, TOPICS)), (F.col("item_id") % len(TOPICS)).cast("int") + 1)
    rows = load(spark, sf, "benchmark").select("item_id", "text", category.alias("category"))
    return D.topic_docs(rows).select("item_id", F.md5("context").alias("context_md5"), "gold")


def passage_docs(spark, sf):
    words = F.split("text", " ")
    rows = load(spark, sf, "benchmark").select("item_id", F.col("text").alias("flores_passage"), F.element_at(words, 1).alias("question"), *(F.element_at(words, k).alias(f"mc_answer{k}") for k in range(1, 5)), (F.col("item_id") % 4 + 1).cast("string").alias("correct_answer_num"))
    return D.passage_docs(rows).select("item_id", F.md5("context").alias("context_md5"), "gold")


def fewshot_prefix(spark, sf):
    held, _ = D.hold_out(mcq(spark, sf), ["subject"], 2)
    return D.fewshot_prefix(held, ["subject"])


def holdout_exemplars(spark, sf):
    held, rest = D.hold_out(mcq(spark, sf), ["subject"], 2)
    return D.with_prefix(rest, D.fewshot_prefix(held, ["subject"]), ["subject"]).select("doc_id", "subject", F.md5("context").alias("context_md5"), "gold")


HELD = f"WITH {MCQ}, n AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY pos) AS k, count(*) OVER (PARTITION BY subject) AS c FROM mcq), p AS (SELECT subject, string_agg({EXEMPLAR}, '' ORDER BY pos) AS prefix FROM n WHERE k <= least(2, c - 1) GROUP BY subject)"


def model_rows(spark):
    return constants(spark, list(enumerate(MODELS)), "model_pos int, model string")


def choice_scores(spark, sf):
    """A deterministic stand-in for a model's scores."""
    rows = E.choice_rows(mcq(spark, sf)).crossJoin(F.broadcast(model_rows(spark)))
    value = -((F.col("doc_id") * 7 + F.col("choice") * 13 + F.col("model_pos") * 5) % 17 + 1) / 4.0
    return rows.select("model", "doc_id", "choice", value.alias("sum_log_prob"), (1 + F.col("choice") % 2).alias("num_tokens"))


def predictions(spark, sf):
    return E.predictions(mcq(spark, sf), choice_scores(spark, sf)).withColumn("task", F.lit("quiz")).withColumnRenamed("subject", "bucket")


def mcq_predictions(spark, sf):
    columns = ("doc_id", "model", "bucket", "predicted", "predicted_letter", "predicted_choice", "gold_letter", "gold_choice", "correct")
    return predictions(spark, sf).select(*columns, F.round("token_normalized_prob_correct", 9).alias("token_normalized_prob_correct"))


MODELS_SQL = values("models", ["model_pos", "model"], list(enumerate(MODELS)))
PREDICTED = f"""WITH {CAND}, {MCQ}, {MODELS_SQL},
s AS (SELECT *, unnest(range(4)) AS choice FROM mcq CROSS JOIN models),
v AS (SELECT *, -((doc_id * 7 + choice * 13 + model_pos * 5) % 17 + 1) / 4.0::DOUBLE AS lp, 1 + choice % 2 AS n FROM s),
p AS (SELECT doc_id, model, subject AS bucket, any_value(w) AS w, any_value(gold) AS gold, CAST(arg_max(choice, lp * 100 - choice) AS INT) AS predicted, max(CASE WHEN choice = gold THEN exp(lp / n) END) AS prob FROM v GROUP BY ALL),
r AS (SELECT model, 'quiz' AS task, bucket, metric, value FROM (SELECT model, bucket, avg((predicted = gold)::INT) AS accuracy, avg(prob) AS token_normalized_prob_correct FROM p GROUP BY ALL) UNPIVOT (value FOR metric IN (accuracy, token_normalized_prob_correct)))"""


LOSS_ROWS = f"{WEIGHTS_SQL}, {PAIRS}, {baseline_losses_sql(repr(RECORDED))}, q AS (SELECT model, 'held_out' AS task, language AS bucket, 'perplexity' AS metric, exp(loss) AS value FROM losses2)"


def results(spark, sf):
    table = E.bucket_metrics(predictions(spark, sf))
    return table.unionByName(E.perplexities(loss_rows(spark, sf)).select(*table.columns))


RESULTS = f"{PREDICTED}, {LOSS_ROWS}, a AS (SELECT model, task, bucket, metric, value FROM r UNION ALL SELECT model, task, bucket, metric, value FROM q)"
TOTALS = f"{RESULTS}, t AS (SELECT model, task, metric, avg(value) AS macro, CASE WHEN metric = 'perplexity' THEN max(value) ELSE min(value) END AS worst, count(*) AS n_buckets FROM a GROUP BY model, task, metric), b AS (SELECT task, metric, macro AS base_macro FROM t WHERE model = 'base'), i AS (SELECT t.model, t.task, t.metric, t.macro, base_macro, CASE WHEN t.metric = 'perplexity' THEN (base_macro - t.macro) / nullif(base_macro, 0) ELSE (t.macro - base_macro) / nullif(base_macro, 0) END AS relative_improvement FROM t JOIN b ON t.task = b.task AND t.metric = b.metric WHERE model <> 'base')"


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


def bucket_rollup(spark, sf):
    return rounded(E.rollup(E.bucket_metrics(predictions(spark, sf))), "macro", "worst")


def relative_improvement(spark, sf):
    return rounded(E.improvements(results(spark, sf)), "macro", "base_macro", "relative_improvement")


def bucket_deltas(spark, sf):
    return rounded(E.bucket_deltas(results(spark, sf)), "delta")


def macro_deltas(spark, sf):
    return rounded(E.macro_deltas(results(spark, sf)), "delta")


def _halves(rows):
    """A store that has base and two buckets of the first baseline, and a run with new values for some of them and for others."""
    first = rows.where((F.col("model") == "base") | ((F.col("model") == "random") & ~F.col("bucket").isin("subject2")))
    second = rows.where((F.col("model") == "random") & ~F.col("bucket").isin("subject0")).withColumn("value", F.col("value") + 1)
    return first, second


def merge_results(spark, sf):
    return rounded(E.merge(*_halves(results(spark, sf))), "value").select("model", "task", "bucket", "metric", "value")


def skip_done_buckets(spark, sf):
    rows = results(spark, sf)  # once: the models behind it are fitted when it is called
    return E.remaining(rows.select(*E.KEYS).distinct(), _halves(rows)[0])


FIRST = "(model = 'base' OR (model = 'random' AND bucket <> 'subject2'))"


def report_rows(spark, sf):
    return rounded(E.summary(results(spark, sf)), "macro", "worst")


def missing_baselines(spark, sf):
    return E.missing_baselines(_halves(results(spark, sf))[0])


def pack_blocks(spark, sf):
    docs = load(spark, sf, "documents").withColumn("pos", F.col("doc_id"))
    packed = B.pack_blocks(docs, B.word_tokens(F.col("text")), 128, 0)
    return packed.select("block_id", F.md5(F.array_join(F.transform("tokens", lambda x: x.cast("string")), ",")).alias("tokens_md5"))


BLOCKS = r"""WITH w AS (SELECT doc_id, list_append(list_transform(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''), lambda x: length(x)), 0) AS ids FROM documents),
u AS (SELECT doc_id, unnest(ids) AS id, unnest(range(len(ids))) AS k FROM w),
r AS (SELECT id, row_number() OVER (ORDER BY doc_id, k) - 1 AS n FROM u)
SELECT CAST(n // 128 AS BIGINT) AS block_id, md5(string_agg(id, ',' ORDER BY n)) AS tokens_md5 FROM r GROUP BY n // 128 HAVING count(*) = 128"""


def l2_normalize(spark, sf):
    v = scoring.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3))
    rows = load(spark, sf, "embeddings").select("vec_id", v.alias("v"))
    return rows.select("vec_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def head_inference(spark, sf):
    rows = R.infer(load(spark, sf, "embeddings").select("vec_id", "embedding"), R.simple_heads(64))
    return rows.select("vec_id", *(F.round(d, 6).alias(d) for d in DIMENSIONS))


HEADS = "SELECT vec_id, " + ", ".join(f"round(greatest(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * (((i - 1) * 7 + {k} * 3) % 11 - 5) / 8.0::DOUBLE)) + {k} / 4.0::DOUBLE, 0) * {1.5 + k}::DOUBLE - {k} / 8.0::DOUBLE, 6) AS {d}" for k, d in enumerate(DIMENSIONS)) + " FROM embeddings"


def head_training(spark, sf):
    """Heads trained on four fifths of the embeddings, and whether each ranks the rest well. What they learn are weighted components of the vectors."""
    at = lambda k: F.element_at("embedding", k + 1)
    rows = load(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 8).alias("embedding"))
    rows = rows.select("*", *((2.5 + 2 * at(k) - at(k + 5)).alias(d) for k, d in enumerate(DIMENSIONS)))
    held = rows.where(F.col("vec_id") % 5 == 0)
    heads, _ = R.train(rows.where(F.col("vec_id") % 5 != 0), held, hidden=16, epochs=24, every=12, rate=0.05)
    pairs = R.long_pairs(R.infer(held.select("embedding", *(F.col(d).alias(f"t{k}") for k, d in enumerate(DIMENSIONS))), heads), DIMENSIONS)
    sums = pairs.groupBy("dimension").agg(F.count("*").alias("n_held"))
    return M.spearman(pairs, ["dimension"], "target", "predicted").join(sums, "dimension").select("dimension", "n_held", (F.col("spearman") > 0.7).alias("learned"))


def stratified(spark, sf):
    """The split of each annotated row; SQL can't express the method, so tests hold it against the greedy one and its plan against plain loops."""
    rows = annotated(spark, sf).drop("split").select("doc_id", "language", *DIMENSIONS)
    return stratified_split(rows, {"train": 0.8, "dev": 0.1, "test": 0.1}).select("doc_id", "language", "split")


def stratified_marginals(spark, sf):
    """Sizes of the splits, and of each label the most by which a split's count is off its share."""
    rows = annotated(spark, sf).drop("split").select("doc_id", "language", *DIMENSIONS)
    split = stratified_split(rows, {"train": 0.8, "dev": 0.1, "test": 0.1})
    sizes = split.groupBy("language", "split").agg(F.count("*").alias("n_rows"))
    counts = M.long_scores(split, ["language", "split"]).groupBy("language", "split", "dimension", "score").agg(F.count("*").alias("n"))
    labels = M.long_scores(rows, ["language"]).groupBy("language", "dimension", "score").agg(F.count("*").alias("total"))
    every = labels.join(sizes, "language").join(rows.groupBy("language").agg(F.count("*").alias("of")), "language").join(counts, ["language", "split", "dimension", "score"], "left")
    off = F.max(F.abs(F.coalesce("n", F.lit(0)) - F.col("total") * F.col("n_rows") / F.col("of")))
    return every.groupBy("language", "split").agg(F.any_value("n_rows").alias("n_rows"), F.count("*").alias("n_labels"), (off < 3.0).alias("balanced"))


def nfc_normalize(spark, sf):
    # decomposed first, so that there is something to compose
    docs = load(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "é", "é").alias("text"))
    return docs.select("doc_id", F.md5(nfc("text")).alias("text_md5"))


def record_projection(spark, sf):
    docs = load(spark, sf, "documents")
    raw = docs.select(F.concat(F.lit("<urn:uuid:"), F.col("doc_id").cast("string"), F.lit(">")).alias("id"), F.col("lang").alias("language"), "text", *(F.lit("3").alias(c) for c in ("educational_value", "reasoning", "professionalism", "cleanliness", "cultural_nuances")), "source", F.lit("b").alias("len_bucket"), F.lit("c").alias("lang_bucket"), F.col("n_chars").cast("string").alias("char_len"))
    return C.record_of(raw).drop("text")


def signed_percents(spark, sf):
    return E.improvements(results(spark, sf)).select("model", "task", "metric", scoring.signed_percent(F.round("relative_improvement", 6)).alias("vs_base"))


def nested_results(spark, sf):
    """What the documents of all models hold, read back from their JSON."""
    read = E.nested(results(spark, sf)).select("model", F.from_json("document", E.DOCUMENT).alias("d"))
    tasks = read.select("model", F.explode("d").alias("task", "metrics")).select("model", "task", F.explode("metrics").alias("metric", "c"))
    out = tasks.select("model", "task", "metric", F.explode("c.buckets").alias("bucket", "value"), "c.macro", "c.worst", "c.relative_improvement")
    return rounded(out, "value", "macro", "worst", "relative_improvement")


class PairModel:
    """A stand-in for a language model: a word is the id of its length modulo 16, and the next id depends on the one before alone."""

    pad_id = 0

    def encode(self, texts):
        return [[len(w) % 16 for w in t.split(" ") if w] for t in texts]

    def log_probs(self, ids, mask):
        weight = 1 + (np.arange(16)[:, None] * 7 + np.arange(16)[None, :] * 3) % 5
        return np.log(weight / weight.sum(1, keepdims=True))[ids]


def quiz(spark, sf):
    """Benchmark items as questions whose continuations are scored after their own text."""
    return mcq(spark, sf).withColumn("context", F.col("question")).withColumnRenamed("subject", "bucket")


def choice_log_likelihood(spark, sf):
    rows = L.score_continuations(E.choice_rows(quiz(spark, sf).select("doc_id", "context", "choices", "choice_texts")), PairModel(), batch=3, continuation_col="continuation")
    return rounded(rows.select("doc_id", "choice", "sum_log_prob", "num_tokens"), "sum_log_prob")


def task_rollup(spark, sf):
    """Totals of a task that the plug-in model answers."""
    predicted, _ = L.predict_task(quiz(spark, sf), PairModel(), "pairs", "quiz", batch=5)
    return rounded(E.rollup(E.bucket_metrics(predicted)), "macro", "worst")


_W = "(1 + (({0}) * 7 + ({1}) * 3) % 5)"
LIKELY = f"""WITH q AS (SELECT item_id AS doc_id, CAST(item_id % 4 AS INT) AS gold, 'subject' || (item_id % 3) AS bucket, length(list_filter(string_split(text, ' '), lambda x: x <> '')[-1]) % 16 AS i FROM benchmark),
c AS (SELECT *, unnest(range(4)) AS choice FROM q),
l AS (SELECT *, ln({_W.format('i', '1')} / list_sum(list_transform(range(16), lambda v: {_W.format('i', 'v')}))::DOUBLE) AS lp FROM c)"""


def macro_huber(spark, sf):
    return rounded(M.mean_over_dimensions(huber_loss(spark, sf), "huber"), "huber")


_R = "round({0}, 9) AS {0}"
QUERIES = {
    "split_counts": (lambda spark, sf: M.split_counts(annotated(spark, sf)), f"WITH {CAND} SELECT {SPLIT} AS split, language, count(*) AS n FROM cand GROUP BY ALL"),
    "score_counts": (lambda spark, sf: M.score_counts(annotated(spark, sf)), f"{RATED} SELECT {SPLIT} AS split, dimension, score, count(*) AS n FROM rated GROUP BY ALL"),
    "score_histogram": (lambda spark, sf: M.score_histogram(annotated(spark, sf)).select("language", "dimension", F.array_join(F.transform("histogram", lambda x: x.cast("string")), ",").alias("histogram")), f"{RATED} SELECT language, dimension, concat_ws(',', {', '.join(f'count(*) FILTER (score = {k})' for k in range(6))}) AS histogram FROM rated GROUP BY ALL"),
    "spearman_by_group": (spearman_by_group, f"{RHO} SELECT language, dimension, round(spearman, 9) AS spearman FROM c"),
    "macro_worst_spearman": (macro_worst_spearman, f"{RHO} SELECT round((SELECT avg(spearman) FROM c), 9) AS macro_spearman, round((SELECT min(m) FROM (SELECT avg(spearman) AS m FROM c GROUP BY language)), 9) AS worst_language_spearman"),
    "mae_by_dimension": (lambda spark, sf: rounded(M.mae_by_dimension(rated(spark, sf)), "mae"), f"{RATED} SELECT dimension, round(avg(m), 9) AS mae FROM (SELECT language, dimension, avg(abs(score - predicted)) AS m FROM rated GROUP BY ALL) GROUP BY dimension"),
    "huber_loss": (huber_loss, f"{RATED}, h AS (SELECT dimension, abs(predicted - score) AS d FROM rated) SELECT dimension, round(avg(CASE WHEN d <= 1 THEN 0.5::DOUBLE * d * d ELSE d - 0.5::DOUBLE END), 9) AS huber FROM h GROUP BY dimension"),
    "batch_losses": (batch_losses, f"WITH {CAND}, b AS (SELECT language, doc_id // 16 AS batch, avg(reasoning) AS loss, count(*) AS n FROM scored GROUP BY ALL) SELECT language, round(avg(loss), 9) AS by_batch, round(sum(loss * n) / sum(n), 9) AS by_row FROM b GROUP BY language"),
    "mcq_context": (lambda spark, sf: mcq(spark, sf).select("doc_id", "context", "gold"), f"WITH {MCQ} SELECT doc_id, context, gold FROM mcq"),
    "topic_docs": (topic_docs, f"SELECT item_id, md5(text || chr(10) || 'Question: What is the topic of this sentence?' || {_listed([repr(t) for t in TOPICS])} || chr(10) || '{ANSWER_LINE}' || chr(10) || 'Answer:') AS context_md5, CAST(item_id % 7 AS INT) AS gold FROM benchmark"),
    "passage_docs": (passage_docs, f"SELECT item_id, md5(text || chr(10) || 'Question: ' || w[1] || {_listed([f'w[{k}]' for k in range(1, 5)])} || chr(10) || '{ANSWER_LINE}' || chr(10) || 'Answer:') AS context_md5, CAST(item_id % 4 AS INT) AS gold FROM (SELECT *, string_split(text, ' ') AS w FROM benchmark)"),
    "fewshot_prefix": (fewshot_prefix, f"{HELD} SELECT * FROM p"),
    "holdout_exemplars": (holdout_exemplars, f"{HELD} SELECT doc_id, n.subject, md5(coalesce(prefix, '') || context) AS context_md5, gold FROM n LEFT JOIN p ON n.subject = p.subject WHERE k > least(2, c - 1)"),
    "samples_per_subject": (lambda spark, sf: D.sample(mcq(spark, sf), per_subject=3).select("doc_id", "subject"), f"WITH {MCQ} SELECT doc_id, subject FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY pos) AS k FROM mcq) WHERE k <= 3"),
    "flat_limit": (lambda spark, sf: D.sample(mcq(spark, sf), limit=10).select("doc_id", "subject"), f"WITH {MCQ} SELECT doc_id, subject FROM mcq WHERE pos < 10"),
    "mcq_predictions": (mcq_predictions, f"{PREDICTED} SELECT doc_id, model, bucket, predicted, substr('{''.join(LETTERS)}', predicted + 1, 1) AS predicted_letter, w[predicted + 1] AS predicted_choice, substr('{''.join(LETTERS)}', gold + 1, 1) AS gold_letter, w[gold + 1] AS gold_choice, predicted = gold AS correct, round(prob, 9) AS token_normalized_prob_correct FROM p"),
    "bucket_rollup": (bucket_rollup, f"{TOTALS} SELECT model, task, metric, {_R.format('macro')}, {_R.format('worst')}, n_buckets FROM t WHERE task = 'quiz'"),
    "relative_improvement": (relative_improvement, f"{TOTALS} SELECT model, task, metric, {_R.format('macro')}, {_R.format('base_macro')}, {_R.format('relative_improvement')} FROM i"),
    "signed_percent": (signed_percents, f"{TOTALS} SELECT model, task, metric, CASE WHEN relative_improvement IS NULL THEN '—' ELSE printf('%+.2f%%', round(relative_improvement, 6) * 100) END AS vs_base FROM i"),
    "bucket_deltas": (bucket_deltas, f"{RESULTS} SELECT x.model, x.task, x.metric, x.bucket, round(x.value - y.value, 9) AS delta FROM a x JOIN a y ON y.model = 'base' AND x.task = y.task AND x.metric = y.metric AND x.bucket = y.bucket WHERE x.model <> 'base'"),
    "macro_deltas": (macro_deltas, f"{TOTALS} SELECT model, t.task, t.metric, round(macro - base_macro, 9) AS delta FROM t JOIN b ON t.task = b.task AND t.metric = b.metric WHERE model <> 'base'"),
    "merge_results": (merge_results, f"{RESULTS} SELECT model, task, bucket, metric, round(value + CASE WHEN model = 'random' AND bucket <> 'subject0' THEN 1 ELSE 0 END, 9) AS value FROM a WHERE model IN ('base', 'random')"),
    "skip_done_buckets": (skip_done_buckets, f"{RESULTS} SELECT DISTINCT model, task, bucket FROM a WHERE NOT {FIRST}"),
    "report_rows": (report_rows, f"{TOTALS} SELECT t.task, t.metric, CAST(model_pos AS INT) AS model_pos, t.model, round(t.macro, 9) AS macro, round(worst, 9) AS worst, CASE WHEN relative_improvement IS NULL THEN '—' ELSE printf('%+.2f%%', relative_improvement * 100) END AS vs_base FROM t JOIN models ON t.model = models.model LEFT JOIN i ON t.model = i.model AND t.task = i.task AND t.metric = i.metric"),
    "missing_baselines": (missing_baselines, f"{RESULTS}, f AS (SELECT * FROM a WHERE {FIRST}) SELECT task, metric, model FROM (SELECT DISTINCT task, metric FROM f) CROSS JOIN (SELECT model FROM models) EXCEPT SELECT task, metric, model FROM f"),
    "pack_blocks": (pack_blocks, BLOCKS),
    "l2_normalize": (l2_normalize, "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS s FROM v) SELECT vec_id, round(e[1] / s, 6) AS first, round(list_sum(e) / s, 6) AS total FROM n"),
    "head_inference": (head_inference, HEADS),
    "head_training": (head_training, f"SELECT unnest({list(DIMENSIONS)!r}) AS dimension, n_held, true AS learned FROM (SELECT count(*) AS n_held FROM embeddings WHERE vec_id % 5 = 0)"),
    "stratified_split": (stratified, None),
    "stratified_marginals": (stratified_marginals, f"{RATED}, t AS (SELECT language, count(*) AS n FROM cand GROUP BY language), l AS (SELECT language, count(DISTINCT (dimension, score)) AS n_labels FROM rated GROUP BY language), s AS (SELECT language, n, CAST(round_even(n * 0.8::DOUBLE, 0) AS BIGINT) AS a, CAST(round_even(n * 0.1::DOUBLE, 0) AS BIGINT) AS b FROM t) SELECT language, split, n_rows, n_labels, true AS balanced FROM (SELECT language, 'train' AS split, a AS n_rows FROM s UNION ALL SELECT language, 'dev', b FROM s UNION ALL SELECT language, 'test', n - a - b FROM s) JOIN l USING (language)"),
    "nfc_normalize": (nfc_normalize, "SELECT doc_id, md5(nfc_normalize(text)) AS text_md5 FROM documents"),
    "record_projection": (record_projection, "SELECT lang || '_' || doc_id AS doc_id, lang AS language, 3 AS educational_value, 3 AS reasoning, 3 AS professionalism, 3 AS cleanliness, 3 AS cultural_nuance, source, 'b' AS len_bucket, 'c' AS lang_bucket, CAST(n_chars AS INT) AS char_len FROM documents"),
    "nested_results": (nested_results, f"{TOTALS} SELECT a.model, a.task, a.metric, a.bucket, round(a.value, 9) AS value, round(t.macro, 9) AS macro, round(worst, 9) AS worst, round(relative_improvement, 9) AS relative_improvement FROM a JOIN t ON a.model = t.model AND a.task = t.task AND a.metric = t.metric LEFT JOIN i ON a.model = i.model AND a.task = i.task AND a.metric = i.metric"),
    "choice_log_likelihood": (choice_log_likelihood, f"{LIKELY} SELECT doc_id, CAST(choice AS INT) AS choice, round(lp, 9) AS sum_log_prob, CAST(1 AS BIGINT) AS num_tokens FROM l"),
    "task_rollup": (task_rollup, f"{LIKELY}, p AS (SELECT doc_id, bucket, gold, CAST(0 AS INT) AS predicted, exp(any_value(lp)) AS prob FROM l GROUP BY doc_id, bucket, gold), b AS (SELECT bucket, avg((predicted = gold)::INT) AS accuracy, avg(prob) AS token_normalized_prob_correct FROM p GROUP BY bucket), r AS (SELECT bucket, metric, value FROM b UNPIVOT (value FOR metric IN (accuracy, token_normalized_prob_correct))) SELECT 'pairs' AS model, 'quiz' AS task, metric, round(avg(value), 9) AS macro, round(min(value), 9) AS worst, count(*) AS n_buckets FROM r GROUP BY metric"),
    "macro_huber": (macro_huber, f"{RATED}, h AS (SELECT dimension, abs(predicted - score) AS d FROM rated), m AS (SELECT dimension, round(avg(CASE WHEN d <= 1 THEN 0.5::DOUBLE * d * d ELSE d - 0.5::DOUBLE END), 9) AS huber FROM h GROUP BY dimension) SELECT round(avg(huber), 9) AS huber FROM m"),
}
