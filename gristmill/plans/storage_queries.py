"""Sources and sinks on the test tables: each query writes rows of them with a writer of the library and returns what the reader gives back."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.constants import BENCHMARK_CONFIGS, DIMENSIONS
from gristmill.functions.legacy import fit_detector, to_legacy, to_unicode
from gristmill.functions.normalize import repair
from gristmill.operators import corpus as C
from gristmill.operators import evaluate as E
from gristmill.operators import rater as R
from gristmill.operators import selection as S
from gristmill.plans.base import BUDGET, CAND, EST, before, candidates, scored
from gristmill.plans.corpus_queries import SP, _weighted
from gristmill.plans.evaluation_queries import HEADS, MCQ, PREDICTED, mcq, predictions
from gristmill.session import load
from gristmill.sources import bundles, readers, writers
from gristmill.storage import WHILE_WRITING, Workspace, settings

LANGS = ["en", "de", "es", "fr"]


def corpus_files(spark, sf):
    """Candidates as JSON lines, a folder for each language; two languages are read."""
    root = Workspace(spark, "corpus").path("candidates")
    writers.json_lines(candidates(spark, sf), root, ["language"])
    parts = [readers.json_lines(spark, root, readers.CANDIDATE, language=lang) for lang in ("fr", "de")]
    return parts[0].unionByName(parts[1]).select("doc_id", "language", "char_len", "source", F.md5("text").alias("text_md5"))


def annotation_csv(spark, sf):
    """Texts with quotes, commas, line feeds and edge spaces through CSV."""
    path = Workspace(spark, "csv").path("annotations")
    rows = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit('  "a", '), "text", F.lit('\n"z" ')).alias("text"))
    writers.csv(rows, path)
    return readers.annotations(spark, path, "vi").select(F.col("id").cast("long").alias("id"), "language", F.md5("text").alias("text_md5"))


def plain_csv(spark, sf):
    """The customers as CSV, all columns as text."""
    path = Workspace(spark, "csv").path("customer")
    writers.csv(load(spark, sf, "customer"), path)
    return readers.text_csv(spark, path).select("c_custkey", "c_name")


def number_csv(spark, sf):
    """A result file: an id and numbers, with the scores of documents in the places of weights and losses."""
    path = Workspace(spark, "csv").path("results")
    rows = scored(spark, sf)
    wide = rows.select(F.col("doc_id").cast("string").alias("weight_id"), *(F.col(d).alias(f"w_{d}") for d in DIMENSIONS), *((F.col("char_len") / (k + 2)).alias(f"loss_{c}") for k, c in enumerate(LANGS)), F.col("reasoning").alias("macro_loss"), F.col("cleanliness").alias("worst_language_loss"))
    writers.csv(wide, path)
    return readers.proxy_results(spark, path, LANGS).select("weight_id", *(F.round(c, 9).alias(c) for c in wide.columns if c != "weight_id"))


def keyed_appends(spark, sf):
    """Two runs append to one table, the second one again for some keys; the latest row of each key is read."""
    path = Workspace(spark, "appends").path("runs")
    rows = scored(spark, sf).select("doc_id", "language", "reasoning")
    writers.append_keyed(rows, path, 0)
    writers.append_keyed(rows.where("doc_id % 3 = 0").withColumn("reasoning", F.col("reasoning") + 10), path, 1)
    return writers.read_keyed(spark, path, "doc_id").select("doc_id", "language", F.round("reasoning", 9).alias("reasoning"))


def replaced_partitions(spark, sf):
    """A partitioned table, of which a second run replaces the languages that it has rows for."""
    path = Workspace(spark, "partitions").path("scored")
    rows = scored(spark, sf).select("doc_id", "language", "char_len")
    writers.partitioned(rows, path, ["language"])
    writers.partitioned(rows.where("language IN ('de', 'es') AND doc_id % 2 = 0"), path, ["language"])
    return spark.read.parquet(path).select("doc_id", "language", "char_len")


def _selected_files(spark, sf, by, name, selected):
    root = Workspace(spark, "selected").path("records")
    writers.selected_records(S.with_text(selected, candidates(spark, sf)).withColumn(by, F.lit(name)), root, by)
    read = readers.json_lines(spark, root, f"doc_id long, language string, source string, weighted_score double, estimated_tokens double, text string, {by} string, lang string", lang="en")
    return read.select(by, "doc_id", "lang", F.round("weighted_score", 9).alias("weighted_score"), "estimated_tokens", F.md5("text").alias("text_md5"))


def selected_files(spark, sf):
    """What one weight vector selects, as narrow records with their texts; the English folder is read."""
    return _selected_files(spark, sf, "weight_id", "W11", S.select_for_weight(scored(spark, sf), dict(zip(DIMENSIONS, (0.25, 0.10, 0.10, 0.15, 0.40), strict=True)), BUDGET))


def baseline_files(spark, sf):
    """The same for a baseline, whose records have no score."""
    return _selected_files(spark, sf, "baseline", "random", S.select_random(scored(spark, sf), BUDGET))


def task_files(spark, sf):
    """Multiple-choice documents of two tasks: one with a folder for each bucket, one with the bucket as a column."""
    root = Workspace(spark, "tasks").path("docs")
    rows = mcq(spark, sf).select("context", "choices", "choice_texts", "gold", "subject")
    writers.bucketed(rows.withColumn("bucket", F.col("subject")).withColumn("task", F.lit("quiz")), root, ["task"])
    writers.bucketed(rows.withColumn("task", F.lit("sums")), root, ["task"], combined=True)
    got = readers.tasks(spark, root, {"quiz": "", "sums": "subject"})
    return got.select("task", "bucket", F.md5("context").alias("context_md5"), "gold", F.size("choices").alias("n_choices"))


def one_bucket(spark, sf):
    """One bucket of a task's folder."""
    root = Workspace(spark, "tasks").path("docs")
    rows = mcq(spark, sf).select("context", "choices", "choice_texts", "gold", "subject")
    writers.bucketed(rows.withColumn("bucket", F.col("subject")), root, [])
    return readers.by_folder(spark, root, readers.MCQ, "bucket", ["subject1"]).select("bucket", F.md5("context").alias("context_md5"), "gold")


def split_scan(spark, sf):
    """Rows of one split of a table that is partitioned by it."""
    root = Workspace(spark, "splits").path("rows")
    tenth = F.col("doc_id") % 10
    writers.json_lines(scored(spark, sf).withColumn("split", F.when(tenth < 8, "train").when(tenth == 8, "dev").otherwise("test")), root, ["split"])
    return readers.split_rows(spark, root, f"{readers.SCORED}, split string", "dev").select("doc_id", "language", *DIMENSIONS)


def word_list_file(spark, sf):
    """The nations' names as a word list, with comments and blank lines."""
    path = Workspace(spark, "words").path("list")
    names = load(spark, sf, "nation").select(F.concat(F.lit("  "), "n_name", F.lit("-x")).alias("value"))
    extra = load(spark, sf, "region").select(F.explode(F.array(F.concat(F.lit("# "), "r_name"), F.lit(""), F.lit(" *** "))).alias("value"))
    names.unionByName(extra).write.text(path)
    return spark.createDataFrame([(w,) for w in readers.word_list(spark, path)], "word string")


def saved_heads(spark, sf):
    """Heads written and read back before they score the embeddings."""
    path = Workspace(spark, "heads").path("heads")
    R.save_heads(spark, R.simple_heads(64), path)
    rows = R.infer(load(spark, sf, "embeddings").select("vec_id", "embedding"), R.load_heads(spark, path))
    return rows.select("vec_id", *(F.round(d, 6).alias(d) for d in DIMENSIONS))


def results_log(spark, sf):
    """The quiz's results of two runs from a log: the second has new values of one model for some buckets, and is added twice."""
    path = Workspace(spark, "log").path("results")
    rows = Workspace(spark, "log").write(E.bucket_metrics(predictions(spark, sf)), "rows")
    again = rows.where("model = 'random' AND bucket <> 'subject0'").withColumn("value", F.col("value") + 1)
    for run, new in (("first", rows), ("second", again), ("second", rows)):
        writers.log_results(new, path, run, 0 if run == "first" else 1)
    return writers.logged_results(spark, path).select("model", "task", "bucket", "metric", "run", F.round("value", 9).alias("value"))


def vector_bundle(spark, sf):
    """The embeddings as a bundle of fixed-width records, in two writes, and read back."""
    bundles.register(spark)
    path = Workspace(spark, "bundle").path("vectors")
    rows = load(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("float").alias("label"))
    rows.where("vec_id % 3 = 0").write.format("floatbundle").mode("overwrite").save(path)
    rows.where("vec_id % 3 <> 0").write.format("floatbundle").mode("append").save(path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return spark.read.format("floatbundle").load(path).select("vec_id", F.size("embedding").alias("width"), F.round(F.element_at("embedding", 64).cast("double"), 9).alias("last"), F.round(total, 6).alias("total"), F.col("label").cast("int").alias("label"))


def masked_means(spark, sf):
    """Means of the four quarters of a vector that the bits of its id keep."""
    quarters = F.array(*(F.transform(F.slice("embedding", 16 * k + 1, 16), lambda x: x.cast("double")) for k in range(4)))
    bits = F.array(*(F.shiftright("vec_id", k).bitwiseAND(F.lit(1)).cast("int") for k in range(4)))
    rows = load(spark, sf, "embeddings").select("vec_id", R.masked_mean(quarters, bits).alias("m"))
    return rows.select("vec_id", F.round(F.element_at("m", 1), 6).alias("first"), F.round(F.element_at("m", 16), 6).alias("last"))


#: Burmese letters and signs in the places of Latin ones, so that the documents become text of that script in canonical order.
LATIN, BURMESE = "abcdefghijklmnopqrstuvwxyz", ("\u102c", "\u1017", "\u1000\u103b", "\u1012", "\u1031", "\u1016", "\u1002", "\u101f", "\u102d", "\u1007", "\u1000", "\u101c", "\u1019", "\u1014", "\u102f", "\u1015\u103c", "\u1000\u103d", "\u101b", "\u101e", "\u1010", "\u1030", "\u1018", "\u101d\u103e", "\u1001", "\u101a", "\u1005")


#: Letters without a place in such a text: vowels need a consonant before them.
_DROPPED = re.compile("[aeiou](?<![b-df-hj-np-tv-z].)|[^a-z ]")
_SPELLED = str.maketrans(dict(zip(LATIN, BURMESE, strict=True)))


@F.pandas_udf(T.StructType().add("right", T.StringType()).add("text", T.StringType()))
def _spelled(texts: pd.Series, legacy: pd.Series) -> pd.DataFrame:
    """Lower-case texts in Burmese letters, and as they are stored; both in one step, as texts are what takes time to pass."""
    right = [t if t is None else _DROPPED.sub("", t).translate(_SPELLED) for t in texts]
    return pd.DataFrame({"right": right, "text": [to_legacy(t) if old and t is not None else t for t, old in zip(right, legacy, strict=True)]}, dtype=object)


def _burmese(spark, sf):
    """The documents' consonants and vowels as Burmese syllables; of every other one in the legacy encoding."""
    lower, legacy = F.lower("text"), F.col("doc_id") % 2 == 1
    consonants = F.length(lower) - F.length(F.translate(lower, "bcdfghjklmnpqrstvwxyz", ""))
    rows = load(spark, sf, "documents").select("doc_id", consonants.alias("n"), legacy.alias("legacy"), _spelled(lower, legacy).alias("spelled"))
    return rows.select("doc_id", "n", "spelled.right", "legacy", "spelled.text")


def legacy_repair(spark, sf):
    """Texts of which a fitted detector finds the legacy ones, and how many come back as they were. It is fitted on other documents than it judges."""
    rows = _burmese(spark, sf)
    known = F.floor(F.col("doc_id") / 2) % 2 == 0
    with settings(spark, WHILE_WRITING):  # texts in small batches, here and below
        detector = fit_detector(rows.where(known))
    fixed = repair(rows.where(~known & (F.col("n") > 20)), "text", detector, to_unicode)
    counts = fixed.groupBy("legacy").agg(F.count("*").alias("n_rows"), F.count_if("converted").alias("n_converted"), F.count_if(F.col("text") == F.col("right")).alias("n_right"))
    return Workspace(spark, "repair").write(counts, "counts")


def null_texts(spark, sf):
    """Documents whose text is missing for some, as empty ones."""
    rows = candidates(spark, sf).select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 > 0, F.col("text")).alias("text"), "language_score", "pos")
    return C.stream_docs(rows, 1 << 40, "clean").select(F.col("doc_id").cast("long").alias("doc_id"), "char_len", F.length("text").alias("stripped"))


def some_weights(spark, sf):
    """Selection for some weight vectors in file order; unknown ids are no vectors."""
    chosen = S.weights_table(spark, ["W20", "W99", "W02"])
    return S.select_all_weights(scored(spark, sf), chosen, BUDGET).groupBy("weight_id", "language").agg(F.count("*").alias("n_docs"), F.sum("estimated_tokens").alias("est_tokens"))


def available_configs(spark, sf):
    """Configurations that a catalogue has: the folders of the documents, one for each language."""
    root = Workspace(spark, "catalogue").path("docs")
    writers.partitioned(load(spark, sf, "documents").select("doc_id", F.concat(F.col("lang"), F.lit("_Latn")).alias("config")), root, ["config"])
    catalogue = readers.folder_names(spark, root).where("is_folder").select(F.regexp_replace("name", "^config=", "").alias("config"))
    wanted = spark.createDataFrame([*BENCHMARK_CONFIGS.items(), *((c, f"{c}_Latn") for c in LANGS)], "language string, config string")
    there, gone = C.available_configs(wanted, catalogue)
    return there.withColumn("available", F.lit(True)).unionByName(gone.withColumn("available", F.lit(False)))


_CONSONANTS = "length(regexp_replace(lower(text), '[^b-df-hj-np-tv-z]', '', 'g'))"
_LISTS = "list_transform(range(4), lambda k: (vec_id >> k) & 1)"
_WANTED = ", ".join(f"('{a}', '{b}')" for a, b in (*BENCHMARK_CONFIGS.items(), *((c, f"{c}_Latn") for c in LANGS)))
QUERIES = {
    "corpus_files": (corpus_files, f"WITH {CAND} SELECT CAST(doc_id AS VARCHAR) AS doc_id, language, CAST(char_len AS INT) AS char_len, source, md5(text) AS text_md5 FROM cand WHERE language IN ('fr', 'de')"),
    "annotation_csv": (annotation_csv, """SELECT doc_id AS id, 'vi' AS language, md5('  "a", ' || text || chr(10) || '"z" ') AS text_md5 FROM documents"""),
    "plain_csv": (plain_csv, "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer"),
    "number_csv": (number_csv, f"WITH {CAND} SELECT CAST(doc_id AS VARCHAR) AS weight_id, {', '.join(f'round({d}, 9) AS w_{d}' for d in DIMENSIONS)}, {', '.join(f'round(char_len / {k + 2}::DOUBLE, 9) AS loss_{c}' for k, c in enumerate(LANGS))}, round(reasoning, 9) AS macro_loss, round(cleanliness, 9) AS worst_language_loss FROM scored"),
    "keyed_appends": (keyed_appends, f"WITH {CAND} SELECT doc_id, language, round(reasoning + CASE WHEN doc_id % 3 = 0 THEN 10 ELSE 0 END, 9) AS reasoning FROM scored"),
    "replaced_partitions": (replaced_partitions, f"WITH {CAND} SELECT doc_id, language, char_len FROM cand WHERE language NOT IN ('de', 'es') OR doc_id % 2 = 0"),
    "selected_files": (selected_files, f"{_weighted('WHERE weight_id = ' + repr('W11'))} SELECT 'W11' AS weight_id, t.doc_id, t.language AS lang, weighted_score, estimated_tokens, md5(c.text) AS text_md5 FROM t JOIN cand c ON t.doc_id = c.doc_id WHERE b < {BUDGET} AND t.language = 'en'"),
    "baseline_files": (baseline_files, f"WITH {CAND}, t AS (SELECT *, {EST} AS estimated_tokens, {before('language', 'md5(concat(' + repr('42') + ', doc_id)), pos')} AS b FROM cand) SELECT 'random' AS baseline, doc_id, language AS lang, CAST(NULL AS DOUBLE) AS weighted_score, estimated_tokens, md5(text) AS text_md5 FROM t WHERE b < {BUDGET} AND language = 'en'"),
    "task_files": (task_files, f"WITH {MCQ} SELECT task, subject AS bucket, md5(context) AS context_md5, gold, 4 AS n_choices FROM mcq CROSS JOIN (SELECT unnest(['quiz', 'sums']) AS task)"),
    "one_bucket": (one_bucket, f"WITH {MCQ} SELECT subject AS bucket, md5(context) AS context_md5, gold FROM mcq WHERE subject = 'subject1'"),
    "split_scan": (split_scan, f"WITH {CAND} SELECT CAST(doc_id AS VARCHAR) AS doc_id, language, {', '.join(DIMENSIONS)} FROM scored WHERE doc_id % 10 = 8"),
    "word_list_file": (word_list_file, "SELECT DISTINCT lower(regexp_replace(n_name || 'x', '[^a-zA-Z0-9]+', '', 'g')) AS word FROM nation"),
    "saved_heads": (saved_heads, HEADS),
    "results_log": (results_log, f"{PREDICTED}, z AS (SELECT *, model = 'random' AND bucket <> 'subject0' AS again FROM r) SELECT model, task, bucket, metric, CASE WHEN again THEN 'second' ELSE 'first' END AS run, round(value + again::INT, 9) AS value FROM z"),
    "vector_bundle": (vector_bundle, "SELECT vec_id, CAST(len(embedding) AS INT) AS width, round(embedding[64]::DOUBLE, 9) AS last, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total, label FROM embeddings"),
    "masked_means": (masked_means, f"WITH m AS (SELECT vec_id, embedding AS e, {_LISTS} AS b FROM embeddings) SELECT vec_id, {', '.join(f'round(({chr(43).join(f'b[{k + 1}] * e[{16 * k + at}]::DOUBLE' for k in range(4))}) / greatest(list_sum(b), 1), 6) AS {name}' for at, name in ((1, 'first'), (16, 'last')))} FROM m"),
    "legacy_repair": (legacy_repair, f"WITH k AS (SELECT doc_id % 2 = 1 AS legacy FROM documents WHERE (doc_id // 2) % 2 = 1 AND {_CONSONANTS} > 20) SELECT legacy, count(*) AS n_rows, CASE WHEN legacy THEN count(*) ELSE 0 END AS n_converted, count(*) AS n_right FROM k GROUP BY legacy"),
    "null_texts": (null_texts, f"SELECT doc_id, CAST(length(t) AS INT) AS char_len, CAST(length(regexp_replace(t, '^[{SP}]+|[{SP}]+$', '', 'g')) AS INT) AS stripped FROM (SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN text ELSE '' END AS t FROM documents)"),
    "some_weights": (some_weights, f"{_weighted('WHERE weight_id IN (' + repr('W20') + ', ' + repr('W02') + ')')} SELECT weight_id, language, count(*) AS n_docs, sum(estimated_tokens) AS est_tokens FROM t WHERE b < {BUDGET} GROUP BY ALL"),
    "available_configs": (available_configs, f"WITH w(language, config) AS (VALUES {_WANTED}) SELECT language, config, config IN (SELECT lang || '_Latn' FROM documents) AS available FROM w"),
}
