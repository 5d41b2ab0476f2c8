"""Evaluation over a long table (model, task, metric, bucket, value); totals and improvements are derived, so they can't go stale."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.constants import BASELINES
from gristmill.functions.scoring import improvement, signed_percent, token_normalized_probability
from gristmill.session import constants

#: Metrics of which less is better.
LOWER = ("perplexity",)
KEYS = ("model", "task", "bucket")


def choice_rows(docs: DataFrame) -> DataFrame:
    """A row for each choice of each document, to be scored: the continuation is a space and the letter."""
    return docs.select("*", F.posexplode("choices").alias("choice", "letter")).withColumn("continuation", F.concat(F.lit(" "), F.col("letter")))


def predictions(docs: DataFrame, scores: DataFrame, keys: tuple[str, ...] = ("model", "doc_id")) -> DataFrame:
    """Scores (model, doc_id, choice, sum_log_prob, num_tokens) to one row for each document; the first of equally likely choices is predicted."""
    listed = scores.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("choice", "sum_log_prob", "num_tokens"))).alias("s"))  # as many as letters
    likely = F.transform("s", lambda x: x["sum_log_prob"])
    out = docs.join(listed, "doc_id").withColumn("choice_log_likelihoods", likely)
    out = out.withColumn("predicted", (F.array_position("choice_log_likelihoods", F.array_max("choice_log_likelihoods")) - 1).cast("int"))
    gold = F.element_at("s", F.col("gold") + 1)
    at = lambda c, k: F.element_at(c, F.col(k) + 1)
    return out.withColumns(
        {
            "gold_letter": at("choices", "gold"), "gold_choice": at("choice_texts", "gold"), "predicted_letter": at("choices", "predicted"), "predicted_choice": at("choice_texts", "predicted"),
            "correct": F.col("predicted") == F.col("gold"), "token_normalized_prob_correct": token_normalized_probability(gold["sum_log_prob"], gold["num_tokens"]),
        }
    ).drop("s")


def bucket_metrics(predicted: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Long rows of accuracy and of the gold answer's mean probability."""
    sums = predicted.groupBy(*keys).agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("token_normalized_prob_correct").alias("token_normalized_prob_correct"))
    return sums.unpivot(list(keys), ["accuracy", "token_normalized_prob_correct"], "metric", "value")


def perplexities(losses: DataFrame) -> DataFrame:
    """Losses (model, bucket, loss) as long rows of the held-out task."""
    return losses.select("model", F.lit("held_out").alias("task"), "bucket", F.lit("perplexity").alias("metric"), F.exp("loss").alias("value"))


def rollup(results: DataFrame) -> DataFrame:
    """Macro mean and worst bucket: the largest where less is better, else the least."""
    worst = F.when(F.col("metric").isin(*LOWER), F.max("value")).otherwise(F.min("value"))
    return results.groupBy("model", "task", "metric").agg(F.avg("value").alias("macro"), worst.alias("worst"), F.count("*").alias("n_buckets"))


def improvements(results: DataFrame, base: str = "base") -> DataFrame:
    """Each model's macro value against the base model's, for tasks and metrics that both have."""
    totals = rollup(results)
    own = totals.where(F.col("model") == base).select("task", "metric", F.col("macro").alias("base_macro"))
    joined = totals.where(F.col("model") != base).join(own, ["task", "metric"])
    better = F.when(F.col("metric").isin(*LOWER), improvement(F.col("base_macro"), F.col("macro"), True)).otherwise(improvement(F.col("base_macro"), F.col("macro"), False))
    return joined.select("model", "task", "metric", "macro", "base_macro", better.alias("relative_improvement"))


def bucket_deltas(results: DataFrame, base: str = "base") -> DataFrame:
    """Each model's value less the base model's, for all buckets of the base; a model that has the task but lacks a bucket is an error."""
    own = results.where(F.col("model") == base).select("task", "metric", "bucket", F.col("value").alias("base_value"))
    wanted = results.where(F.col("model") != base).select("model", "task", "metric").distinct().join(own, ["task", "metric"])
    joined = wanted.join(results, ["model", "task", "metric", "bucket"], "left")
    lacks = F.raise_error(F.concat(F.col("model"), F.lit(" has no "), F.col("metric"), F.lit(" of "), F.col("task"), F.lit(" for "), F.col("bucket"))).cast("double")
    return joined.select("model", "task", "metric", "bucket", F.when(F.col("value").isNull(), lacks).otherwise(F.col("value") - F.col("base_value")).alias("delta"))


def macro_deltas(results: DataFrame, base: str = "base") -> DataFrame:
    totals = rollup(results)
    own = totals.where(F.col("model") == base).select("task", "metric", F.col("macro").alias("b"))
    return totals.where(F.col("model") != base).join(own, ["task", "metric"]).select("model", "task", "metric", (F.col("macro") - F.col("b")).alias("delta"))


def summary(results: DataFrame, base: str = "base") -> DataFrame:
    """The report's rows: base first, then the baselines in order, those without results left out."""
    spark = results.sparkSession
    order = constants(spark, list(enumerate([base, *BASELINES])), "model_pos int, model string")
    rows = F.broadcast(order).join(rollup(results), "model").join(improvements(results, base).select("model", "task", "metric", "relative_improvement"), ["model", "task", "metric"], "left")
    return rows.withColumn("vs_base", signed_percent(F.col("relative_improvement"))).select("task", "metric", "model_pos", "model", "macro", "worst", "vs_base")


def missing_baselines(results: DataFrame, base: str = "base") -> DataFrame:
    """(task, metric, model) of baselines that a task lacks."""
    spark = results.sparkSession
    tasks = results.select("task", "metric").distinct()
    return tasks.crossJoin(F.broadcast(constants(spark, [(m,) for m in (base, *BASELINES)], "model string"))).join(results, ["task", "metric", "model"], "left_anti")


def remaining(wanted: DataFrame, results: DataFrame, force: bool = False) -> DataFrame:
    """Wanted (model, task, bucket) without results; all of them with ``force``."""
    return wanted if force else wanted.join(results.select(*KEYS).distinct(), list(KEYS), "left_anti")


def merge(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New values replace those of the same bucket and add theirs; perplexity is replaced for a model as a whole. Merging again changes nothing."""
    keys = [*KEYS, "metric"]
    replaced = new.where(F.col("metric") == "perplexity").select("model", "metric").distinct()
    kept = existing.join(new.select(*keys), keys, "left_anti").join(replaced, ["model", "metric"], "left_anti")
    return kept.select(*keys, "value").unionByName(new.select(*keys, "value"))


#: What ``nested`` writes: tasks, their metrics, and of each the values by bucket with what is derived from them.
DOCUMENT = "map<string,map<string,struct<buckets:map<string,double>,macro:double,worst:double,relative_improvement:double>>>"


def nested(results: DataFrame, base: str = "base") -> DataFrame:
    """A JSON document for each model, as ``DOCUMENT``. Totals are derived anew, so they are those of the values beside them; the base has no improvement."""
    keys = ["model", "task", "metric"]
    cells = results.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "value")))).alias("buckets"))
    cells = cells.join(rollup(results).select(*keys, "macro", "worst"), keys).join(improvements(results, base).select(*keys, "relative_improvement"), keys, "left")
    cell = F.struct("metric", F.struct("buckets", "macro", "worst", "relative_improvement"))
    tasks = cells.groupBy("model", "task").agg(F.map_from_entries(F.collect_list(cell)).alias("metrics"))
    return tasks.groupBy("model").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("task", "metrics")))).alias("document"))


def with_retry(score, rows, batch: int):
    """Calls ``score(rows, batch)`` with half the batch after each MemoryError; None when even one row at a time fails."""
    while True:
        try:
            return score(rows, batch)
        except MemoryError:
            if batch <= 1:
                return None
            batch //= 2


def summary_markdown(rows: DataFrame) -> str:
    """The report of ``summary``: a table for each task and metric; its rows are as few as models and metrics."""
    out = ["# Evaluation summary", ""]
    tables: dict[tuple[str, str], list] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["task"], r["metric"], r["model_pos"])):
        tables.setdefault((r["task"], r["metric"]), []).append(r)
    for (task, metric), own in tables.items():
        out += [f"## {task}: {metric}", "", "| model | macro | worst | vs base |", "|---|---:|---:|---:|"]
        out += [f"| {r['model']} | {r['macro']:.4f} | {r['worst']:.4f} | {r['vs_base']} |" for r in own] + [""]
    return "\n".join(out)


def with_files(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, str]:
    """The models of ``paths`` whose folder exists, in order; others are skipped."""
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    there = lambda p: (target := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(hadoop).exists(target)
    return {name: path for name, path in paths.items() if there(path)}
