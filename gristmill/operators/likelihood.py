"""Log-likelihoods of continuations by a plug-in model, and the evaluation of multiple-choice tasks with them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.evaluate import KEYS, bucket_metrics, choice_rows, predictions, with_retry
from gristmill.storage import Workspace


class Model(Protocol):
    """What scores texts. It goes to the executors with the query, so it is small, and loads its weights on first use there."""

    pad_id: int

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Token ids, without special tokens."""

    def log_probs(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(rows, width, vocabulary): the log-probability of each next token after each position of right-padded rows.

        Raises MemoryError where the rows are too many.
        """


def by_length(lengths: Sequence[int], batch: int) -> Iterator[np.ndarray]:
    """Batches of rows of similar length, the shortest first; rows of one length keep their order. What is scored goes back by these numbers."""
    order = np.argsort(np.asarray(lengths), kind="stable")
    for k in range(0, len(order), batch):
        yield order[k : k + batch]


def pad_right(rows: Sequence[Sequence[int]], pad_id: int) -> tuple[np.ndarray, np.ndarray]:
    ids, mask = np.full((len(rows), max(map(len, rows))), pad_id, np.int64), np.zeros((len(rows), max(map(len, rows))), np.int64)
    for k, row in enumerate(rows):
        ids[k, : len(row)], mask[k, : len(row)] = row, 1
    return ids, mask


def log_likelihoods(contexts: list[str], continuations: list[str], model: Model, batch: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum of log P(token | what is before it), tokens) of each continuation, in the order given.

    The two texts are encoded apart, so a continuation's tokens don't depend on its context. A context has one token at least.
    """
    before, after = model.encode(contexts), model.encode(continuations)
    if not all(before):
        raise ValueError("a context needs a token")
    total, tokens = np.zeros(len(contexts)), np.array(list(map(len, after)), np.int64)
    for rows in by_length([len(a) + len(b) for a, b in zip(before, after, strict=True)], batch):
        ids, mask = pad_right([before[k] + after[k] for k in rows], model.pad_id)
        found = model.log_probs(ids, mask)
        for row, k in enumerate(rows):
            place = len(before[k]) - 1 + np.arange(tokens[k])  # the position before a token tells its probability
            total[k] = found[row, place, np.array(after[k], np.int64)].sum()
    return total, tokens


def dealt_by_length(df: DataFrame, *texts: str) -> DataFrame:
    """Rows in ranges of their texts' length, the shortest first in each partition: batches are then of one length across the whole table, not only within an Arrow
    batch. Ranges are cut by a hash where rows are equally long, so a common length is spread over partitions. Rows keep their columns, by which they
    are told apart afterwards."""
    length = F.lit(0)
    for t in texts:
        length = length + F.coalesce(F.length(t), F.lit(0))
    named = df.withColumns({"__length": length, "__spread": F.xxhash64(*texts)})
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as few bytes of text may be much work for a model
    return named.repartitionByRange(count, "__length", "__spread").sortWithinPartitions("__length").drop("__length", "__spread")


def padding(lengths: Sequence[int], batch: int) -> float:
    """The share of padded places when rows go in the order given, ``batch`` at a time."""
    blocks = [lengths[k : k + batch] for k in range(0, len(lengths), batch)]
    places = sum(max(b) * len(b) for b in blocks)
    return 1 - sum(lengths) / places if places else 0.0


def score_continuations(df: DataFrame, model: Model, batch: int = 16, context_col: str = "context", continuation_col: str = "continuation") -> DataFrame:
    """Adds ``sum_log_prob`` and ``num_tokens``; rows come in another order, by length. An Arrow batch that runs out of memory is tried with half the rows at a
    time; null if one is too many."""
    df = dealt_by_length(df, context_col, continuation_col)

    @F.pandas_udf("sum_log_prob double, num_tokens long")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for contexts, continuations in batches:
            rows = (contexts.tolist(), continuations.tolist())
            found = with_retry(lambda r, n: log_likelihoods(*r, model, n), rows, batch) if len(contexts) else ([], [])
            yield pd.DataFrame({"sum_log_prob": found[0], "num_tokens": found[1]}) if found else pd.DataFrame({"sum_log_prob": [None] * len(contexts), "num_tokens": [None] * len(contexts)}, dtype="object")

    return df.withColumn("__score", score(F.col(context_col), F.col(continuation_col))).select(*(F.col(f"`{c}`") for c in df.columns), "__score.*")


def predict_task(docs: DataFrame, model: Model, name: str, task: str, batch: int = 16) -> tuple[DataFrame, DataFrame]:
    """Predictions of one model for the documents (doc_id, bucket, context, choices, choice_texts, gold) of a task, and the buckets that it has to skip.

    A bucket with a choice that could not be scored is skipped as a whole, and is left for a later run.
    """
    asked = choice_rows(docs.select("doc_id", "bucket", "context", "choices"))
    found = score_continuations(asked, model, batch).select("doc_id", "bucket", "choice", "sum_log_prob", "num_tokens")
    scored = Workspace(docs.sparkSession, "scored").write(found, task)  # both results start from it, and the model runs once
    skipped = scored.where("sum_log_prob is null").select("bucket").distinct()
    rows = predictions(docs, scored.drop("bucket"), keys=("doc_id",)).join(skipped, "bucket", "left_anti")
    return rows.select("*", F.lit(name).alias("model"), F.lit(task).alias("task")), skipped


def task_results(predicted: DataFrame) -> DataFrame | None:
    """Long results by bucket, or None if all buckets were skipped."""
    return None if predicted.isEmpty() else bucket_metrics(predicted, KEYS)
