"""Counts, histograms, rank correlation and errors by group."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.constants import DIMENSIONS
from gristmill.storage import Workspace


def long_scores(df: DataFrame, keys: Iterable[str], dimensions: Iterable[str] = DIMENSIONS, value: str = "score") -> DataFrame:
    return df.unpivot(list(keys), list(dimensions), "dimension", value)


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split", "language").agg(F.count("*").alias("n"))


def score_counts(df: DataFrame, dimensions: Iterable[str] = DIMENSIONS) -> DataFrame:
    """Scores that occur, by split and dimension."""
    return long_scores(df, ["split"], dimensions).where("score is not null").groupBy("split", "dimension", "score").agg(F.count("*").alias("n"))


def score_histogram(df: DataFrame, dimensions: Iterable[str] = DIMENSIONS, most: int = 5) -> DataFrame:
    """Counts of the scores 0 to ``most`` by language and dimension, zeros included."""
    rows = long_scores(df, ["language"], dimensions)
    return rows.groupBy("language", "dimension").agg(F.array(*(F.count_if(F.floor("score") == k) for k in range(most + 1))).alias("histogram"))


#: Spans of values that a cell's ranks are counted in.
SPANS = 256


def _same(names: Iterable[str]) -> tuple[list[Column], Column]:
    """Columns under other names, and the test that they are equal, nulls included."""
    names = list(names)
    test = F.lit(True)
    for i, k in enumerate(names):
        test = test & F.col(k).eqNullSafe(F.col(f"__r{i}"))
    return [F.col(k).alias(f"__r{i}") for i, k in enumerate(names)], test


def average_ranks(counts: DataFrame, groups: Iterable[str], value: str, name: str, n: str = "n") -> DataFrame:
    """(groups, value, ``name``): the rank of each value among all rows of its group, less the mean rank; ties share their mean rank.

    ``counts`` is a written table of rows that stand for ``n`` each. A group's values are cut into spans at sketched percentiles (equal values
    stay together); sums of spans give the rows before each, and a window orders the distinct values of one span only.
    """
    groups = list(groups)
    values = counts.groupBy(*groups, value).agg(F.sum(n).alias("__c"))
    own, same = _same(groups)
    cuts = values.groupBy(*groups).agg(F.percentile_approx(F.col(value).cast("double"), [k / SPANS for k in range(1, SPANS)], 4 * SPANS).alias("__cuts")).select(*own, "__cuts")
    spanned = values.join(cuts, same).select(*groups, value, "__c", F.size(F.filter("__cuts", lambda c: c < F.col(value).cast("double"))).alias("__span"))
    sums = spanned.groupBy(*groups, "__span").agg(F.sum("__c").alias("__s"))
    whole = Window.partitionBy(*groups)  # as many rows as spans
    before = F.coalesce(F.sum("__s").over(whole.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own, same = _same([*groups, "__span"])
    starts = sums.withColumns({"__before": before, "__all": F.sum("__s").over(whole)}).select(*own, "__before", "__all")
    within = Window.partitionBy(*groups, "__span").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("__before") + F.coalesce(F.sum("__c").over(within), F.lit(0)) + (F.col("__c") + 1) / 2.0 - (F.col("__all") + 1) / 2.0
    return spanned.join(starts, same).withColumn(name, rank).select(*groups, value, name)


def spearman(df: DataFrame, groups: Iterable[str], truth: str, predicted: str) -> DataFrame:
    """Rank correlation of each group; 0 where either side is constant or there are fewer than two rows. Rows without either value don't count.

    Rows that agree in both values are one with a count, so a score that a third of all rows have is a few rows.
    """
    groups = list(groups)
    rows = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    ws = Workspace(df.sparkSession, "spearman")
    joint = ws.write(rows.groupBy(*groups, truth, predicted).agg(F.count("*").alias("n")), "joint")
    ranked = joint
    for value, name in ((truth, "__x"), (predicted, "__y")):
        own, same = _same([*groups, value])
        ranked = ranked.join(average_ranks(joint, groups, value, name).select(*own, name), same).drop(*(f"__r{i}" for i in range(len(own))))
    sums = ranked.groupBy(*groups).agg(*(F.sum(F.col("n") * F.col(a) * F.col(b)).alias(f"{a}{b}") for a, b in (("__x", "__y"), ("__x", "__x"), ("__y", "__y"))))
    spread = F.sqrt(F.col("__x__x")) * F.sqrt(F.col("__y__y"))
    return sums.select(*groups, F.coalesce(F.try_divide(F.col("__x__y"), F.when(spread > 0, spread)), F.lit(0.0)).alias("spearman"))


def spearman_summary(cells: DataFrame) -> DataFrame:
    """Mean over all cells, and the least of the languages' means."""
    by_language = cells.groupBy("language").agg(F.avg("spearman").alias("m"), F.sum("spearman").alias("s"), F.count("*").alias("n"))
    return by_language.agg((F.sum("s") / F.sum("n")).alias("macro_spearman"), F.min("m").alias("worst_language_spearman"))


def mae(df: DataFrame, groups: Iterable[str], truth: str, predicted: str) -> DataFrame:
    return df.groupBy(*groups).agg(F.avg(F.abs(F.col(truth) - F.col(predicted))).alias("mae"))


def mae_by_dimension(df: DataFrame, truth: str = "score", predicted: str = "predicted") -> DataFrame:
    """The mean over languages of each one's error, so languages weigh alike."""
    return mae(df, ["language", "dimension"], truth, predicted).groupBy("dimension").agg(F.avg("mae").alias("mae"))


def batch_mean(losses: DataFrame, groups: Iterable[str] = ()) -> DataFrame:
    """Every batch weighs alike; 0 batches give 0."""
    out = losses.groupBy(*groups).agg(F.sum("loss").alias("s"), F.count("loss").alias("n"))
    return out.select(*groups, (F.coalesce("s", F.lit(0.0)) / F.greatest("n", F.lit(1))).alias("mean_loss"))


def sample_mean(losses: DataFrame, groups: Iterable[str] = ()) -> DataFrame:
    """Batches weigh by their rows."""
    return losses.groupBy(*groups).agg(F.try_divide(F.sum(F.col("loss") * F.col("n")), F.sum("n")).alias("mean_loss"))


def mean_over_dimensions(by_dimension: DataFrame, value: str) -> DataFrame:
    """The mean of the dimensions' values: what heads that train together minimize."""
    return by_dimension.agg(F.avg(value).alias(value))
