"""Selection for a token budget: by weighted scores, at random, or by clean heuristics."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.constants import BASELINES, CHARS_PER_TOKEN, DIMENSIONS, EQUAL_WEIGHTS, WEIGHTS
from gristmill.functions.scoring import estimated_tokens, weighted_score
from gristmill.operators.corpus import last_order
from gristmill.operators.prefix import by_position, take_until
from gristmill.session import constants

FEATURES = ("language_score", "repetition_score", "target_script_ratio", "stopword_ratio", "symbol_ratio", "numeric_ratio", "is_latin")
#: Steps of a score within one unit: coarse ones, and those within them. Scores have nine places.
STEPS, FINE = 256, 10**9


def weights_table(spark, ids: Iterable[str] | None = None) -> DataFrame:
    """(weight_id, meaning, w_<dimension>...) in order; ids that don't exist are ignored."""
    wanted = None if ids is None else set(ids)
    rows = [(k, w[0], w[-1], *w[1:-1]) for k, w in enumerate(WEIGHTS) if wanted is None or w[0] in wanted]
    return constants(spark, rows, "weight_pos int, weight_id string, meaning string, " + ", ".join(f"w_{d} double" for d in DIMENSIONS))


def join_scores(scored: DataFrame, candidates: DataFrame, text: bool = True) -> DataFrame:
    """Scored rows with length and features (and text) of their candidate; of candidates that share an id the last holds, unmatched rows drop."""
    keep = ["language", "doc_id", "char_len", "pos", *(c for c in FEATURES if c in candidates.columns), *(["text"] if text else [])]
    return scored.join(last_order(candidates.select(*keep), ["language", "doc_id"], [F.col("pos")]), ["language", "doc_id"])


def missing_text(scored: DataFrame, candidates: DataFrame) -> DataFrame:
    """Scored rows without a candidate, by language."""
    return scored.join(candidates, ["language", "doc_id"], "left_anti").groupBy("language").agg(F.count("*").alias("n_missing"))


def _scored(docs: DataFrame, score: Column, chars_per_token: float) -> DataFrame:
    """Scores are rounded to nine places, so that sums in another order tie alike; NaN scores sort above all numbers and are left out."""
    rows = docs.withColumn("weighted_score", F.round(score, 9)).withColumn("estimated_tokens", estimated_tokens(F.col("char_len"), chars_per_token))
    return rows.where(F.col("weighted_score").isNotNull() & ~F.isnan("weighted_score"))


def with_text(selected: DataFrame, candidates: DataFrame, text_col: str = "text") -> DataFrame:
    """Selected rows, which carry no texts through the selection, with those of their candidates."""
    keys = ["language", "doc_id", "pos"]
    return selected.join(candidates.select(*keys, text_col), keys)


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.drop("text")


def _best_first(rows: DataFrame, groups: list[str], budget: float) -> DataFrame:
    """Levels: 1/256 of a unit, the score itself, and for equal scores the position."""
    score = F.col("weighted_score")
    levels = [-F.floor(score * STEPS), -F.round(score * FINE), *by_position()]
    return take_until(rows, groups, levels, [F.desc("weighted_score"), F.asc("pos")], F.col("estimated_tokens"), budget)


def select_for_weight(docs: DataFrame, weights: Mapping[str, float], budget: float, chars_per_token: float = CHARS_PER_TOKEN, groups: tuple[str, ...] = ("language",)) -> DataFrame:
    """Best scores first, ties in source order, until the budget is met in each group. Texts are left out; ``with_text`` joins them."""
    return _best_first(_scored(_narrow(docs), weighted_score(weights), chars_per_token), list(groups), budget)


def select_all_weights(docs: DataFrame, weights: DataFrame, budget: float, chars_per_token: float = CHARS_PER_TOKEN) -> DataFrame:
    """All weight vectors in one plan: narrow rows times the few vectors (a table of constants), then one window. Join texts afterwards."""
    narrow = docs.select("doc_id", "language", "source", "char_len", "pos", *DIMENSIONS)
    crossed = narrow.crossJoin(F.broadcast(weights.select("weight_id", *(f"w_{d}" for d in DIMENSIONS))))
    score = weighted_score({d: F.col(f"w_{d}") for d in DIMENSIONS})
    rows = _scored(crossed, score, chars_per_token).drop(*(f"w_{d}" for d in DIMENSIONS))
    return _best_first(rows, ["weight_id", "language"], budget)


def select_random(docs: DataFrame, budget: float, seed: int = 42, chars_per_token: float = CHARS_PER_TOKEN, groups: tuple[str, ...] = ("language",)) -> DataFrame:
    """In the order of a seeded hash of the id, the same on any number of partitions."""
    key = F.md5(F.concat(F.lit(str(seed)), F.col("doc_id").cast("string")))
    rows = _narrow(docs).withColumn("__key", key).withColumn("weighted_score", F.lit(None).cast("double")).withColumn("estimated_tokens", estimated_tokens(F.col("char_len"), chars_per_token))
    levels = [F.conv(F.substring("__key", 1, 3), 16, 10), F.conv(F.substring("__key", 4, 3), 16, 10)]
    return take_until(rows, groups, levels, [F.asc("__key"), F.asc("pos")], F.col("estimated_tokens"), budget).drop("__key")


def is_clean(min_language: float = 0.9, max_repetition: float = 0.1, min_script: float = 0.9) -> Column:
    """Bounds are inclusive; a null feature fails."""
    test = (F.col("language_score") >= min_language) & (F.col("repetition_score") <= max_repetition) & (F.col("target_script_ratio") >= min_script)
    return F.coalesce(test, F.lit(False))


def select_clean_heuristic(docs: DataFrame, budget: float, chars_per_token: float = CHARS_PER_TOKEN, groups: tuple[str, ...] = ("language",), **bounds: float) -> DataFrame:
    """Clean rows in source order until the budget is met. Texts are left out."""
    rows = _narrow(docs.where(is_clean(**bounds))).withColumn("weighted_score", F.lit(None).cast("double")).withColumn("estimated_tokens", estimated_tokens(F.col("char_len"), chars_per_token))
    return take_until(rows, groups, by_position(), [F.asc("pos")], F.col("estimated_tokens"), budget)


def select_baseline(name: str, docs: DataFrame, budget: float, best_weights: Mapping[str, float] | None = None, **options) -> DataFrame:
    if name not in BASELINES:
        raise ValueError(f"unknown baseline {name!r}, expected one of {BASELINES}")
    if name == "random":
        return select_random(docs, budget, **options)
    if name == "clean_heuristic":
        return select_clean_heuristic(docs, budget, **options)
    if name == "equal_average":
        return select_for_weight(docs, EQUAL_WEIGHTS, budget, **options)
    if best_weights is None:
        raise ValueError("best_weighted needs best_weights")
    return select_for_weight(docs, best_weights, budget, **options)


def selection_report(selected: DataFrame, languages: DataFrame, budget: float, groups: tuple[str, ...] = ("language",)) -> DataFrame:
    """Rows and estimated tokens of each group, and whether it is empty or under half of the budget."""
    sums = selected.groupBy(*groups).agg(F.count("*").alias("n_docs"), F.sum("estimated_tokens").alias("est_tokens"))
    out = languages.join(sums, list(groups), "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0).cast("long"))).withColumn("est_tokens", F.coalesce("est_tokens", F.lit(0.0)))
    return out.withColumn("warning", F.when(F.col("n_docs") == 0, "empty").when(F.col("est_tokens") < budget / 2, "under half").otherwise("none"))
