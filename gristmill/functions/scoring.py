"""Scores, losses and report formats as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.constants import ANSWER_LINE, CHARS_PER_TOKEN, LETTERS


def weighted_score(weights: Mapping[str, float | Column]) -> Column:
    """Sum of weight times score, from left to right in the order of ``weights``."""
    out = None
    for name, w in weights.items():
        term = (w if isinstance(w, Column) else F.lit(float(w))) * F.col(name)
        out = term if out is None else out + term
    return out


def estimated_tokens(char_len: Column, chars_per_token: float = CHARS_PER_TOKEN) -> Column:
    return char_len / F.lit(float(chars_per_token))


def huber(predicted: Column, target: Column, delta: float = 1.0) -> Column:
    d = F.abs(predicted - target)
    return F.when(d <= delta, 0.5 * d * d).otherwise(delta * (d - 0.5 * delta))


def perplexity(loss: Column) -> Column:
    return F.exp(loss)


def token_normalized_probability(sum_log_prob: Column, n_tokens: Column) -> Column:
    return F.exp(F.try_divide(sum_log_prob, n_tokens))


def improvement(base: Column, value: Column, lower_is_better: bool) -> Column:
    """Relative to ``base``, positive if better; null for a base of 0."""
    return F.try_divide(base - value if lower_is_better else value - base, base)


def split_size(pool: int, ratio: float) -> int:
    """Half to even, as the sizes of splits are rounded."""
    return round(pool * ratio)


def signed_percent(x: Column) -> Column:
    return F.when(x.isNull(), "—").otherwise(F.format_string("%+.2f%%", x * 100))


def l2_normalize(vector: Column) -> Column:
    """To unit length; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def passage(text: Column) -> Column:
    return F.concat(F.lit("passage: "), text)


def is_simplex(weights: Sequence[Column]) -> Column:
    total = sum(weights[1:], weights[0])
    ok = F.abs(total - 1) < 1e-9
    for w in weights:
        ok = ok & (w >= 0)
    return ok


def mcq_context(question: Column, choices: Column) -> Column:
    """The question, its lettered choices (eight at most), the instruction and the answer line."""
    letters = F.array(*map(F.lit, LETTERS))
    listed = F.transform(F.slice(choices, 1, len(LETTERS)), lambda c, i: F.concat(F.element_at(letters, i + 1), F.lit(". "), c))
    return F.array_join(F.concat(F.array(question), listed, F.array(F.lit(ANSWER_LINE), F.lit("Answer:"))), "\n")


def choice_letters(choices: Column) -> Column:
    return F.slice(F.array(*map(F.lit, LETTERS)), 1, F.least(F.size(choices), F.lit(len(LETTERS))))


def gold_of_label(label: Column, labels: Sequence[str]) -> Column:
    return (F.array_position(F.array(*map(F.lit, labels)), label) - 1).cast("int")


def gold_of_number(number: Column) -> Column:
    """0-based, of a 1-based number that may be a string."""
    return number.cast("int") - 1
