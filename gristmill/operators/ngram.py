"""Count-based language models: word bigrams with interpolated Kneser-Ney discounts, fitted by grouped aggregation, and their losses.

Several models that read parts of the same texts are fitted in one pass: a document says which of them read it, and each pair of words has a
count for each model in one row. So texts are cut into words once, and what is shuffled doesn't grow with the number of models times the texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.storage import Workspace

#: What stands before the first word of a text; no word is empty.
START = ""


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space, lower-cased. Cut at one character, which needs no regular expression and takes a fraction of its time."""
    spaced = F.lower(F.coalesce(text, F.lit("")))
    for c in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def pairs(df: DataFrame, keep: Sequence[str], text_col: str = "text") -> DataFrame:
    """A row for each word ``w`` of each text, with the word ``v`` before it."""
    listed = df.select(*keep, words(F.col(text_col)).alias("w"))
    both = listed.select(*keep, F.slice(F.concat(F.array(F.lit(START)), F.col("w")), 1, F.size("w")).alias("v"), "w")
    return both.select(*keep, F.explode(F.arrays_zip("v", "w")).alias("__p")).select(*keep, "__p.v", "__p.w")


def discount(ones: float, twos: float) -> float:
    """The share of a count that is kept back for what wasn't seen: n1 / (n1 + 2 n2), and a half where no count is 1 or 2."""
    return ones / (ones + 2 * twos) if ones else 0.5


@dataclass
class Bigrams:
    """Fitted models. ``counts`` (v, w, c0, c1, ...), ``contexts`` (v, t0, u0, ...: tokens and distinct words after v), ``continued`` (w, a0, ...: distinct words
    before w); per model the discounts of both levels, and the numbers of distinct pairs and of words."""

    models: list[str]
    counts: DataFrame
    contexts: DataFrame
    continued: DataFrame
    first: list[float]
    second: list[float]
    kinds: list[int]
    seen: list[int]
    vocabulary: int

    def probability(self, k: int) -> Column:
        """P(w | v) of model ``k``, over rows joined with the three tables. Over all words of the vocabulary it adds up to 1."""
        some = max(self.kinds[k], 1)
        back = self.second[k] * self.seen[k] / some if self.kinds[k] else 1.0  # an empty model knows nothing
        lower = f"(greatest(coalesce(a{k}, 0) - {self.second[k]!r}D, 0D) / {some}D + {back / self.vocabulary!r}D)"
        return F.expr(f"if(t{k} > 0, greatest(coalesce(c{k}, 0) - {self.first[k]!r}D, 0D) / t{k} + {self.first[k]!r}D * u{k} / t{k} * {lower}, {lower})")


    def any_probability(self, k: str) -> Column:
        """``probability`` of the model whose number is in column ``k``, over rows joined with the tables' counts as arrays ``c``, ``t``, ``u``, ``a``.

        One expression for all models: one for each of 26 makes a method that the JVM leaves to its interpreter.
        """
        some = [max(x, 1) for x in self.kinds]
        back = [(b * n / x if y else 1.0) / self.vocabulary for b, n, x, y in zip(self.second, self.seen, some, self.kinds, strict=True)]
        own = lambda values: F.get(F.array(*(F.lit(float(x)) for x in values)), F.col(k))
        count = lambda name: F.coalesce(F.get(F.col(name), F.col(k)), F.lit(0)).cast("double")
        left = lambda name, kept: F.greatest(count(name) - own(kept), F.lit(0.0))
        lower = left("a", self.second) / own(some) + own(back)
        return F.when(count("t") > 0, left("c", self.first) / count("t") + own(self.first) * count("u") / count("t") * lower).otherwise(lower)


#: Models in one mask: the bits of a long but its sign.
MASK_BITS = 63


def mask_columns(models: Sequence[str]) -> list[str]:
    return [f"__reads{k}" for k in range(-(-len(models) // MASK_BITS))]


def masks(selected: DataFrame, models: Sequence[str], name_col: str, key: str) -> DataFrame:
    """(key, masks): which models read a document, as bits, for selections (model, key)."""
    number = F.create_map(*(F.lit(x) for k, m in enumerate(models) for x in (m, k)))
    numbered = selected.select(key, F.element_at(number, F.col(name_col)).alias("__n")).where("__n is not null")
    bit = lambda k: F.when(F.floor(F.col("__n") / MASK_BITS) == k, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("__n") % MASK_BITS).cast("int"))).otherwise(F.lit(0).cast("long"))
    return numbered.groupBy(key).agg(*(F.bit_or(bit(k)).alias(c) for k, c in enumerate(mask_columns(models))))


def all_of(models: Sequence[str]) -> dict[str, Column]:
    """The masks of a text that every model reads."""
    return {c: F.lit((1 << min(MASK_BITS, len(models) - k * MASK_BITS)) - 1).cast("long") for k, c in enumerate(mask_columns(models))}


def fit(docs: DataFrame, models: Sequence[str], vocabulary: DataFrame, ws: Workspace, text_col: str = "text") -> Bigrams:
    """Models from the rows of ``docs`` whose masks have their bit. ``vocabulary`` has a row for each word that may occur.

    One aggregation of word pairs, two of its result; the driver gets six numbers for each model.
    """
    names, columns = list(models), mask_columns(models)
    rows = pairs(docs, columns, text_col)
    span = range(len(names))
    tell = lambda *sql: [F.expr(x) for x in sql]
    counts = ws.write(rows.groupBy("v", "w").agg(*tell(*(f"count_if(((`{columns[k // MASK_BITS]}` >> {k % MASK_BITS}) & 1) = 1) AS c{k}" for k in span))), "counts")
    contexts = ws.write(counts.groupBy("v").agg(*tell(*(f"sum(c{k}) AS t{k}" for k in span), *(f"count_if(c{k} > 0) AS u{k}" for k in span))), "contexts")
    continued = ws.write(counts.groupBy("w").agg(*tell(*(f"count_if(c{k} > 0) AS a{k}" for k in span))), "continued")
    kinds = lambda x: tell(*(f"count_if({x}{k} {test}) AS {name}_{k}" for k in span for name, test in (("n1", "= 1"), ("n2", "= 2"), ("n", "> 0"))))
    one, two = counts.agg(*kinds("c")).first(), continued.agg(*kinds("a")).first()
    of = lambda row: [discount(row[f"n1_{k}"], row[f"n2_{k}"]) for k in span]
    return Bigrams(names, counts, contexts, continued, of(one), of(two), [one[f"n_{k}"] for k in span], [two[f"n_{k}"] for k in span], max(vocabulary.count(), 1))


def losses(model: Bigrams, held_out: DataFrame, groups: Sequence[str], ws: Workspace, text_col: str = "text") -> DataFrame:
    """(model, groups..., loss, n_tokens): mean negative log-probability of the held-out words, to six places.

    Distinct pairs of each group are counted first, and these counts are joined with the models' tables; a frequent word is one row on that side,
    and on the other as many as words stand beside it, which Spark splits.
    """
    groups, span = list(groups), range(len(model.models))
    seen = ws.write(pairs(held_out, groups, text_col).groupBy(*groups, "v", "w").agg(F.count("*").alias("n")), "held_out")
    packed = lambda df, keys, *names: df.select(*keys, *(F.array(*(f"{x}{k}" for k in span)).alias(x) for x in names))
    joined = seen.join(packed(model.counts, ["v", "w"], "c"), ["v", "w"], "left").join(packed(model.contexts, ["v"], "t", "u"), "v", "left").join(packed(model.continued, ["w"], "a"), "w", "left")
    each = joined.select(*groups, "n", "c", "t", "u", "a", F.explode(F.array(*map(F.lit, span))).alias("__k"))
    sums = each.groupBy(*groups, "__k").agg(F.sum("n").alias("n_tokens"), F.sum(-F.col("n") * F.ln(model.any_probability("__k"))).alias("loss"))
    name = F.element_at(F.array(*map(F.lit, model.models)), F.col("__k") + 1)
    return sums.select(name.alias("model"), *groups, F.round(F.col("loss") / F.col("n_tokens"), 6).alias("loss"), "n_tokens")


def continued_losses(base: DataFrame, candidates: DataFrame, selected: DataFrame, held_out: DataFrame, models: Sequence[str], name_col: str = "model", key: str = "doc_id", group: str = "language", with_base: str | None = None, texts: DataFrame | None = None) -> DataFrame:
    """(model, language, loss, n_tokens) on ``held_out`` of models that read ``base`` and then the candidates ``selected`` (model, key) for them.

    ``with_base`` names the model that read the base alone. What models read is a mask of bits of a document; the selections, which are
    narrow, are joined to the texts once. All of ``base``, ``candidates`` and ``held_out`` have the key, the group and ``text``. ``texts`` is
    what the vocabulary comes from: give the table of which these three are parts, and it is read once, not for each of them.
    """
    ws = Workspace(base.sparkSession, "ngram")
    names = [*models, *([with_base] if with_base else [])]
    mask = ws.write(masks(selected.where(F.col(name_col).isin(*models)), names, name_col, key), "masks", narrow=True)  # written, so Spark sees how small it is and texts stay where they are
    chosen = candidates.select(key, "text").join(mask, key)
    docs = base.select(key, "text").withColumns(all_of(names)).unionByName(chosen)
    every = base.select("text").unionByName(candidates.select("text")).unionByName(held_out.select("text")) if texts is None else texts
    vocabulary = every.select(F.explode(F.array_distinct(words(F.col("text")))).alias("w")).distinct()
    fitted = fit(docs, names, vocabulary, ws)
    return ws.write(losses(fitted, held_out, [group], ws), "losses")
