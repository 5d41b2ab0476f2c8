"""Multiple-choice documents: prompts, exemplars, and rows held out for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.constants import TOPICS
from gristmill.functions.scoring import choice_letters, gold_of_label, gold_of_number, mcq_context
from gristmill.operators.corpus import first_k, first_rows


def topic_docs(rows: DataFrame) -> DataFrame:
    """Sentences (text, category) with the fixed topics as choices."""
    choices = F.array(*map(F.lit, TOPICS))
    question = F.concat(F.col("text"), F.lit("\nQuestion: What is the topic of this sentence?"))
    return rows.withColumns({"context": mcq_context(question, choices), "choices": choice_letters(choices), "choice_texts": choices, "gold": gold_of_label(F.col("category"), TOPICS)})


def passage_docs(rows: DataFrame) -> DataFrame:
    """Passages with a question, four answers and the number of the right one (from 1, as text)."""
    choices = F.array(*(F.col(f"mc_answer{k}") for k in range(1, 5)))
    question = F.concat(F.col("flores_passage"), F.lit("\nQuestion: "), F.col("question"))
    return rows.withColumns({"context": mcq_context(question, choices), "choices": choice_letters(choices), "choice_texts": choices, "gold": gold_of_number(F.col("correct_answer_num"))})


def subject_docs(rows: DataFrame) -> DataFrame:
    """Questions (question, subject, choices, answer)."""
    return rows.withColumns({"context": mcq_context(F.col("question"), F.col("choices")), "choice_texts": F.col("choices"), "choices": choice_letters(F.col("choices")), "gold": F.col("answer").cast("int")})


def fewshot_prefix(exemplars: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """For each key its exemplars' prompts with their answers, a blank line after each. Exemplars are few for each key."""
    block = F.concat("context", F.lit(" "), F.element_at("choices", F.col("gold") + 1), F.lit("\n\n"))
    return exemplars.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), block.alias("b")))), lambda x: x["b"]), "").alias("prefix"))


def with_prefix(docs: DataFrame, prefixes: DataFrame, keys: list[str]) -> DataFrame:
    """Prompts after their key's exemplars; a key without any keeps its prompts as they are."""
    joined = docs.join(prefixes, keys, "left")
    return joined.withColumn("context", F.concat(F.coalesce("prefix", F.lit("")), F.col("context"))).drop("prefix")


def hold_out(docs: DataFrame, keys: list[str], k: int, order: str = "pos") -> tuple[DataFrame, DataFrame]:
    """The first ``k`` rows of each key as exemplars, and the rest; at least one row of a key is left."""
    sizes = docs.groupBy(*keys).agg(F.count("*").alias("__size"))
    ranked = docs.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).join(sizes, keys)
    kept = F.least(F.lit(max(k, 0)), F.col("__size") - 1)
    return ranked.where(F.col("__n") <= kept).drop("__n", "__size"), ranked.where(F.col("__n") > kept).drop("__n", "__size")


def sample(docs: DataFrame, per_subject: int | None = None, limit: int | None = None, order: str = "pos") -> DataFrame:
    """The first rows of each subject if ``per_subject`` is given, else the first ``limit`` of all, else all."""
    if per_subject is not None:
        return first_k(docs, "subject", [F.col(order)], per_subject)
    return docs if limit is None else first_rows(docs, limit, order)
