"""Candidate corpus: positioned scans, dedup by key, word-list rejection, features, validation sets."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.constants import BANNED_WORDS, CHARS_PER_TOKEN, LANGUAGES
from gristmill.functions import kernel
from gristmill.functions import text as T
from gristmill.functions.scoring import estimated_tokens, split_size
from gristmill.operators.prefix import by_position, take_until
from gristmill.storage import Workspace


def first_rows(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """The first ``n`` rows by position. ``pos`` counts from 0 without gaps, so this is a filter that reaches the scan, not a sort."""
    return df.where(F.col(pos) < n)


def rows_after(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    return df.where(F.col(pos) >= n)


def numbered(df: DataFrame, order: Iterable[Column], name: str = "pos") -> DataFrame:
    """Rows with their 0-based position in a global order, written once: ranges are sorted, and counts of the files give each one's offset.

    The driver sees one count for each range. Ties in ``order`` have no defined order; end it with a key.
    """
    order = list(order)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    written = Workspace(df.sparkSession, "numbered").write(ranged.withColumn("__row", row), "rows")
    sizes = sorted((r["__part"], r["count"]) for r in written.groupBy("__part").count().collect())
    starts = [(part, sum(n for _, n in sizes[:k])) for k, (part, _) in enumerate(sizes)]
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "__part int, __start long"))  # a row for each range
    return written.join(offsets, "__part").withColumn(name, F.col("__start") + F.col("__row")).drop("__part", "__row", "__start")


def stream_docs(source: DataFrame, target: int, label: str) -> DataFrame:
    """The first ``target`` rows (id, text, language_score, pos) as candidates; ``char_len`` is of the text before it is stripped."""
    raw = F.coalesce("text", F.lit(""))
    return first_rows(source, target).select(F.col("id").cast("string").alias("doc_id"), T.strip(raw).alias("text"), F.length(raw).alias("char_len"), "language_score", F.lit(label).alias("source"), "pos")


def stream_after_skip(source: DataFrame, skip: int, token_target: float, label: str, chars_per_token: float = CHARS_PER_TOKEN) -> DataFrame:
    """Rows from position ``skip`` until their estimated tokens reach the target; one row at least. ``char_len`` is of the stripped text."""
    rows = rows_after(source, skip).withColumn("text", T.strip("text")).withColumn("char_len", F.length("text"))
    rows = rows.withColumn("estimated_tokens", estimated_tokens(F.col("char_len"), chars_per_token))
    narrow = take_until(rows.select("pos", "estimated_tokens"), [], by_position(), [F.col("pos")], F.col("estimated_tokens"), token_target, at_least_one=True)
    some = rows.join(narrow.select("pos"), "pos")
    return some.select(F.col("id").cast("string").alias("doc_id"), "text", "char_len", F.lit(label).alias("source"), "pos")


def union_sources(clean: DataFrame, removed: DataFrame) -> DataFrame:
    """Clean rows, then removed ones; ``src_ord`` keeps that order."""
    return clean.withColumn("src_ord", F.lit(0)).unionByName(removed.withColumn("src_ord", F.lit(1)))


def pool_sizes(pool: int, clean_ratio: float = 0.8) -> tuple[int, int]:
    clean = split_size(pool, clean_ratio)
    return clean, pool - clean


def keep_first(df: DataFrame, keys: Iterable[str], order: Iterable[Column]) -> DataFrame:
    """The first row of each key. A minimum of a struct is pre-aggregated where a window would gather all rows of a key."""
    own = [F.col(k) for k in keys]
    order = list(order)
    rest = [c for c in df.columns if c not in set(keys)]
    best = df.groupBy(*own).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*own, "__row.*").select(*df.columns)


def reject_banned(df: DataFrame, banned: Iterable[str] = BANNED_WORDS, text_col: str = "text") -> DataFrame:
    return df.where(~T.has_banned_word(F.col(text_col), banned))


def with_features(df: DataFrame, text_col: str = "text", lang_col: str = "language") -> DataFrame:
    """The six features in one pass over Arrow batches; as expressions, each of them would go through the text several times."""
    return kernel.with_features(df, text_col, lang_col)


def build_corpus(clean: DataFrame, removed: DataFrame, language: Column, banned: Iterable[str] = BANNED_WORDS) -> DataFrame:
    """Clean and removed candidates of a language: first of each id, no banned words, then features (the costly part last)."""
    rows = union_sources(clean, removed).withColumn("language", language)
    rows = keep_first(rows, ["language", "doc_id"], [F.col("src_ord"), F.col("pos")])
    return with_features(reject_banned(rows, banned))


def build_counts(rows: DataFrame, banned: Iterable[str] = BANNED_WORDS) -> DataFrame:
    """Rows read, repeated ids dropped, banned ones dropped and kept, by language: one conditional aggregation over rows with ``src_ord`` and ``pos``."""
    marked = rows.withColumn("bad", T.has_banned_word(F.col("text"), banned))
    best = marked.groupBy("language", "doc_id").agg(F.count("*").alias("n"), F.min_by("bad", F.struct("src_ord", "pos")).alias("bad"))
    return best.groupBy("language").agg(F.sum("n").alias("n_read"), F.sum(F.col("n") - 1).alias("n_duplicate"), F.count_if("bad").alias("n_banned"), F.count_if(~F.col("bad")).alias("n_kept"))


def validation_set(clean: DataFrame, removed: DataFrame, skip: tuple[int, int], tokens: tuple[float, float], candidates: DataFrame) -> DataFrame:
    """Rows after the candidates' positions, and none of the candidates whatever the offsets."""
    rows = union_sources(stream_after_skip(clean, skip[0], tokens[0], "clean"), stream_after_skip(removed, skip[1], tokens[1], "removed"))
    return rows.join(candidates.select("doc_id").distinct(), "doc_id", "left_anti")


def available_configs(wanted: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wanted configurations that the catalogue has, and those it lacks."""
    return wanted.join(catalogue, "config", "left_semi"), wanted.join(catalogue, "config", "left_anti")


def record_of(raw: DataFrame) -> DataFrame:
    """Annotation rows as records: cleaned ids with the language before them, integer scores, one renamed column."""
    scores = {"educational_value": "educational_value", "reasoning": "reasoning", "professionalism": "professionalism", "cleanliness": "cleanliness", "cultural_nuances": "cultural_nuance"}
    return raw.select(
        F.concat_ws("_", "language", T.clean_id(F.col("id"))).alias("doc_id"), "language", "text", *(F.col(a).cast("int").alias(b) for a, b in scores.items()),
        "source", "len_bucket", "lang_bucket", F.col("char_len").cast("int").alias("char_len"),
    )


def last_order(df: DataFrame, keys: Iterable[str], order: Iterable[Column]) -> DataFrame:
    """The last row of each key, as a dictionary keeps it."""
    own = [F.col(k) for k in keys]
    rest = [c for c in df.columns if c not in set(keys)]
    best = df.groupBy(*own).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*own, "__row.*").select(*df.columns)


def first_k(df: DataFrame, key: str, order: Iterable[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key; Spark cuts each task's rows to ``k`` before the shuffle."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


def chosen_languages(wanted: Iterable[str] | None) -> list[str]:
    """The languages asked for, in their usual order; an unknown one is an error, none asked for means all."""
    if wanted is None:
        return list(LANGUAGES)
    wanted = set(wanted)
    if unknown := sorted(wanted - set(LANGUAGES)):
        raise ValueError(f"unknown languages {unknown}, expected some of {list(LANGUAGES)}")
    return [c for c in LANGUAGES if c in wanted]


def union_languages(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of several languages in their usual order, with ``language`` and, as its place, ``language_pos``."""
    out = None
    for k, lang in enumerate(chosen_languages(parts)):
        own = parts[lang].withColumns({"language": F.lit(lang), "language_pos": F.lit(k)})
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no language given")
    return out
