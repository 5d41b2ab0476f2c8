"""Feature, corpus and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.constants import BANNED_WORDS, DIMENSIONS, EQUAL_WEIGHTS, LATIN, SCRIPT_RANGES, STOPWORDS
from gristmill.functions import text as T
from gristmill.functions.scoring import estimated_tokens
from gristmill.operators import corpus as C
from gristmill.operators import selection as S
from gristmill.plans.base import BUDGET, CAND, EST, WEIGHTS_SQL, before, candidates, scored
from gristmill.session import load
from gristmill.sources.positions import OrderedFiles
from gristmill.storage import Workspace

SP, BR = T.SPACE, T.LINE_BREAK


def _docs(spark, sf):
    return load(spark, sf, "documents")


WORDS = f"list_filter(string_split_regex(text, '[{SP}]+'), lambda x: x <> '')"
LINES = f"list_filter(list_transform(string_split_regex(text, '{BR}'), lambda x: regexp_replace(x, '^[{SP}]+|[{SP}]+$', '', 'g')), lambda x: x <> '')"
REPETITION = f"""WITH d AS (SELECT doc_id, {LINES} AS l, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, l, w, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS t FROM d),
r AS (SELECT doc_id, w, CASE WHEN len(l) > 0 THEN 1 - len(list_distinct(l)) / len(l)::DOUBLE ELSE 0 END AS a,
             CASE WHEN len(t) > 0 THEN 1 - len(list_distinct(t)) / len(t)::DOUBLE ELSE 0 END AS b FROM g)
SELECT doc_id, CAST(CASE WHEN len(w) < 6 THEN a ELSE greatest(a, b) END AS DOUBLE) AS repetition_score FROM r"""
LETTERS = r"length(regexp_replace(text, '[^\p{L}]', '', 'g'))"


def _inside(ranges):
    return rf"length(regexp_replace(regexp_replace(text, '[^\p{{L}}]', '', 'g'), '[^{T.class_of(ranges)}]', '', 'g'))"


SCRIPT = f"CASE WHEN {LETTERS} = 0 THEN 0 ELSE {_inside(SCRIPT_RANGES['en'])} / {LETTERS}::DOUBLE END"
LATIN_SQL = f"CASE WHEN {LETTERS} = 0 THEN 0 WHEN {_inside(LATIN)} * 2 >= {LETTERS} THEN 1 ELSE 0 END"
SYMBOLS = rf"CASE WHEN length(text) = 0 THEN 0 ELSE length(regexp_replace(text, '[\p{{L}}\p{{N}}{SP}]', '', 'g')) / length(text)::DOUBLE END"
NUMBERS = f"CASE WHEN length(text) = 0 THEN 0 ELSE (length(text) - length(regexp_replace(text, '[{T.DIGITS}]', '', 'g'))) / length(text)::DOUBLE END"
MARKS = "[" + "".join("\\" + c for c in T.EDGE_MARKS).replace("'", "''") + "]"


def _list(items):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in items) + "]"


def _hits(lang):
    return f"len(list_filter(w, lambda x: list_contains({_list(STOPWORDS[lang])}, regexp_replace(x, '^{MARKS}+|{MARKS}+$', '', 'g'))))"


SEGMENTED = f"""WITH d AS (SELECT doc_id, lang, list_filter(string_split_regex(lower(text), '[{SP}]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, CAST(CASE WHEN len(w) = 0 THEN 0 ELSE CASE lang {' '.join(f"WHEN '{c}' THEN {_hits(c)}" for c in ("en", "de", "es", "fr"))} ELSE 0 END / len(w)::DOUBLE END AS DOUBLE) AS stopword_ratio FROM d"""
#: Function words that occur as substrings of the test texts, to drive the path of languages without word spaces.
SUBSTRINGS = ["th", "an", "er", "de", "la"]
UNSEG = "SELECT doc_id, CAST(least(1.0, (" + " + ".join(f"(length(text) - length(replace(text, '{w}', ''))) / {len(w)}::DOUBLE" for w in SUBSTRINGS) + ") / greatest(1.0, length(text) / 20.0::DOUBLE)) AS DOUBLE) AS stopword_ratio FROM documents"


def cheap_features(spark, sf):
    return C.with_features(candidates(spark, sf)).select("doc_id", "repetition_score", "target_script_ratio", "stopword_ratio", "symbol_ratio", "numeric_ratio", "is_latin")


FEATURES = f"""SELECT d.doc_id, r.repetition_score, s.stopword_ratio, CAST({SCRIPT} AS DOUBLE) AS target_script_ratio, CAST({SYMBOLS} AS DOUBLE) AS symbol_ratio,
       CAST({NUMBERS} AS DOUBLE) AS numeric_ratio, CAST({LATIN_SQL} AS INT) AS is_latin
FROM documents d JOIN ({REPETITION}) r ON d.doc_id = r.doc_id JOIN ({SEGMENTED}) s ON d.doc_id = s.doc_id"""
BANNED = f"list_has_any(string_split_regex(lower(text), '[^a-zA-Z0-9]+'), {_list(BANNED_WORDS)})"


def _twice(spark, sf):
    """Candidates and, after them, all of them again with other texts: sources that overlap in every key."""
    rows = candidates(spark, sf)
    again = rows.withColumns({"text": F.upper("text"), "source": F.lit("again")})
    return C.union_sources(rows, again)


TWICE = f"WITH {CAND}, twice AS (SELECT *, 0 AS src_ord FROM cand UNION ALL SELECT doc_id, pos, upper(text), char_len, language, 'again', language_score, 1 FROM cand)"


def dedup_keep_first(spark, sf):
    kept = C.keep_first(_twice(spark, sf), ["language", "doc_id"], [F.col("src_ord"), F.col("pos")])
    return kept.select("language", "doc_id", "source", F.md5("text").alias("text_md5"))


def corpus_build(spark, sf):
    rows = candidates(spark, sf)
    built = C.build_corpus(rows.where("source = 'clean'"), rows.where("source = 'removed'"), F.col("language"))
    return built.select("doc_id", "source", "char_len", "repetition_score", "symbol_ratio", "is_latin")


def _folder(spark, sf, parts=16):
    """The documents as a source without a position: a folder of files whose order, and the rows' order in each, is all there is."""
    rows = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", (F.lit(0.8) + (F.col("doc_id") % 21).cast("double") / 100.0).alias("language_score"))
    ws = Workspace(spark, "source")
    ws.write(rows.repartitionByRange(parts, "id").sortWithinPartitions("id"), "documents")
    return OrderedFiles(spark, ws.path("documents"))


def stream_limit(spark, sf):
    source = _folder(spark, sf).first(300)
    return C.stream_docs(source, 300, "clean").select(F.col("doc_id").cast("long").alias("doc_id"), "char_len", "source")


def stream_skip_budget(spark, sf):
    source = _folder(spark, sf).until(100, estimated_tokens(F.length(T.strip("text"))), BUDGET)
    return C.stream_after_skip(source, 100, BUDGET, "clean").select(F.col("doc_id").cast("long").alias("doc_id"), "char_len")


def validation_no_overlap(spark, sf):
    rows = candidates(spark, sf).withColumnRenamed("doc_id", "id")
    known = candidates(spark, sf).where("pos < 105").select(F.col("doc_id").cast("string").alias("doc_id"))
    out = C.validation_set(rows.where("source = 'clean'"), rows.where("source = 'removed'"), (100, 100), (BUDGET, BUDGET / 4), known)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "char_len", "source")


def _skip(source, skip, budget):
    return f"(SELECT doc_id, char_len, source FROM (SELECT *, {before('', 'pos')} AS b, row_number() OVER (ORDER BY pos) AS n FROM cand WHERE pos >= {skip}{source}) WHERE b < {budget} OR n = 1)"


def joined(spark, sf):
    return S.join_scores(scored(spark, sf).drop("pos", "char_len", "language_score"), candidates(spark, sf).drop("source"))


def join_scores_text(spark, sf):
    return joined(spark, sf).select("doc_id", "language", "char_len", F.md5("text").alias("text_md5"), *DIMENSIONS)


def missing_text_report(spark, sf):
    """Scored rows whose language has no candidate of that id: the candidates are those whose texts hold no banned word."""
    return S.missing_text(scored(spark, sf), C.reject_banned(candidates(spark, sf)))


def cross_weights(spark, sf):
    weights = S.weights_table(spark)
    rows = scored(spark, sf).select("doc_id", *DIMENSIONS).crossJoin(F.broadcast(weights))
    from gristmill.functions.scoring import weighted_score

    score = F.round(weighted_score({d: F.col(f"w_{d}") for d in DIMENSIONS}), 9)
    return rows.withColumn("s", score).groupBy("weight_id").agg(F.count("*").alias("n"), F.max("s").alias("best"), F.min("s").alias("least"))


SCORE = "round(" + " + ".join(f"w_{d} * {d}" for d in DIMENSIONS) + ", 9)"


def _selected(df):
    return df.select("doc_id", "language", "source", "weighted_score", "estimated_tokens")


def select_for_weight(spark, sf):
    return _selected(S.select_for_weight(scored(spark, sf), dict(zip(DIMENSIONS, (0.25, 0.10, 0.10, 0.15, 0.40), strict=True)), BUDGET))


def select_all_weights(spark, sf):
    return S.select_all_weights(scored(spark, sf), S.weights_table(spark), BUDGET).select("weight_id", "doc_id", "language", "weighted_score", "estimated_tokens")


def _weighted(where):
    return f"""WITH {CAND}, {WEIGHTS_SQL}, s AS (SELECT weight_id, doc_id, language, source, pos, char_len, {SCORE} AS weighted_score FROM scored CROSS JOIN weights {where}),
t AS (SELECT *, {EST} AS estimated_tokens, {before('weight_id, language', 'weighted_score DESC, pos')} AS b FROM s)"""


def select_random(spark, sf):
    return _selected(S.select_random(scored(spark, sf), BUDGET)).drop("weighted_score")


def select_clean_heuristic(spark, sf):
    return _selected(S.select_clean_heuristic(C.with_features(candidates(spark, sf)), BUDGET)).drop("weighted_score")


CLEAN = f"""WITH {CAND}, f AS ({FEATURES}), c AS (SELECT cand.* FROM cand JOIN f ON cand.doc_id = f.doc_id WHERE language_score >= 0.9::DOUBLE AND repetition_score <= 0.1::DOUBLE AND target_script_ratio >= 0.9::DOUBLE)"""


def clean_heuristic_filter(spark, sf):
    return C.with_features(candidates(spark, sf)).where(S.is_clean()).select("doc_id", "language")


def select_equal_average(spark, sf):
    return _selected(S.select_baseline("equal_average", scored(spark, sf), BUDGET))


def selection_warnings(spark, sf):
    rows = scored(spark, sf)
    return S.selection_report(S.select_for_weight(rows, EQUAL_WEIGHTS, 200_000.0), rows.select("language").distinct(), 200_000.0)


def weight_checks(spark, sf):
    from gristmill.functions.scoring import is_simplex

    return S.weights_table(spark).select("weight_id", "meaning", is_simplex([F.col(f"w_{d}") for d in DIMENSIONS]).alias("is_simplex"))


def build_counts(spark, sf):
    return C.build_counts(_twice(spark, sf))


def union_clean_removed(spark, sf):
    rows = candidates(spark, sf)
    return C.union_sources(rows.where("source = 'clean'"), rows.where("source = 'removed'")).groupBy("language", "source", "src_ord").agg(F.count("*").alias("n"), F.sum("char_len").alias("chars"))


W06 = "WHERE weight_id = 'W06'"
QUERIES = {
    "repetition_score": (lambda spark, sf: _docs(spark, sf).select("doc_id", T.repetition_score(F.col("text")).alias("repetition_score")), REPETITION),
    "target_script_ratio": (lambda spark, sf: _docs(spark, sf).select("doc_id", T.target_script_ratio(F.col("text"), F.col("lang")).alias("target_script_ratio")), f"SELECT doc_id, CAST({SCRIPT} AS DOUBLE) AS target_script_ratio FROM documents"),
    "stopword_ratio_segmented": (lambda spark, sf: _docs(spark, sf).select("doc_id", T.stopword_ratio(F.col("text"), F.col("lang")).alias("stopword_ratio")), SEGMENTED),
    "stopword_ratio_unsegmented": (lambda spark, sf: _docs(spark, sf).select("doc_id", T._unsegmented(F.col("text"), SUBSTRINGS).alias("stopword_ratio")), UNSEG),
    "symbol_ratio": (lambda spark, sf: _docs(spark, sf).select("doc_id", T.symbol_ratio(F.col("text")).alias("symbol_ratio")), f"SELECT doc_id, CAST({SYMBOLS} AS DOUBLE) AS symbol_ratio FROM documents"),
    "numeric_ratio": (lambda spark, sf: _docs(spark, sf).select("doc_id", T.numeric_ratio(F.col("text")).alias("numeric_ratio")), f"SELECT doc_id, CAST({NUMBERS} AS DOUBLE) AS numeric_ratio FROM documents"),
    "is_latin": (lambda spark, sf: _docs(spark, sf).select("doc_id", T.is_latin(F.col("text")).alias("is_latin")), f"SELECT doc_id, CAST({LATIN_SQL} AS INT) AS is_latin FROM documents"),
    "cheap_features": (cheap_features, FEATURES),
    "badword_reject": (lambda spark, sf: C.reject_banned(_docs(spark, sf)).select("doc_id", "lang"), f"SELECT doc_id, lang FROM documents WHERE NOT {BANNED}"),
    "strip_text": (lambda spark, sf: _docs(spark, sf).select("doc_id", F.length(T.strip(F.concat(F.lit(" \t　"), "text", F.lit("\n ")))).alias("n"), F.size(T.tokens(F.col("text"))).alias("n_tokens")), f"SELECT doc_id, CAST(length(regexp_replace(text, '^[{SP}]+|[{SP}]+$', '', 'g')) AS INT) AS n, CAST(len(string_split_regex(lower(text), '[^a-zA-Z0-9]+')) AS INT) AS n_tokens FROM documents"),
    "clean_heuristic_filter": (clean_heuristic_filter, f"{CLEAN} SELECT doc_id, language FROM c"),
    "dedup_keep_first": (dedup_keep_first, f"{TWICE} SELECT language, doc_id, source, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY language, doc_id ORDER BY src_ord, pos) AS n FROM twice) WHERE n = 1"),
    "union_clean_removed": (union_clean_removed, f"WITH {CAND} SELECT language, source, CASE source WHEN 'clean' THEN 0 ELSE 1 END AS src_ord, count(*) AS n, CAST(sum(char_len) AS BIGINT) AS chars FROM cand GROUP BY ALL"),
    "corpus_build": (corpus_build, f"WITH {CAND}, f AS ({FEATURES}) SELECT cand.doc_id, source, char_len, repetition_score, symbol_ratio, is_latin FROM cand JOIN f ON cand.doc_id = f.doc_id WHERE NOT {BANNED}"),
    "corpus_build_counts": (build_counts, f"{TWICE}, k AS (SELECT language, doc_id, count(*) AS n, arg_min({BANNED}, src_ord) AS bad FROM twice GROUP BY ALL) SELECT language, CAST(sum(n) AS BIGINT) AS n_read, CAST(sum(n - 1) AS BIGINT) AS n_duplicate, count(*) FILTER (bad) AS n_banned, count(*) FILTER (NOT bad) AS n_kept FROM k GROUP BY language"),
    "stream_limit": (stream_limit, f"WITH {CAND} SELECT doc_id, CAST(char_len AS INT) AS char_len, 'clean' AS source FROM cand WHERE pos < 300"),
    "stream_skip_budget": (stream_skip_budget, f"WITH {CAND} SELECT doc_id, CAST(char_len AS INT) AS char_len FROM {_skip('', 100, BUDGET)}"),
    "validation_no_overlap": (validation_no_overlap, f"""WITH {CAND} SELECT doc_id, CAST(char_len AS INT) AS char_len, source FROM (SELECT * FROM {_skip(" AND source = 'clean'", 100, BUDGET)} UNION ALL SELECT * FROM {_skip(" AND source = 'removed'", 100, BUDGET / 4)}) WHERE doc_id >= 105"""),
    "join_scores_text": (join_scores_text, f"WITH {CAND} SELECT doc_id, language, char_len, md5(text) AS text_md5, {', '.join(DIMENSIONS)} FROM scored"),
    "missing_text_report": (missing_text_report, f"WITH {CAND} SELECT language, count(*) AS n_missing FROM cand WHERE {BANNED} GROUP BY language"),
    "weight_checks": (weight_checks, f"WITH {WEIGHTS_SQL} SELECT weight_id, meaning, abs({' + '.join(f'w_{d}' for d in DIMENSIONS)} - 1) < 1e-9 AS is_simplex FROM weights"),
    "cross_weights": (cross_weights, f"WITH {CAND}, {WEIGHTS_SQL} SELECT weight_id, count(*) AS n, max({SCORE}) AS best, min({SCORE}) AS least FROM scored CROSS JOIN weights GROUP BY weight_id"),
    "select_for_weight": (select_for_weight, f"{_weighted('WHERE weight_id = ' + repr('W11'))} SELECT doc_id, language, source, weighted_score, estimated_tokens FROM t WHERE b < {BUDGET}"),
    "select_all_weights": (select_all_weights, f"{_weighted('')} SELECT weight_id, doc_id, language, weighted_score, estimated_tokens FROM t WHERE b < {BUDGET}"),
    "select_random": (select_random, f"WITH {CAND}, t AS (SELECT *, {EST} AS estimated_tokens, {before('language', 'md5(concat(' + repr('42') + ', doc_id)), pos')} AS b FROM cand) SELECT doc_id, language, source, estimated_tokens FROM t WHERE b < {BUDGET}"),
    "select_clean_heuristic": (select_clean_heuristic, f"{CLEAN}, t AS (SELECT *, {EST} AS estimated_tokens, {before('language', 'pos')} AS b FROM c) SELECT doc_id, language, source, estimated_tokens FROM t WHERE b < {BUDGET}"),
    "select_equal_average": (select_equal_average, f"{_weighted(W06)} SELECT doc_id, language, source, weighted_score, estimated_tokens FROM t WHERE b < {BUDGET}"),
    "selection_warnings": (selection_warnings, f"{_weighted(W06)}, r AS (SELECT language, count(*) AS n_docs, sum(estimated_tokens) AS est_tokens FROM t WHERE b < 200000 GROUP BY language) SELECT language, n_docs, est_tokens, CASE WHEN est_tokens < 100000 THEN 'under half' ELSE 'none' END AS warning FROM r"),
}
