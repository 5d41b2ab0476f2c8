"""The proxy chain on the test tables: what each weight vector selects trains a small language model, and held-out losses rank the vectors.

A tenth of the documents (the last digit of the id is 9) is held out, a tenth (8) is what every model has read before, the rest are candidates.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.constants import BASELINES, DIMENSIONS
from gristmill.operators import corpus as C
from gristmill.operators import evaluate as E
from gristmill.operators import ngram as N
from gristmill.operators import proxy as P
from gristmill.operators import selection as S
from gristmill.plans.base import CAND, EST, FORMULA, WEIGHTS_SQL, before, candidates, scored
from gristmill.plans.corpus_queries import FEATURES, SCORE
from gristmill.storage import Workspace

LANGS = ["en", "de", "es", "fr"]
#: Estimated tokens of each language that a model reads after the base text.
PROXY_BUDGET = 5_000.0
#: The vector of the best-weighted baseline where the chain isn't run for it.
RECORDED = "W11"


def _parts(spark, sf):
    """(base, candidates, held out), with texts."""
    rows, last = candidates(spark, sf), F.col("doc_id") % 10
    return rows.where(last == 8), rows.where(last < 8), rows.where(last == 9)


def _pool(spark, sf):
    return scored(spark, sf).where(F.col("doc_id") % 10 < 8)


def losses(spark, sf):
    """(weight_id, language, loss) of a model for each vector."""
    weights = S.weights_table(spark)
    selected = S.select_all_weights(_pool(spark, sf), weights, PROXY_BUDGET).select("weight_id", "doc_id")
    names = [r["weight_id"] for r in weights.select("weight_id").collect()]
    base, pool, held = _parts(spark, sf)
    return N.continued_losses(base, pool, selected, held, names, name_col="weight_id", texts=candidates(spark, sf)).select(F.col("model").alias("weight_id"), "language", "loss")


def _model(reads: str, tag: str = "") -> str:
    """SQL: a model for each ``model`` of the CTE ``reads`` (model, doc_id), and its losses as ``losses<tag>`` (model, language, loss)."""
    return f"""
c{tag} AS (SELECT model, v, w, count(*) AS c FROM {reads} JOIN pr ON {reads}.doc_id = pr.doc_id GROUP BY ALL),
t{tag} AS (SELECT model, v, sum(c) AS t, count(*) AS u FROM c{tag} GROUP BY ALL),
k{tag} AS (SELECT model, w, count(*) AS a FROM c{tag} GROUP BY ALL),
d{tag} AS (SELECT model, count(*) AS kinds, count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2 FROM c{tag} GROUP BY model),
e{tag} AS (SELECT model, count(*) AS seen, count(*) FILTER (a = 1) AS n1, count(*) FILTER (a = 2) AS n2 FROM k{tag} GROUP BY model),
m{tag} AS (SELECT d{tag}.model, kinds, seen, CASE WHEN d{tag}.n1 > 0 THEN d{tag}.n1 / (d{tag}.n1 + 2 * d{tag}.n2)::DOUBLE ELSE 0.5 END AS d1, CASE WHEN e{tag}.n1 > 0 THEN e{tag}.n1 / (e{tag}.n1 + 2 * e{tag}.n2)::DOUBLE ELSE 0.5 END AS d2 FROM d{tag} JOIN e{tag} ON d{tag}.model = e{tag}.model),
j{tag} AS (SELECT m.model, h.language, h.n, coalesce(c, 0) AS c, coalesce(t, 0) AS t, coalesce(u, 0) AS u, d1,
    greatest(coalesce(a, 0) - d2, 0) / kinds + d2 * seen / kinds / (SELECT n FROM voc) AS low
  FROM m{tag} m CROSS JOIN h LEFT JOIN c{tag} c ON m.model = c.model AND h.v = c.v AND h.w = c.w LEFT JOIN t{tag} t ON m.model = t.model AND h.v = t.v LEFT JOIN k{tag} k ON m.model = k.model AND h.w = k.w),
losses{tag} AS (SELECT model, language, round(sum(-n * ln(CASE WHEN t > 0 THEN greatest(c - d1, 0) / t + d1 * u / t * low ELSE low END)) / sum(n), 6) AS loss FROM j{tag} GROUP BY ALL)"""


PAIRS = r"""
tok AS (SELECT doc_id, language, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS ws FROM cand),
pr AS (SELECT doc_id, language, unnest(ws) AS w, unnest(list_concat([''], ws[1:len(ws) - 1])) AS v FROM tok WHERE len(ws) > 0),
voc AS (SELECT count(DISTINCT w) AS n FROM pr),
h AS (SELECT language, v, w, count(*) AS n FROM pr WHERE doc_id % 10 = 9 GROUP BY ALL)"""


def _taken(where: str, order: str, extra: str = "") -> str:
    """SQL: candidates of a weight vector, or in another order, until the budget is met in each language."""
    return f"SELECT * FROM (SELECT *, {before('weight_id, language', order)} AS b FROM (SELECT weight_id, doc_id, language, pos, char_len{extra} FROM scored CROSS JOIN weights WHERE doc_id % 10 < 8{where})) WHERE b < {PROXY_BUDGET}"


LOSSES = f"""{CAND}, {WEIGHTS_SQL}, {PAIRS},
reads AS (SELECT weight_id AS model, doc_id FROM ({_taken('', 'weighted_score DESC, pos', f', {SCORE} AS weighted_score')}) UNION ALL SELECT weight_id, doc_id FROM weights CROSS JOIN cand WHERE doc_id % 10 = 8),
{_model('reads')},
totals AS (SELECT w.weight_id, w.weight_pos, w.meaning, round(avg(loss), 9) AS macro_loss, round(max(loss), 9) AS worst_language_loss FROM losses JOIN weights w ON losses.model = w.weight_id GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY macro_loss, weight_pos) AS INT) AS rank, macro_loss <= min(macro_loss) OVER () * 1.01::DOUBLE AS tie FROM totals),
best AS (SELECT weight_id FROM ranked WHERE tie ORDER BY worst_language_loss, weight_pos LIMIT 1)"""


def _totals(spark, sf):
    return P.with_totals(losses(spark, sf)).withColumns({c: F.round(c, 9) for c in ("macro_loss", "worst_language_loss")})


def proxy_pivot(spark, sf):
    out = P.wide(losses(spark, sf), LANGS)
    return out.select("weight_id", *(F.round(c, 9).alias(c) for c in out.columns if c != "weight_id"))


def proxy_unpivot(spark, sf):
    return P.long(P.wide(losses(spark, sf), LANGS), LANGS).withColumn("loss", F.round("loss", 9))


def proxy_ranking(spark, sf):
    return P.ranking(_totals(spark, sf), S.weights_table(spark))


def best_weight(spark, sf):
    return P.best_weight(_totals(spark, sf), S.weights_table(spark)).select("weight_id", "meaning", "weights.*", "macro_loss", "worst_language_loss")


def loss_rows(spark, sf, best: str = RECORDED):
    """(model, bucket, loss) of the base model and of those that went on with each baseline's selection."""
    pool = _pool(spark, sf)
    vector = S.weights_table(spark, [best]).first()
    best_weights = {d: vector[f"w_{d}"] for d in DIMENSIONS}
    base, texts, held = _parts(spark, sf)
    rows = {b: C.with_features(texts) if b == "clean_heuristic" else pool for b in BASELINES}
    ws = Workspace(spark, "baselines")
    selected = None
    for b, own in rows.items():
        one = S.select_baseline(b, own, PROXY_BUDGET, best_weights).select(F.lit(b).alias("model"), "doc_id")
        selected = one if selected is None else selected.unionByName(one)
    found = N.continued_losses(base, texts, ws.write(selected, "selected"), held, list(BASELINES), with_base="base", texts=candidates(spark, sf))
    return found.select("model", F.col("language").alias("bucket"), "loss")


def _baseline_reads(best: str) -> str:
    of = lambda where, order, extra="": _taken(f" AND weight_id = {where}", order, extra)
    score = f", {SCORE} AS weighted_score"
    clean = " AND doc_id IN (SELECT doc_id FROM feats WHERE repetition_score <= 0.1::DOUBLE AND target_script_ratio >= 0.9::DOUBLE) AND language_score >= 0.9::DOUBLE"
    parts = {
        "random": of("'W06'", "md5(concat('42', doc_id)), pos"), "clean_heuristic": of(f"'W06'{clean}", "pos"),
        "equal_average": of("'W06'", "weighted_score DESC, pos", score), "best_weighted": of(best, "weighted_score DESC, pos", score),
    }
    base = "SELECT model, doc_id FROM (SELECT unnest(['base', " + ", ".join(f"'{b}'" for b in BASELINES) + "]) AS model) CROSS JOIN cand WHERE doc_id % 10 = 8"
    return "reads2 AS (" + " UNION ALL ".join([base, *(f"SELECT '{b}' AS model, doc_id FROM ({sql})" for b, sql in parts.items())]) + ")"


def baseline_losses_sql(best: str) -> str:
    """CTEs up to ``losses2`` (model, language, loss); they follow ``cand``, ``scored``, ``weights`` and the word pairs."""
    return f"feats AS ({FEATURES}), {_baseline_reads(best)},{_model('reads2', '2')}"


#: CTEs of the baselines' losses, with the recorded vector for the best one.
BASELINE_LOSSES = f"{CAND}, {WEIGHTS_SQL}, {PAIRS}, {baseline_losses_sql(repr(RECORDED))}"


def perplexity_rollup(spark, sf):
    """Perplexities of all models, the best-weighted one with the vector that the proxy losses select."""
    best = best_weight(spark, sf).first()["weight_id"]
    out = E.rollup(E.perplexities(loss_rows(spark, sf, best)))
    return out.withColumns({c: F.round(c, 9) for c in ("macro", "worst")})


QUERIES = {
    "proxy_pivot": (proxy_pivot, f"WITH {LOSSES} SELECT model AS weight_id, {', '.join(f'round(max(CASE WHEN language = {c!r} THEN loss END), 9) AS loss_{c}' for c in LANGS)}, round(avg(loss), 9) AS macro_loss, round(max(loss), 9) AS worst_language_loss FROM losses GROUP BY model"),
    "proxy_unpivot": (proxy_unpivot, f"WITH {LOSSES} SELECT model AS weight_id, language, round(loss, 9) AS loss FROM losses"),
    "proxy_ranking": (proxy_ranking, f"WITH {LOSSES} SELECT rank, weight_id, meaning, macro_loss, worst_language_loss, tie, weight_id = (SELECT weight_id FROM best) AS selected FROM ranked"),
    "best_weight": (best_weight, f"WITH {LOSSES} SELECT weight_id, ranked.meaning, {', '.join(f'w_{d} AS {d}' for d in DIMENSIONS)}, macro_loss, worst_language_loss FROM ranked JOIN best USING (weight_id) JOIN weights USING (weight_id)"),
    "perplexity_rollup": (perplexity_rollup, f"WITH {LOSSES}, {baseline_losses_sql('(SELECT weight_id FROM best)')} SELECT model, 'held_out' AS task, 'perplexity' AS metric, round(avg(exp(loss)), 9) AS macro, round(max(exp(loss)), 9) AS worst, count(*) AS n_buckets FROM losses2 GROUP BY model"),
}
