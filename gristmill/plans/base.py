"""The test tables in the shape that the operators take, in Spark and in SQL.

``documents`` are candidates: position is the id, sources 0 to 15 are clean and 16 to 19 removed. The tables have no language scores and no
rater scores, so these come from plain formulas of ids and lengths; they stand for such columns and rate nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.constants import DIMENSIONS, WEIGHTS
from gristmill.session import load

#: (factor of the id, factor of the length) of each dimension's formula.
FORMULA = {"educational_value": (0, 1), "reasoning": (7, 0), "professionalism": (13, 1), "cleanliness": (0, 3), "cultural_nuance": (31, 0)}
BUDGET = 20_000.0


def _formula(dimension: str) -> Column:
    a, b = FORMULA[dimension]
    return ((F.col("doc_id") * a + F.col("char_len") * b) % 501).cast("double") / 100.0


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    clean = F.substring("source", 4, 10).cast("int") < 16
    rows = docs.select("doc_id", F.col("doc_id").alias("pos"), "text", F.length("text").cast("long").alias("char_len"), F.col("lang").alias("language"), F.when(clean, "clean").otherwise("removed").alias("source"))
    return rows.withColumn("language_score", F.lit(0.8) + (F.col("doc_id") % 21).cast("double") / 100.0)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).withColumns({d: _formula(d) for d in DIMENSIONS}).drop("text")


SCORES_SQL = ",\n".join(f"         CAST((doc_id * {a} + char_len * {b}) % 501 AS DOUBLE) / 100.0::DOUBLE AS {d}" for d, (a, b) in FORMULA.items())
CAND = f"""cand AS (
  SELECT doc_id, doc_id AS pos, text, CAST(length(text) AS BIGINT) AS char_len, lang AS language,
         CASE WHEN CAST(substr(source, 4) AS INT) < 16 THEN 'clean' ELSE 'removed' END AS source,
         0.8::DOUBLE + CAST(doc_id % 21 AS DOUBLE) / 100.0::DOUBLE AS language_score
  FROM documents),
scored AS (SELECT *,
{SCORES_SQL}
  FROM cand)"""

_COLUMNS = ", ".join(f"w_{d}" for d in DIMENSIONS)
WEIGHTS_SQL = f"weights(weight_pos, weight_id, {_COLUMNS}, meaning) AS (VALUES\n  " + ",\n  ".join(f"({k}, '{w[0]}', {', '.join(f'{x}::DOUBLE' for x in w[1:-1])}, '{w[-1]}')" for k, w in enumerate(WEIGHTS)) + ")"
EST = "char_len / 4.0::DOUBLE"


def before(partition: str, order: str, amount: str = EST) -> str:
    """SQL of the total before a row."""
    by = f"PARTITION BY {partition} " if partition else ""
    return f"coalesce(sum({amount}) OVER ({by}ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
