"""Choice of a weight vector from proxy losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.constants import DIMENSIONS

TIE_TOLERANCE = 0.01


def with_totals(losses: DataFrame) -> DataFrame:
    """Long losses (weight_id, language, loss) to the mean and the largest of each vector."""
    return losses.groupBy("weight_id").agg(F.avg("loss").alias("macro_loss"), F.max("loss").alias("worst_language_loss"))


def wide(losses: DataFrame, languages: list[str]) -> DataFrame:
    """One row for each vector, a column ``loss_<language>`` for each language, and the totals."""
    pivoted = losses.groupBy("weight_id").pivot("language", languages).agg(F.first("loss"))
    return pivoted.select("weight_id", *(F.col(c).alias(f"loss_{c}") for c in languages)).join(with_totals(losses), "weight_id")


def long(results: DataFrame, languages: list[str]) -> DataFrame:
    return results.unpivot(["weight_id"], [f"loss_{c}" for c in languages], "language", "loss").withColumn("language", F.regexp_replace("language", "^loss_", ""))


def latest(rows: DataFrame, order: str = "pos") -> DataFrame:
    """An append-only result file as one row for each vector, the last."""
    rest = [c for c in rows.columns if c != "weight_id"]
    return rows.groupBy("weight_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("weight_id", "r.*")


def ranking(results: DataFrame, weights: DataFrame, tolerance: float = TIE_TOLERANCE, order: str = "weight_pos") -> DataFrame:
    """Rank by macro loss with meaning, tie group (within the tolerance of the least) and the selected row: of the ties that of least worst loss.

    There is a row for each vector, so one task may order them.
    """
    meanings = weights.select("weight_id", "meaning", F.col("weight_pos"))
    rows = results.join(F.broadcast(meanings), "weight_id", "left").withColumn("meaning", F.coalesce("meaning", F.lit("?")))
    everything = Window.partitionBy(F.lit(1))
    rows = rows.withColumn("tie", F.col("macro_loss") <= F.min("macro_loss").over(everything) * (1 + tolerance))
    best = F.min(F.when(F.col("tie"), F.struct("worst_language_loss", order, "weight_id"))).over(everything)
    rows = rows.withColumn("selected", F.col("weight_id") == best["weight_id"]).withColumn("rank", F.row_number().over(everything.orderBy("macro_loss", order)))
    return rows.select("rank", "weight_id", "meaning", "macro_loss", "worst_language_loss", "tie", "selected")


def best_weight(results: DataFrame, weights: DataFrame, tolerance: float = TIE_TOLERANCE) -> DataFrame:
    chosen = ranking(results, weights, tolerance).where("selected")
    vectors = weights.select("weight_id", F.struct(*(F.col(f"w_{d}").alias(d) for d in DIMENSIONS)).alias("weights"))
    return chosen.join(F.broadcast(vectors), "weight_id", "left").select("weight_id", "meaning", "weights", "macro_loss", "worst_language_loss")


def ranking_markdown(ranked: DataFrame, recorded: str | None = None, tolerance: float = TIE_TOLERANCE) -> str:
    """A report of the ranking; its rows are as few as vectors."""
    rows = ranked.orderBy("rank").collect()
    best = next(r for r in rows if r["selected"])
    ties = sum(r["tie"] for r in rows)
    head = f"**Selected** `{best['weight_id']}` ({best['meaning']}): macro loss {best['macro_loss']:.4f}, worst language {best['worst_language_loss']:.4f}"
    head += f"; of {ties} within {tolerance:.0%} of the least macro loss it has the least worst loss." if ties > 1 else "."
    out = [f"# Ranking of {len(rows)} weight vectors", "", head, ""]
    if recorded and recorded != best["weight_id"]:
        out += [f"**Note:** `{recorded}` is recorded as the best, which these results no longer give.", ""]
    out += ["| rank | weights | meaning | macro loss | worst language loss | tie | selected |", "|---:|---|---|---:|---:|:---:|:---:|"]
    out += [f"| {r['rank']} | {r['weight_id']} | {r['meaning']} | {r['macro_loss']:.4f} | {r['worst_language_loss']:.4f} | {'Y' if r['tie'] else ''} | {'**Y**' if r['selected'] else ''} |" for r in rows]
    return "\n".join(out) + "\n"
