"""Quality heads over embeddings: batch inference, and training whose gradients are summed on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.constants import DIMENSIONS
from gristmill.operators.metrics import spearman
from gristmill.storage import Workspace

#: A head: hidden weights (hidden, width), hidden bias, output weights (hidden), output bias.
Head = tuple[np.ndarray, np.ndarray, np.ndarray, float]


def initial_heads(width: int, hidden: int = 256, dimensions: tuple[str, ...] = DIMENSIONS, seed: int = 0) -> dict[str, Head]:
    rng = np.random.default_rng(seed)
    bound = lambda n: 1 / np.sqrt(n)
    make = lambda: (rng.uniform(-bound(width), bound(width), (hidden, width)), rng.uniform(-bound(width), bound(width), hidden), rng.uniform(-bound(hidden), bound(hidden), hidden), 0.0)
    return {d: make() for d in dimensions}


def simple_heads(width: int, dimensions: tuple[str, ...] = DIMENSIONS) -> dict[str, Head]:
    """Heads of one hidden unit with weights that a formula gives, for checks against SQL."""
    return {d: (np.array([[((i * 7 + k * 3) % 11 - 5) / 8 for i in range(width)]]), np.array([k / 4]), np.array([1.5 + k]), -k / 8) for k, d in enumerate(dimensions)}


def apply_head(x: np.ndarray, head: Head) -> np.ndarray:
    w1, b1, w2, b2 = head
    return np.maximum(x @ w1.T + b1, 0) @ w2 + b2


def infer(df: DataFrame, heads: Mapping[str, Head], embedding_col: str = "embedding") -> DataFrame:
    """A score for each head; the heads go to the executors once, and batches are scored with matrix products."""
    sent = df.sparkSession.sparkContext.broadcast(dict(heads))

    @F.pandas_udf(", ".join(f"`{d}` double" for d in heads))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch.to_numpy()).astype(float) if len(batch) else np.zeros((0, 1))
            yield pd.DataFrame({d: apply_head(x, h) if len(x) else np.zeros(0) for d, h in sent.value.items()})

    return df.withColumn("__scores", score(F.col(embedding_col))).select(*df.columns, "__scores.*")


def embed(df: DataFrame, text_col: str, encoder: Callable[[list[str]], np.ndarray], out_col: str = "embedding") -> DataFrame:
    """Embeddings of texts by a plug-in that takes a list of texts; each gets the prefix that passages have, and unit length."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = np.asarray(encoder(["passage: " + (t or "") for t in texts]), float)
            norms = np.linalg.norm(values, axis=1, keepdims=True)
            yield pd.Series(list((values / np.where(norms > 0, norms, 1)).astype(np.float32)))

    return df.withColumn(out_col, run(F.col(text_col)))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors that the mask keeps; a mask of zeros gives zeros."""
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] > 0)
    zero = F.transform(F.element_at(vectors, 1), lambda _: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda a, x: F.zip_with(a, x["v"], lambda p, q: p + q.cast("double")))
    return F.transform(total, lambda t: t / F.greatest(F.size(kept), F.lit(1)))


def save_heads(spark: SparkSession, heads: Mapping[str, Head], path: str) -> None:
    rows = [(d, w1.tolist(), b1.tolist(), w2.tolist(), float(b2)) for d, (w1, b1, w2, b2) in heads.items()]
    spark.createDataFrame(rows, "dimension string, w1 array<array<double>>, b1 array<double>, w2 array<double>, b2 double").coalesce(1).write.mode("overwrite").parquet(path)


def load_heads(spark: SparkSession, path: str) -> dict[str, Head]:
    rows = spark.read.parquet(path).collect()  # one for each dimension
    return {r["dimension"]: (np.array(r["w1"]), np.array(r["b1"]), np.array(r["w2"]), r["b2"]) for r in rows}


def save_report(spark: SparkSession, path: str, **values: float) -> None:
    """What training gave (epochs, best correlation, ...), as one JSON row beside the heads."""
    names = sorted(values)
    spark.createDataFrame([tuple(float(values[n]) for n in names)], ", ".join(f"`{n}` double" for n in names)).coalesce(1).write.mode("overwrite").json(path)


def _huber_slope(d: np.ndarray, delta: float) -> np.ndarray:
    return np.clip(d, -delta, delta)


def _gradients(x: np.ndarray, y: Sequence[np.ndarray], heads: Sequence[Sequence[np.ndarray]], delta: float) -> list[list[np.ndarray]]:
    """Of each head's parameters, the sum over rows of the Huber loss's slopes; a row without a target (NaN) adds nothing to that head."""
    out = []
    for (w1, b1, w2, b2), target in zip(heads, y, strict=True):
        inner = x @ w1.T + b1
        act = np.maximum(inner, 0)
        slope = _huber_slope(np.nan_to_num(act @ w2 + b2 - target), delta)
        back = np.outer(slope, w2) * (inner > 0)
        out.append([back.T @ x, back.sum(0), act.T @ slope, np.array(slope.sum())])
    return out


class _AdamW:
    """The optimizer's state between steps: two moments of each parameter."""

    def __init__(self, heads: Sequence[Sequence[np.ndarray]], rate: float, decay: float):
        self.rate, self.decay, self.step = rate, decay, 0
        self.moments = [[(np.zeros_like(p), np.zeros_like(p)) for p in h] for h in heads]

    def update(self, heads: Sequence[Sequence[np.ndarray]], gradients: Sequence[Sequence[np.ndarray]]) -> None:
        self.step += 1
        for head, own, moments in zip(heads, gradients, self.moments, strict=True):
            for p, g, (m, v) in zip(head, own, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= self.rate * (m / (1 - 0.9**self.step) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8) + self.decay * p)


def _kept(heads: Sequence[Sequence[np.ndarray]], names: Iterable[str]) -> dict[str, Head]:
    return {d: (w1.copy(), b1.copy(), w2.copy(), float(b2)) for d, (w1, b1, w2, b2) in zip(names, heads, strict=True)}


def _summed(heads: list[list[np.ndarray]], delta: float):
    """An Arrow kernel: rows (embedding, targets...) to one (position, sum of slopes) for each parameter and task, and the sum of rows at position -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(0)
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            y = [batch.column(k + 1).to_numpy(zero_copy_only=False).astype(float) for k in range(len(heads))]
            flat = np.concatenate([g.reshape(-1) for own in _gradients(x, y, heads, delta) for g in own])
            total, n = flat if total is None else total + flat, n + batch.num_rows
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(-1, len(total)), pa.int64()), pa.array(np.append(float(n), total))], names=["pos", "g"])

    return run


def train(rows: DataFrame, held: DataFrame, targets: Sequence[str] = DIMENSIONS, hidden: int = 32, epochs: int = 50, batches: int = 1, rate: float = 1e-2, decay: float = 1e-2, delta: float = 1.0, patience: int = 5, every: int = 5, seed: int = 0, embedding_col: str = "embedding") -> tuple[dict[str, Head], float]:
    """Heads by AdamW on the mean of the dimensions' Huber losses, and the best held-out rank correlation (mean of the heads); the heads of that epoch are kept.

    Data parallel: each step's rows (a table written once, in ``batches`` parts by a hash) give one gradient for each task, which Spark adds up by
    parameter, first in each task and then by shuffle; the driver gets one number for each parameter and step, and holds the heads and the
    optimizer's two moments, nothing of the data. Every ``every`` epochs the held-out rows are scored and ranked in Spark as well; training ends after
    ``patience`` of these without a better correlation. Rows with a null embedding are left out, a null target counts for no gradient of its head.
    """
    spark = rows.sparkSession
    ws = Workspace(spark, "train")
    columns = [F.col(t).cast("double").alias(f"t{k}") for k, t in enumerate(targets)]
    vector = F.transform(F.col(embedding_col), lambda x: x.cast("double")).alias("x")
    pick = F.pmod(F.xxhash64(vector, *columns, F.lit(seed)), F.lit(batches)).cast("int").alias("batch")
    table = ws.write(rows.where(F.col(embedding_col).isNotNull()).select(vector, *columns, pick).sortWithinPartitions("batch"), "rows").persist()
    out = ws.write(held.where(F.col(embedding_col).isNotNull()).select(vector, *columns), "held").persist()
    first = table.first()
    if first is None:
        raise ValueError("no rows to train on")
    names = list(targets)
    heads = [[np.array(p, float) for p in h] for h in initial_heads(len(first["x"]), hidden, tuple(names), seed).values()]
    sizes = [p.size for h in heads for p in h]
    optimizer = _AdamW(heads, rate, decay)
    best, best_heads, waited = -np.inf, _kept(heads, names), 0
    for epoch in range(1, epochs + 1):
        for k in range(batches):
            some = table.where(F.col("batch") == k).select("x", *(f"t{i}" for i in range(len(names))))
            sums = some.mapInArrow(_summed(heads, delta), "pos long, g double").groupBy("pos").agg(F.sum("g").alias("g")).toPandas().sort_values("pos")["g"].to_numpy()
            if not len(sums):
                continue
            parts = iter(np.split(sums[1:] / sums[0] / len(heads), np.cumsum(sizes)[:-1]))
            optimizer.update(heads, [[next(parts).reshape(p.shape) for p in h] for h in heads])
        if epoch % every and epoch != epochs:
            continue
        scored = infer(out, _kept(heads, names), "x")
        cells = long_pairs(scored, names)
        now = spearman(cells, ["dimension"], "target", "predicted").agg(F.avg("spearman")).first()[0] or 0.0
        if now > best:
            best, waited, best_heads = now, 0, _kept(heads, names)
        else:
            waited += 1
            if waited >= patience:
                break
    table.unpersist()
    out.unpersist()
    ws.drop("rows", "held")
    return best_heads, float(best)


def long_pairs(scored: DataFrame, names: Sequence[str]) -> DataFrame:
    """(dimension, target, predicted) of rows with t0, t1, ... and a score for each name."""
    each = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(f"t{k}").alias("target"), F.col(f"`{d}`").alias("predicted")) for k, d in enumerate(names)))
    return scored.select(F.explode(each).alias("p")).select("p.*")
