"""Quality classifier with hierarchical empirical Bayes: the evidence of a document's text, and posteriors of its host and path.

1. A logistic model of the text gives each document's evidence, the log of how much likelier the text is for a good document. It is fitted
   on at most ``max_labelled`` labelled rows (those of least id hash; a documented bound); good is ``quality`` 1 and ``toxic`` not 1.
   Its features are shares of character classes, repetition, and the presence of hashed words that tell the classes apart.
2. Expected good documents are summed over all rows by host and by (host, path). Hosts are shrunk toward the global mean and paths toward
   their host, by strengths that the method of moments takes from the spread between them: a sparse site says little, a rich one much.
3. A document's posterior joins its evidence with its path's posterior, from which its own share is taken out. Below ``threshold`` it goes.

Sums are of whole millionths, so they don't depend on their order. Null texts are empty texts; null hosts and paths are groups of their own;
null ids are scored but match no label; repeated rows all count; without labels of both classes the evidence is 0 and all rows are kept; an
empty table gives no rows. Texts are read whole, however long. Ties of the posterior with ``threshold`` are kept; of words that tell the
classes apart equally well those of the smaller bucket are taken. Columns of ``docs`` may have any names: the operator's own are chosen anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import PLAIN, U64, Text, Workspace, chunks, fresh, named, settle, word_hash

BUCKETS = 1 << 20
MILLION = 1_000_000

#: Byte classes: 0 other, 1 lower-case letters and non-ASCII, 2 upper-case letters, 3 digits, 4 white space, 5 sentence marks, 6 other symbols.
_CLASS = np.zeros(256, np.int8)
_CLASS[0x80:] = 1
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[0x20, *range(0x09, 0x0E)]] = 4
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 6
DENSE = 16


def features(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense features of each document, and its distinct word buckets as (document, bucket) pairs."""
    n = len(text)
    size = np.maximum(np.diff(text.offsets), 1).astype(np.float64)
    kinds = _CLASS[text.data]
    shares = []
    for k in range(1, 7):
        total = np.zeros(len(text.data) + 1, np.int64)
        np.cumsum(kinds == k, out=total[1:])
        shares.append(np.diff(total[text.offsets]) / size)
    plain = PLAIN[text.data]
    start, end, first = text.words(plain)
    doc = np.repeat(np.arange(n), np.diff(first))
    hashes = word_hash(plain, start, end)
    key = (doc.astype(U64) << U64(44)) | (hashes >> U64(20))
    key = np.unique(key)
    own = (key >> U64(44)).astype(np.int64)
    words = np.diff(first).astype(np.float64)
    distinct = np.bincount(own, minlength=n)
    upper = shares[1] / np.maximum(shares[0] + shares[1], 1e-9)
    columns = [*shares, *(np.sqrt(s) for s in shares[1:]), upper, distinct / np.maximum(words, 1), np.log1p(words), size / np.maximum(words, 1) / 10, (words == 0).astype(float)]
    return np.stack(columns, 1)[:, :DENSE], own, (key & U64(BUCKETS - 1)).astype(np.int64)


@dataclass
class Model:
    """A linear model of standardized dense features and of the presence of chosen buckets."""

    mean: np.ndarray
    scale: np.ndarray
    dense: np.ndarray
    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def evidence(self, text: Text) -> np.ndarray:
        dense, own, bucket = features(text)
        return self.of(dense, own, bucket, len(text))

    def of(self, dense: np.ndarray, own: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        out = ((dense - self.mean) / self.scale) @ self.dense + self.bias - self.prior
        if len(self.buckets):
            at = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
            hit = self.buckets[at] == bucket
            out += np.bincount(own[hit], weights=self.weights[at[hit]], minlength=n)
        return np.clip(out, -12, 12)


NEUTRAL = Model(np.zeros(DENSE), np.ones(DENSE), np.zeros(DENSE), np.zeros(0, np.int64), np.zeros(0), 0.0, 0.0)


def fit(dense: np.ndarray, own: np.ndarray, bucket: np.ndarray, good: np.ndarray, most: int = 256, ridge: float = 1.0) -> Model:
    """Logistic regression by Newton steps; words are those whose document shares differ most surely between the classes."""
    n, n_good = len(good), int(good.sum())
    if not 0 < n_good < n:
        return NEUTRAL
    in_good = np.bincount(bucket[good[own]], minlength=BUCKETS)
    in_bad = np.bincount(bucket[~good[own]], minlength=BUCKETS)
    share = (in_good + in_bad) / n
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_good + 1 / (n - n_good)))
    sure = np.abs(in_good / n_good - in_bad / (n - n_good)) / spread
    sure[in_good + in_bad < 4] = 0
    chosen = np.sort(np.argsort(-sure, kind="stable")[:most])
    chosen = chosen[sure[chosen] > 4]
    mean, scale = dense.mean(0), dense.std(0) + 1e-6
    x = np.zeros((n, DENSE + len(chosen) + 1), np.float32)
    x[:, :DENSE], x[:, -1] = (dense - mean) / scale, 1
    if len(chosen):
        at = np.minimum(np.searchsorted(chosen, bucket), len(chosen) - 1)
        hit = chosen[at] == bucket
        x[own[hit], DENSE + at[hit]] = 1
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        slope, curve = -penalty * w, np.diag(penalty)
        for a in range(0, n, 2048):  # in parts, as the driver has little memory
            part = x[a : a + 2048].astype(float)
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            slope += part.T @ (good[a : a + 2048] - p)
            curve += (part * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ part
        step = np.linalg.solve(curve, slope)
        size = np.abs(step).max()
        w = w + step * min(1.0, 5 / max(size, 1e-12))
        if size < 1e-6:
            break
    return Model(mean, scale, w[:DENSE], chosen, w[DENSE:-1], float(w[-1]), float(np.log(n_good / (n - n_good))))


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in chunks(batch.column(2)):
            dense, own, bucket = features(text)
            cuts = np.searchsorted(own, np.arange(len(text) + 1))
            rows = slice(text.first, text.first + len(text))
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0)[rows], "good": batch.column(1)[rows],
                    "dense": pa.array([d.tobytes() for d in dense], pa.binary()), "buckets": pa.array([bucket[a:b].astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                }
            )


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits the model on the ``max_labelled`` labelled documents whose ids hash least; what comes to the driver is bounded by that.

    A label counts where its quality is known or it is toxic, which alone makes a document bad. Where an id repeats, its least text is taken.
    """
    good = F.min(F.when((F.col("quality") == 1) & ~F.coalesce(F.col("toxic") == 1, F.lit(False)), 1).otherwise(0)).alias("good")
    known = labels.where("doc_id is not null and (quality is not null or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(good)
    some = known.orderBy(F.xxhash64("label_id"), "label_id").limit(max_labelled)
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(some), F.col("doc_id") == F.col("label_id")).groupBy("doc_id", "good").agg(F.min("text").alias("text"))  # one row of each id
    found = rows.mapInArrow(_sample, "doc_id long, good int, dense binary, buckets binary").collect()
    found.sort(key=lambda r: (r["doc_id"], bytes(r["dense"])))
    if not found:
        return NEUTRAL
    buckets = [np.frombuffer(r["buckets"], np.int32) for r in found]
    own = np.repeat(np.arange(len(found), dtype=np.int32), list(map(len, buckets)))
    dense, good_ = np.stack([np.frombuffer(r["dense"]) for r in found]), np.array([r["good"] == 1 for r in found])
    del found
    return fit(dense, own, np.concatenate(buckets), good_)


def _moments(groups: DataFrame, mean: Column, n: str, s: str, shift: int) -> float:
    """Strength of the prior of groups whose true share scatters about ``mean``: large if they differ no more than chance would have it."""
    n_, share = F.col(n).cast("double"), F.col(s) / F.col(n)
    row = groups.agg(
        F.sum(n_).alias("n"), F.sum(n_ * F.pow(share - mean, F.lit(2.0))).alias("spread"), F.sum(n_ * mean * (1 - mean)).alias("within"), F.sum(mean * (1 - mean)).alias("chance"), F.sum(n_ * n_).alias("nn"), F.count("*").alias("g")
    ).first()
    if not row["n"] or row["g"] <= shift:
        return 1e4
    between = (row["spread"] - row["chance"]) / max(row["n"] - row["nn"] / row["n"], 1.0)
    within = row["within"] / row["n"]
    return float(np.clip(round(within / max(between, 1e-9) - 1, 6), 1.0, 1e4))


def score(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", max_labelled: int = 20_000, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False, ws: Workspace | None = None) -> DataFrame:
    """(doc_id, evidence, host_posterior, path_posterior, posterior, keep) of each row; with ``keep_columns`` the columns of ``docs`` and ``keep``.

    Texts are scored in one pass that shuffles nothing and are written once (narrow, unless columns are kept); sums by group are
    pre-aggregated, and the group table joins the written rows by a join that Spark may broadcast by its size or split by its skew.
    """
    ws = ws or Workspace(docs.sparkSession, "quality")
    model = train(docs, labels, max_labelled, id_col, text_col)

    host, path, ev, p, body = (fresh(docs, f"quality_{x}") for x in ("host", "path", "evidence", "p", "text"))
    kept = [named(c) for c in docs.columns] if keep_columns else [named(id_col).cast("long").alias("doc_id")]
    extra = [named(host_col).cast("string").alias(host), named(path_col).cast("string").alias(path)]
    where = [c.lower() for c in docs.columns].index(text_col.lower())
    plain = keep_columns and dict(docs.dtypes)[docs.columns[where]] == "string"  # the column itself is scored, not a copy
    rows = docs.select(*kept, *extra, *([] if plain else [F.coalesce(named(text_col).cast("string"), F.lit("")).alias(body)]))
    at = where if plain else len(rows.columns) - 1
    schema = T.StructType([*rows.schema.fields[: len(rows.columns) - (not plain)], T.StructField(ev, T.DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in chunks(batch.column(at)):
                own = batch.slice(text.first, len(text))
                columns = [own.column(k) for k in range(len(schema.fields) - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(model.evidence(text))], names=schema.names)
        settle()

    rows = rows.mapInArrow(judge, schema)
    rows = rows.withColumn(p, F.round((1 / (1 + F.exp(-(F.col(ev) + F.lit(model.prior))))) * MILLION).cast("long"))
    rows = ws.write(rows, "rows")
    paths = ws.write(rows.groupBy(F.col(host).alias("g_host"), F.col(path).alias("g_path")).agg(F.count("*").alias("path_n"), F.sum(p).alias("path_s")), "paths", narrow=True)
    hosts = ws.write(paths.groupBy("g_host").agg(F.sum("path_n").alias("host_n"), F.sum("path_s").alias("host_s")), "hosts", narrow=True)
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s")).first()
    mean = min(max((total["s"] or 0) / MILLION / max(total["n"] or 0, 1), 1e-4), 1 - 1e-4)
    in_ones = lambda c: F.col(c) / F.lit(float(MILLION))
    host_strength = _moments(hosts.withColumn("ones", in_ones("host_s")), F.lit(mean), "host_n", "ones", 1)
    shrunk = lambda s, n, strength, toward: (F.lit(strength) * toward + s) / (F.lit(strength) + n)
    both = paths.join(hosts.withColumnRenamed("g_host", "h"), F.col("g_host").eqNullSafe(F.col("h"))).drop("h")
    host_mean = shrunk(in_ones("host_s"), F.col("host_n"), host_strength, F.lit(mean))
    path_strength = _moments(both.withColumn("ones", in_ones("path_s")), host_mean, "path_n", "ones", 1)
    both = ws.write(both.withColumn("host_posterior", host_mean).withColumn("path_posterior", shrunk(in_ones("path_s"), F.col("path_n"), path_strength, host_mean)), "groups", narrow=True)
    g = {c: fresh(rows, f"quality_{c}") for c in both.columns}
    both = both.select(*(F.col(c).alias(v) for c, v in g.items()))
    joined = rows.join(both, F.col(host).eqNullSafe(F.col(g["g_host"])) & F.col(path).eqNullSafe(F.col(g["g_path"])))
    own = in_ones(p)
    others_host = shrunk(in_ones(g["host_s"]) - own, F.col(g["host_n"]) - 1, host_strength, F.lit(mean))
    others = shrunk(in_ones(g["path_s"]) - own, F.col(g["path_n"]) - 1, path_strength, others_host)
    others = F.least(F.greatest(others, F.lit(1e-6)), F.lit(1 - 1e-6))
    posterior = F.round(1 / (1 + F.exp(-(F.col(ev) + F.log(others / (1 - others))))), 6)
    keep = posterior >= threshold if model is not NEUTRAL else F.lit(True)
    if keep_columns:
        return joined.select(*(named(c) for c in docs.columns), keep.alias(fresh(docs, "keep")))
    return joined.select("doc_id", F.round(ev, 6).alias("evidence"), F.round(g["host_posterior"], 6).alias("host_posterior"), F.round(g["path_posterior"], 6).alias("path_posterior"), posterior.alias("posterior"), keep.alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns."""
    out = score(docs, labels, keep_columns=True, **options)
    return out.where(F.col(out.columns[-1])).drop(out.columns[-1])
