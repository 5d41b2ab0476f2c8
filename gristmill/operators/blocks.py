"""Sequence blocks: documents' tokens one after the other, an end id after each, cut into blocks of a fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.storage import Workspace


def character_tokens(text: Column) -> Column:
    """A stand-in tokenizer: code points."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("int"))


def word_tokens(text: Column) -> Column:
    """A stand-in tokenizer: a small hash of each word."""
    return F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.length(w).cast("int"))


def library_tokens(path: str):
    """A tokenizer file of the tokenizers library as a function of a text column; special tokens are not added."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for texts in batches:
            listed = texts.fillna("").tolist()
            yield pd.Series([x.ids for k in range(0, len(listed), 256) for x in tokenizer.encode_batch(listed[k : k + 256], add_special_tokens=False)], dtype=object)

    return run


def _before(rows: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """The total of ``amount`` before each row of the last key, by sums over the keys from coarse to fine: a window holds the steps of one coarser step."""
    if len(keys) == 1:
        window = Window.partitionBy(F.lit(1)).orderBy(keys[0]).rowsBetween(Window.unboundedPreceding, -1)  # a row for each of the coarsest steps
        sums = rows.groupBy(*keys).agg(F.sum(amount).alias("__s"))
        return sums.select(*keys, F.coalesce(F.sum("__s").over(window), F.lit(0)).alias("before"))
    above = _before(rows, keys[:-1], amount)
    window = Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys).agg(F.sum(amount).alias("__s")).withColumn("__own", F.coalesce(F.sum("__s").over(window), F.lit(0)))
    return sums.join(above, keys[:-1]).select(*keys, (F.col("before") + F.col("__own")).alias("before"))


def pack_blocks(docs: DataFrame, tokens: Column, size: int, end_id: int, order: str = "pos", span: int = 1024) -> DataFrame:
    """(block_id, tokens) of all full blocks; the rest at the end is left out.

    Texts are encoded once, and their ids written. A token's place is the sum of the lengths before its document: summed by spans of spans
    of positions, by spans, and within a span, so no task orders all documents or all spans. Documents are then cut at block borders, so
    what is shuffled is a few pieces for each, not a row for each token.
    """
    if size < 1:
        raise ValueError("size must be positive")
    rows = docs.select(F.col(order).cast("long").alias("pos"), F.concat(F.coalesce(tokens, F.array().cast("array<int>")), F.array(F.lit(end_id))).alias("ids"))
    ws = Workspace(docs.sparkSession, "blocks")
    rows = ws.write(rows.withColumn("n", F.size("ids").cast("long")).withColumn("span", F.floor(F.col("pos") / span)).withColumn("wide", F.floor(F.col("pos") / (span * span))), "rows")
    starts = ws.write(_before(rows.select("wide", "span", "n"), ["wide", "span"], "n").drop("wide"), "starts")
    inside = Window.partitionBy("span").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(starts, "span").withColumn("at", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    first, last = F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size)
    pieces = placed.select("at", "n", "ids", F.explode(F.sequence(first, last)).alias("block_id"))
    begin = F.greatest(F.col("at"), F.col("block_id") * size)
    end = F.least(F.col("at") + F.col("n"), (F.col("block_id") + 1) * size)
    pieces = pieces.select("block_id", begin.alias("begin"), F.slice("ids", (begin - F.col("at") + 1).cast("int"), (end - begin).cast("int")).alias("part"))
    whole = pieces.groupBy("block_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("begin", "part"))), lambda x: x["part"])).alias("tokens"))  # `size` tokens at most
    return whole.where(F.size("tokens") == size)


class PackedOnce:
    """Packed validation blocks that many runs share: made and written at the first call for a key, read again at later ones."""

    def __init__(self, spark: SparkSession):
        self.ws, self.made = Workspace(spark, "packed"), {}

    def blocks(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        if key not in self.made:
            self.made[key] = self.ws.write(make(), f"blocks{len(self.made)}")
        return self.made[key]


def require_blocks(blocks: DataFrame) -> DataFrame:
    """``blocks``, or an error if there is none."""
    if blocks.isEmpty():
        raise ValueError("not enough tokens for one block")
    return blocks
