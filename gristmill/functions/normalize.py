"""Text repair that Spark has no expression for: canonical composition, and a legacy Burmese encoding by a plug-in."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; nulls stay null."""
    return text.map(lambda t: t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))


def repair(df: DataFrame, text_col: str, probability: Callable[[str], float], convert: Callable[[str], str], threshold: float = 0.5) -> DataFrame:
    """Converts texts that the detector holds to be in the legacy encoding (probability at the threshold or above), then composes all.

    Adds ``converted``. Detector and converter are functions of a text, such as ``legacy.fit_detector`` gives and ``legacy.to_unicode``.
    """

    @F.pandas_udf("text string, converted boolean")
    def fix(texts: pd.Series) -> pd.DataFrame:
        flags = texts.map(lambda t: t is not None and probability(t) >= threshold)
        out = [convert(t) if f else t for t, f in zip(texts, flags, strict=True)]
        return pd.DataFrame({"text": [t if t is None else unicodedata.normalize("NFC", t) for t in out], "converted": flags.astype(bool)})

    return df.withColumn("__fixed", fix(F.col(text_col))).withColumns({text_col: F.col("__fixed.text"), "converted": F.col("__fixed.converted")}).drop("__fixed")


def converted_share(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if("converted").alias("n_converted"), F.coalesce(F.avg(F.col("converted").cast("double")), F.lit(0.0)).alias("share"))
