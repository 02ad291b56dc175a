"""The normalizer and counts as functions of Spark SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vaktavya.functions.plain import edits, plain_normalize


def register_functions(spark: SparkSession, prefix: str = "speech_") -> None:
    """Register ``<prefix>normal_form(text)`` and ``<prefix>word_edits(reference, hypothesis)`` for SQL.

    They run in Python, one Arrow batch at a time; the DataFrame operators are faster on large tables.
    """
    @F.pandas_udf("string")
    def normal_form(text: pd.Series) -> pd.Series:
        return text.map(plain_normalize)

    @F.pandas_udf("bigint")
    def word_edits(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
        pairs = zip(reference, hypothesis, strict=True)
        return pd.Series([edits(plain_normalize(r).split(), plain_normalize(h).split()) for r, h in pairs])

    spark.udf.register(f"{prefix}normal_form", normal_form)
    spark.udf.register(f"{prefix}word_edits", word_edits)
