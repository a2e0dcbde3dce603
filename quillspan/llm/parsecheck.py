"""Source files that cannot be read in the language of their extension."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.sources.files import language_of as language

from .lexing import KINDS, unreadable


@F.pandas_udf(T.StringType())
def fault(text: pd.Series, lang: pd.Series) -> pd.Series:
    """The fault of each whole text in its language; null for readable, null and empty texts and unknown languages."""
    return pd.Series([unreadable(t, k) if isinstance(t, str) and t.strip() and isinstance(k, str) else None for t, k in zip(text, lang)], dtype=object)


def judge_units(units: DataFrame) -> DataFrame:
    """``repo, file, language, unit_id, fault`` of each row of ``units``; a narrow job without a shuffle."""
    told = units.select("repo", "file", "unit_id", "full_text", language(F.col("file")).alias("language"))
    return told.select("repo", "file", "language", "unit_id", fault("full_text", "language").alias("fault"))


def unreadable_files(units: DataFrame) -> DataFrame:
    """Distinct (repo, file) with at least one unreadable unit. Repeated rows count once; nulls in repo or file stay."""
    return judge_units(units).where(F.col("fault").isNotNull()).select("repo", "file").distinct()


def fault_rates(units: DataFrame) -> DataFrame:
    """Per repo and language: files, files flagged, their rate, and flagged files by kind of fault.

    Counted in two steps, first per file, so that a repository holding most rows is spread over its files.
    """
    files = judge_units(units).groupBy("repo", "language", "file").agg(
        F.max(F.col("fault").isNotNull().cast("int")).alias("bad"),
        *[F.max((F.coalesce(F.col("fault"), F.lit("")) == k).cast("int")).alias(k) for k in KINDS],
    )
    return files.groupBy("repo", "language").agg(
        F.count("*").alias("files"),
        F.sum("bad").alias("flagged"),
        F.round(F.avg("bad"), 6).alias("rate"),
        *[F.sum(k).alias(k) for k in KINDS],
    )
