"""Readers for the parquet tables of a scale directory, and helpers on how their rows are spread."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``sf_dir``, which may be one file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out evenly when fewer partitions exist than the cluster has cores.

    A small file is one split; work that is heavy per row would then run on one core. With enough
    splits, as on any large input, this is the plan unchanged and costs no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """One row per ``keys``: the one with the greatest ``by`` (nulls last, ties by the whole row's hash)."""
    others = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(by).isNotNull(), F.col(by), F.xxhash64(*others))
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in others])


def normal_path(path) -> F.col:
    """Forward slashes, no leading ``./``."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^(\\./)+", "")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; one of our own only where Spark runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillspan-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared checkpoint folder and read from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
