"""Stores of units, sessions and indexes: parquet folders with a manifest that says whether what is there can be trusted."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def checksum(df: DataFrame) -> tuple[int, int]:
    """The number of rows and a sum over their hashes, which no order changes; one pass, two numbers for the driver."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("s")).first()
    return int(row["n"]), int(row["s"] or 0)


def save(df: DataFrame, path: str, version: int = VERSION) -> None:
    """Write ``df`` to ``path``/rows, and behind it the manifest. A store whose writing broke off has no manifest that fits it."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    spark = df.sparkSession
    rows, digest = checksum(spark.read.schema(df.schema).parquet(f"{path}/rows"))
    spark.createDataFrame([(version, rows, str(digest))], "version int, n long, digest string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def load(spark: SparkSession, path: str, schema: str, version: int = VERSION) -> DataFrame:
    """What ``save`` wrote, or no rows of ``schema`` where the store is absent, of another version, broken or changed since."""
    empty = spark.createDataFrame([], schema)
    try:
        manifest = spark.read.parquet(f"{path}/manifest").first()
        rows = spark.read.schema(empty.schema).parquet(f"{path}/rows")
        if manifest is None or manifest["version"] != version or checksum(rows) != (manifest["n"], int(manifest["digest"])):
            return empty
    except Exception as broken:  # a store is a cache: whatever is wrong with its files, it is filled anew
        if not isinstance(broken, AnalysisException) and type(broken).__name__ not in ("Py4JJavaError", "SparkException", "PySparkException", "UnknownException"):
            raise
        return empty
    return rows


def unit_index(units: DataFrame) -> DataFrame:
    """The columns of an index of units: all but their calls."""
    return units.drop("calls")
