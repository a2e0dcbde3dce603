"""Watching a folder of units, event windows, and session memory as state."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspan.functions.text import estimate_tokens

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB with bounded memory, so that the heap does not limit the keys."""
    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def watch_units(spark: SparkSession, folder: str, pattern: str = "*.parquet", schema: StructType | None = None) -> DataFrame:
    """A stream of new unit files in a folder, with the token estimate of each text taken anew.

    Restarting with the same checkpoint reads each file once; run it with ``availableNow`` for a
    catch-up or with a processing-time trigger to keep watching.
    """
    units = spark.readStream.schema(schema or spark.read.parquet(folder).schema).option("pathGlobFilter", pattern).parquet(folder)
    return units.select("unit_id", "repo", "file", "name", estimate_tokens(F.coalesce("full_text", F.lit(""))).alias("tok_full"))


def event_windows(events: DataFrame, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Events and value per window and type; in a stream what comes later than ``late`` is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(
        F.col("w.start").alias("start"), "event_type", "events", F.round("value", 4).alias("value")
    )


def session_memory(plans: DataFrame) -> DataFrame:
    """A stream of included units into running access counts per (session_id, unit_key), kept without an end.

    ``plans`` has session_id, unit_key and recorded_at. Each trigger, in update mode, emits the keys it saw with their counts
    and the latest time among their records so far, null where none has one. Counts are Spark's own stateful aggregation:
    what a trigger brings is summed before the shuffle, and no Python call is made per key.
    """
    return plans.groupBy("session_id", "unit_key").agg(F.count("*").alias("accesses"), F.max("recorded_at").alias("last_at"))
