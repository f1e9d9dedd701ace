"""Streams: daily totals with a watermark, and appends that reject keys already there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.runtime import scratch
from lodeworks.sources import store


def daily(events: DataFrame, late: str = "2 days") -> DataFrame:
    """day, event_type, n, total of a stream or a table of events; with a watermark, days close when they are `late` past."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    days = rows.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return days.select(F.col("window.start").cast("date").alias("day"), "event_type", "n", "total")


def stream(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """A file stream of the parquet files in path whose names fit pattern."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 1).parquet(path)


def first_only(events: DataFrame, key: str, late: str = "2 days") -> DataFrame:
    """Later rows of a key dropped, as long as the watermark keeps the first in mind."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def drained(rows: DataFrame, keys: tuple[str, ...], folder: str | None = None) -> DataFrame:
    """The rows of a streaming aggregate once its source is read to the end: of each key the newest.

    Batches give the keys that changed, and are added under their number, so that a batch that is repeated changes nothing and readers always
    see some whole state. What is kept in memory is what the watermark has not closed yet.
    """
    spark, out = rows.sparkSession, folder or scratch(rows.sparkSession, "stream")

    def change(batch: DataFrame, number: int) -> None:
        store.add(batch.withColumn("number", F.lit(number).cast("long")), f"{out}/rows", f"{number:08d}")

    run = rows.writeStream.outputMode("update").foreachBatch(change).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    if run.exception() is not None:
        raise run.exception()
    return newest(spark, f"{out}/rows", rows.schema, keys)


def newest(spark: SparkSession, path: str, schema: T.StructType, keys: tuple[str, ...]) -> DataFrame:
    """Of each key the row of the last batch that has it."""
    whole = store.added(spark, path, T.StructType([*schema, T.StructField("number", T.LongType())]))
    return whole.groupBy(*keys).agg(F.max_by(F.struct(*(f.name for f in schema if f.name not in keys)), "number").alias("row")).select(*keys, "row.*").select(schema.names)
