"""Quantiles of latencies by day and over any range of days, from sketches that are stored by day and add up.

A sketch counts values by buckets whose borders grow by a constant factor, so that a bucket's middle is within `error` of
each value in it, relative to the value. Sketches of days, roles or runs are merged by adding counts; nothing but
counts is kept, a few hundred rows a day and role whatever the number of calls.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.sources import store

ERROR = 0.01
SKETCH = "day date, role string, bucket int, n long"


def growth(error: float = ERROR) -> float:
    return (1 + error) / (1 - error)


def sketches(calls: DataFrame, error: float = ERROR) -> DataFrame:
    """day, role, bucket, n of calls (ts, role, latency_sec): bucket b has the values up to growth ** b and above growth ** (b - 1); null has nought and below. Null latencies are no values."""
    v = F.col("latency_sec")
    bucket = F.when(v > 0, F.ceil(F.log(v) / math.log(growth(error))).cast("int"))
    return calls.where(v.isNotNull()).groupBy(F.to_date("ts").alias("day"), "role", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def keep(calls: DataFrame, path: str, batch: str, error: float = ERROR) -> bool:
    """Add the sketches of some calls to those under path, once a batch."""
    return store.add(sketches(calls, error), path, batch)


def kept(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The sketches of the days from first to last."""
    rows = store.added(spark, path, SKETCH)
    rows = rows if first is None else rows.where(F.col("day") >= F.lit(first).cast("date"))
    return rows if last is None else rows.where(F.col("day") <= F.lit(last).cast("date"))


def quantiles(sketched: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.99), by: tuple[str, ...] = ("role",), error: float = ERROR) -> DataFrame:
    """by, n, and q50, q90, ... : the value at place ceil(share * n) in the order of size, within `error` of it."""
    merged = sketched.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*by)  # a bucket a row: some hundred rows
    rows = merged.withColumn("total", F.sum("n").over(own)).withColumn("upto", F.sum("n").over(own.orderBy(F.col("bucket").asc_nulls_first())))
    value = F.coalesce(F.round(2 * F.pow(F.lit(growth(error)), F.col("bucket")) / (growth(error) + 1), 6), F.lit(0.0))
    first = lambda share: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * F.lit(share)), value))
    return rows.groupBy(*by).agg(F.max("total").alias("n"), *(first(s).alias(f"q{s * 100:g}".replace(".", "_")) for s in shares))
