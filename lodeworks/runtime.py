"""Session helpers shared by every job: where cut lineage goes, and how tables are read."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that functions in it can be found there."""
    context = spark.sparkContext
    if getattr(context, "_lodeworks_shipped", False):
        return
    package = Path(__file__).parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='lodeworks-')}/lodeworks", "zip", package.parent, package.name)
    context.addPyFile(archive)
    context._lodeworks_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, as Spark reads it (a file or a folder of parts)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; set one only where none is named.

    The fallback is a temporary folder, which is right only where driver and executors share a disk (tests).
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors can both write."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut: written to the shared checkpoint folder, where any executor can read them."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same rows from files in the shared folder. For loops: a checkpoint keeps what the optimizer has inferred of its rows, and that multiplies from round to round."""
    path = scratch(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(rows: DataFrame, most: int = 500_000) -> DataFrame:
    """rows of some narrow columns, to be broadcast if there are `most` at most. Counted and then read, so cut them first where they are dear."""
    return F.broadcast(rows) if is_small(rows, most) else rows


def sorted_side(df: DataFrame) -> DataFrame:
    """df as a side of a join by sorting: for what grows with the corpus, where Spark would broadcast it by an estimate (it takes exploded rows for as many as before)."""
    return df.hint("merge")


def is_small(df: DataFrame, max_rows: int) -> bool:
    """Whether df has max_rows rows at most; looks at one row more than that and no further."""
    return df.limit(max_rows + 1).count() <= max_rows


def unused(df: DataFrame, *names: str) -> list[str]:
    """names, with as many underscores in front as it takes to be no column of df, in either case of letters."""
    there = {c.lower() for c in df.columns}
    mark = "_"
    while any((mark + n).lower() in there for n in names):
        mark += "_"
    return [mark + n for n in names]
