"""Streams that can stop anywhere and go on: batches committed once, and freshness as state with a time limit."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodeworks import schemas
from lodeworks.operators import experiment as x
from lodeworks.runtime import cut, ship
from lodeworks.sources import store


def run_stream(cells: DataFrame, root: str, compute: Callable[[DataFrame], DataFrame], state: str) -> int:
    """Run the cells of a stream (rows of the matrix) that the results table under root lacks, batch by batch, until the source is read to its end; how many batches there were.

    compute: cells to rows of the results table. A batch is added whole, under a name made of the stream's checkpoint folder and the batch's number.
    A run that dies before that repeats the batch; one that dies after it, but before the stream's own note of it, finds the batch there and goes on. Cells that any earlier
    run finished, whatever its folder, and cells that come twice are done once.
    """
    spark, path = cells.sparkSession, f"{root}/results"
    store.create(spark, root)
    name = hashlib.md5(state.encode()).hexdigest()[:12]

    def commit(batch: DataFrame, number: int) -> None:
        if store.has(spark, path, f"{name}-{number}"):
            return
        todo = cut(x.remaining(batch.select(x.CELL).dropDuplicates(), store.read(spark, root, "results")))
        if todo.limit(1).count():
            rows = compute(todo).select(*(f.name for f in schemas.RESULTS))
            store.add(rows, path, f"{name}-{number}", tuple(schemas.PARTITIONED["results"]))

    run = cells.writeStream.foreachBatch(commit).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    if run.exception() is not None:
        raise run.exception()
    return len([p for p in run.recentProgress if p.numInputRows])


def cell_stream(spark: SparkSession, path: str) -> DataFrame:
    """Cells from the files under path, a file a batch."""
    return spark.readStream.schema("source_set string, query_id string, pipeline string, k_value int").option("maxFilesPerTrigger", 1).parquet(path)


def parses(events: DataFrame, key: str, event: str, ts: str = "ts", hours: int = store.FRESH_HOURS, late: str = "0 seconds") -> DataFrame:
    """key, event, parse of a stream of file events: whether the file has to be parsed again, as its last parse is `hours` or more ago or unknown.

    What is kept of a file is the time of its last parse, and that only for `hours`: once the watermark has passed that limit, the state goes,
    as the next event will parse in any case. Events of a batch are taken in the order of time, then of `event`.
    """
    ship(events.sparkSession)
    kinds = dict(events.dtypes)
    limit = hours * 3_600_000_000  # microseconds

    def judge(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches))
        at = rows["__at"].to_numpy()
        order = np.lexsort((rows["__event"].to_numpy(), at))
        at, parsed, i = at[order], np.zeros(len(rows), bool), 0
        last = state.get[0] if state.exists else None
        if last is not None:
            i = int(np.searchsorted(at, last + limit))
        while i < len(at):  # from one parse to the first event that finds it too old
            parsed[i], last = True, int(at[i])
            i = int(np.searchsorted(at, last + limit))
        if last is not None and (last + limit) // 1000 > state.getCurrentWatermarkMs():
            state.update((last,))
            state.setTimeoutTimestamp((last + limit) // 1000)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"key": name[0], "event": rows["__event"].to_numpy()[order], "parse": parsed})

    rows = events.select(F.col(key).alias("__key"), F.col(event).alias("__event"), F.col(ts).cast("timestamp").alias("__ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("__at")).withWatermark("__ts", late)
    out = rows.groupBy("__key").applyInPandasWithState(judge, f"key {kinds[key]}, event {kinds[event]}, parse boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.toDF(key, event, "parse")


def collected(rows: DataFrame, folder: str) -> DataFrame:
    """All rows that a stream appends until its source is read to its end, in files under folder."""
    run = rows.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    if run.exception() is not None:
        raise run.exception()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")
