"""Models as batch functions: loaded once a worker, called with the lists of a batch, and tried again when a call fails."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.runtime import ship

_LOADED: dict[str, Callable[..., list]] = {}


@dataclass(frozen=True)
class Model:
    """name tells models apart within a worker; load gives a function of as many lists as it has inputs to a list as long; kind is the type of its items."""

    name: str
    load: Callable[[], Callable[..., list]]
    kind: str

    def get(self) -> Callable[..., list]:
        if self.name not in _LOADED:
            _LOADED[self.name] = self.load()
        return _LOADED[self.name]


def column(model: Model, *inputs: Column) -> Column:
    """What the model gives for some columns: an iterator of Arrow batches, so that the model is there before the first of them."""

    def of_series(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        run = model.get()
        for batch in batches:
            lists = [x.tolist() for x in (batch if isinstance(batch, tuple) else (batch,))]
            out = run(*lists)
            if len(out) != len(lists[0]):
                raise ValueError(f"{model.name} gave {len(out)} items for {len(lists[0])}")
            yield pd.Series(out, dtype=object)

    one = F.pandas_udf(model.kind)
    if len(inputs) == 1:

        def run_one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            yield from of_series(batches)

        return one(run_one)(*inputs)

    def run_some(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        yield from of_series(batches)

    return one(run_some)(*inputs)


def with_model(rows: DataFrame, name: str, model: Model, *inputs: Column) -> DataFrame:
    ship(rows.sparkSession)
    return rows.withColumn(name, column(model, *inputs))


def patient(call: Callable, attempts: int = 6, first_wait: float = 1.0, most_wait: float = 60.0, again: type[Exception] | tuple = Exception, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """call, tried again when it fails with an error of the kind `again`: after first_wait seconds, then twice as long each time, up to
    most_wait, with a random part of it taken off, so that callers do not come back together. The last error is raised."""

    def run(*args):
        for k in range(attempts):
            try:
                return call(*args)
            except again:
                if k + 1 == attempts:
                    raise
                sleep(min(most_wait, first_wait * 2**k) * random.uniform(0.5, 1.0))

    return run


def together(call: Callable, most: int = 5) -> Callable[..., list]:
    """A batch function from one that takes single items: at most `most` calls at once in a task, results in the items' order."""

    def run(*lists: list) -> list:
        with ThreadPoolExecutor(max_workers=most) as pool:
            return list(pool.map(call, *lists))

    return run
