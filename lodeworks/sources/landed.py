"""Landed files as data sources for spark.read.format: ticker lookups, filing lists, and operation logs, which can also be written.

Files are opened by the tasks, through any file system that the path names (a plain path is one that all machines share).
Options say which files and entries are left out before they become rows. Filters are not taken over from Spark: as of 4.1, what is handed over for one
plan stays with the DataFrame and is applied in its next plan, too, so that a union of two filters of one DataFrame loses rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

from pyspark import cloudpickle
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from lodeworks.operators.logs import HEADER, SEPARATOR


def register(spark: SparkSession) -> None:
    """Make the formats landed_lookup, landed_filings and operation_log known to the session."""
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # planning happens in a process that may not have this package
    for source in (LookupSource, FilingsSource, LogSource):
        spark.dataSource.register(source)


def _open(path: str):
    """The file system of a path, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def _files(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """Names and sizes of the files at or under a path, none that is hidden."""
    from pyarrow import fs

    system, at = _open(path)
    there = system.get_file_info(at)
    found = [there] if there.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    root = "" if there.type == fs.FileType.File else at
    hidden = lambda f: any(p[:1] in "._" for p in f.path.removeprefix(root).strip("/").split("/"))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix) and not hidden(f))


def _read(path: str, file: str) -> bytes:
    with _open(path)[0].open_input_file(file) as f:
        return f.read()


@dataclass
class Part(InputPartition):
    file: str
    start: int = 0
    end: int = 0


class _Reader(DataSourceReader):
    def __init__(self, path: str, only: str | None) -> None:
        self.path, self.only = path, None if only is None else {x.strip() for x in only.split(",")}


class _Lookup(_Reader):
    def partitions(self) -> list[Part]:
        return [Part(file) for file, _ in _files(self.path, ".json")]

    def read(self, part: Part) -> Iterator[tuple]:
        rows = json.loads(_read(self.path, part.file))
        for pos, row in sorted(((int(k), v) for k, v in rows.items()), key=lambda x: x[0]):
            if self.only is None or row["ticker"] in self.only:
                yield pos, int(row["cik_str"]), row["ticker"], row.get("title")


class LookupSource(DataSource):
    """Files of {"0": {"cik_str": 1, "ticker": "T", "title": "..."}, ...}; option tickers (with commas): only those."""

    @classmethod
    def name(cls) -> str:
        return "landed_lookup"

    def schema(self) -> str:
        return "pos int, cik_str long, ticker string, title string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Lookup(self.options["path"], self.options.get("tickers"))


class _Filings(_Reader):
    def partitions(self) -> list[Part]:
        named = ((file, re.search(r"(\d{10})[^/]*$", file)) for file, _ in _files(self.path, ".json"))
        return [Part(file) for file, cik in named if cik and (self.only is None or cik[1] in self.only)]

    def read(self, part: Part) -> Iterator[tuple]:
        recent = json.loads(_read(self.path, part.file))["filings"]["recent"]
        cik = re.search(r"(\d{10})[^/]*$", part.file)[1]
        for pos, row in enumerate(zip(recent["form"], recent["reportDate"], recent["accessionNumber"], recent["primaryDocument"], strict=True)):
            yield cik, pos, *row


class FilingsSource(DataSource):
    """Lists of filings, a file a company with its ten digits in the name, as parallel arrays; option ciks (with commas): other files are not opened."""

    @classmethod
    def name(cls) -> str:
        return "landed_filings"

    def schema(self) -> str:
        return "cik string, pos int, form string, reportDate string, accessionNumber string, primaryDocument string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Filings(self.options["path"], self.options.get("ciks"))


class _Log(DataSourceReader):
    def __init__(self, path: str, size: int, since: str | None) -> None:
        self.path, self.size, self.since = path, size, since

    def partitions(self) -> list[Part]:
        return [Part(file, at, min(size, at + self.size)) for file, size in _files(self.path) for at in range(0, size, self.size)]

    def read(self, part: Part) -> Iterator[tuple]:
        """The blocks that begin in a part: after the separator that begins at or after the byte before it, up to the one that begins at its end or later."""
        mark, header = SEPARATOR.encode(), re.compile(HEADER, re.MULTILINE)
        with _open(self.path)[0].open_input_file(part.file) as f:
            size, at = f.size(), max(0, part.start - len(mark))
            f.seek(at)
            held = f.read(part.end - at + len(mark))
            begin = 0 if not part.start else held.find(mark) + len(mark)
            if begin < len(mark) and part.start:
                return  # no block begins here
            while at + begin < part.end:
                end = held.find(mark, begin)
                while end < 0 and at + len(held) < size:
                    old = max(begin, len(held) - len(mark))
                    held += f.read(1 << 20)
                    end = held.find(mark, old)
                block = held[begin : end if end >= 0 else len(held)].decode("utf-8", "replace")
                found = header.search(block)
                time = found[1] if found else None
                if block.strip("\n") and (self.since is None or time is not None and time >= self.since):
                    yield time, block
                if end < 0:
                    return
                begin = end + len(mark)


@dataclass
class Written(WriterCommitMessage):
    aside: str
    file: str


class _LogWriter(DataSourceWriter):
    """Each task writes a hidden file; the files get their names when all tasks are done, and are removed if one fails."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, rows: Iterator[Row]) -> Written:
        system, at = _open(self.path)
        name = uuid4().hex
        out = Written(f"{at}/_aside-{name}.log", f"{at}/{name}.log")
        system.create_dir(at, recursive=True)
        with system.open_output_stream(out.aside) as f:
            for row in rows:
                f.write((row["value"] + SEPARATOR).encode())
        return out

    def commit(self, messages: list[Written | None]) -> None:
        for m in filter(None, messages):
            _open(self.path)[0].move(m.aside, m.file)

    def abort(self, messages: list[Written | None]) -> None:
        for m in filter(None, messages):
            _open(self.path)[0].delete_file(m.aside)


class LogSource(DataSource):
    """Blocks of operation logs with the time of their first header (null where there is none), read by ranges of `size` bytes; option since: only blocks of that time or later. Rows of (timestamp, value) are written as entries."""

    @classmethod
    def name(cls) -> str:
        return "operation_log"

    def schema(self) -> str:
        return "timestamp string, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Log(self.options["path"], int(self.options.get("size", 16 << 20)), self.options.get("since"))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a log only grows")
        return _LogWriter(self.options["path"])
