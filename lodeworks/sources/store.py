"""Reading and writing an evaluation store: files landed from outside, and tables with keys."""

from __future__ import annotations

import re
from uuid import uuid4
from collections.abc import Iterator
from contextlib import contextmanager
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks import schemas
from lodeworks.runtime import ship, unused

#: The form a filing must have, and where archived filings are.
FORM = "10-K"
ARCHIVE = "https://www.sec.gov/Archives/edgar/data/%d/%s/%s"
FRESH_HOURS = 48
TREES = "document_id string, level int, pos long, words array<string>, run int"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path)


def duplicated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once; empty if the rows are as they should be."""
    return rows.groupBy(*keys).count().where("count > 1").drop("count")


def with_cik(wanted: DataFrame, lookup: DataFrame) -> DataFrame:
    """wanted (ticker, ...) with cik, ten digits; null where the ticker is unknown. lookup: cik_str, ticker; its first row in `pos` wins."""
    (name,) = unused(wanted, "t")
    first = lookup.select(F.upper("ticker").alias(name), F.lpad(F.col("cik_str").cast("string"), 10, "0").alias("cik"), "pos").groupBy(name).agg(F.min_by("cik", "pos").alias("cik"))
    return wanted.join(first, F.upper("ticker") == F.col(name), "left").drop(name)


def filings(recent: DataFrame) -> DataFrame:
    """cik, pos, form, reportDate, accessionNumber, primaryDocument: one row a filing from its parallel arrays."""
    names = ["form", "reportDate", "accessionNumber", "primaryDocument"]
    zipped = F.arrays_zip(*(F.col(n).alias(n) for n in names))
    return recent.select("cik", F.posexplode(zipped).alias("pos", "x")).select("cik", "pos", "x.*")


def first_filing(wanted: DataFrame, listed: DataFrame) -> DataFrame:
    """wanted (document_id, cik, fiscal_year) with the url of the first matching filing in listed order; null where none is."""
    met = wanted.join(listed, "cik").where((F.col("form") == FORM) & F.col("reportDate").startswith(F.col("fiscal_year").cast("string")))
    url = F.format_string(ARCHIVE, F.col("cik").cast("long"), F.regexp_replace("accessionNumber", "-", ""), F.col("primaryDocument"))
    first = met.groupBy("document_id").agg(F.min_by(url, "pos").alias("url"))
    return wanted.join(first, "document_id", "left")


def required(rows: DataFrame, column: str, what: str) -> DataFrame:
    """rows; running them fails if column is null anywhere."""
    return rows.withColumn(column, F.when(F.col(column).isNull(), F.raise_error(F.concat(F.lit(f"{what}: "), F.to_json(F.struct("*"))))).otherwise(F.col(column)))


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """document_id, path, modified, content of the files that were fetched."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("document_id"), "path", F.col("modificationTime").alias("modified"), "content")


def to_fetch(wanted: DataFrame, have: DataFrame) -> DataFrame:
    return wanted.join(have.select("document_id"), "document_id", "left_anti")


def fresh(have: DataFrame, now: Column | None = None, hours: int = FRESH_HOURS) -> DataFrame:
    """What was parsed less than `hours` ago."""
    return have.where(F.col("modified") > (F.current_timestamp() if now is None else now) - F.expr(f"INTERVAL {hours} HOURS"))


def joined_pages(pages: DataFrame) -> DataFrame:
    """document_id, markdown from document_id, page, text: pages in order, a blank line between them."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("document_id").agg(F.array_join(F.transform(ordered, lambda x: x.text), "\n\n").alias("markdown"))


def parsed(spark: SparkSession, folder: str) -> DataFrame:
    """document_id, markdown of the files in folder."""
    rows = spark.read.text(folder, wholetext=True).withColumn("path", F.input_file_name())
    return rows.select(F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("document_id"), F.col("value").alias("markdown"))


class _Markdown(HTMLParser):
    """Headings, paragraphs and tables of a page as Markdown blocks; scripts and styles left out.

    Only tags of blocks, line breaks and cells part words. A tag with a prefix marks a figure inside a sentence, often on lines of its own:
    between it and a currency sign before it, or a closing mark after it, there is no space. A cell that spans columns stands
    in the first of them; columns that are empty in every row are left out.
    """

    BLOCKS = frozenset("p div section article header footer nav ul ol li br h1 h2 h3 h4 h5 h6 table title hr form dl dt dd blockquote pre".split())
    SILENT = frozenset(("script", "style"))
    HEADINGS = {f"h{n}": "#" * n + " " for n in range(1, 7)}
    EDGE = "\ufdd0"  # no character of any text

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.text: list[str] = []
        self.table: list[list[tuple[str, int]]] | None = None
        self.span = self.silent = 0
        self.lead = ""

    def taken(self) -> str:
        text = " ".join("".join(self.text).split())
        self.text = []
        if self.EDGE in text:
            text = re.sub(rf"([$£€(]) ?{self.EDGE} ?(?=[\d(])|(?<=[\d)]) ?{self.EDGE} ?(?=[.,;:%)])", r"\1", text)
            text = " ".join(text.replace(self.EDGE, "").split())
        return text

    def flush(self) -> None:
        if text := self.taken():
            self.blocks.append(self.lead + text)

    def cell(self) -> None:
        """End the open cell, if there is one."""
        if self.table and self.span:
            self.table[-1].append((self.taken(), self.span))
        self.text, self.span = [], 0

    def rows(self) -> list[str]:
        grid = [[x for text, span in row for x in (text, *[""] * (span - 1))] for row in self.table or []]
        width = max(map(len, grid), default=0)
        used = [k for k in range(width) if any(k < len(r) and r[k] for r in grid)]
        return ["| " + " | ".join(r[k] if k < len(r) else "" for k in used) + " |" for r in grid if any(r)]

    def handle_starttag(self, tag, attrs) -> None:
        if tag in self.SILENT:
            self.silent += 1
        elif self.table is not None:
            if tag == "tr":
                self.cell()
                self.table.append([])
            elif tag in ("td", "th"):
                self.cell()
                wide = dict(attrs).get("colspan") or ""
                self.span = min(1000, int(wide)) if wide.isdigit() and int(wide) else 1
            elif tag in self.BLOCKS:
                self.text.append(" ")
        elif tag in self.BLOCKS:
            self.flush()
            self.lead = self.HEADINGS.get(tag, "")
            if tag == "table":
                self.table = []
        if ":" in tag:
            self.text.append(self.EDGE)

    def handle_endtag(self, tag) -> None:
        if ":" in tag:
            self.text.append(self.EDGE)
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif self.table is not None:
            if tag in ("td", "th", "tr"):
                self.cell()
            elif tag == "table":
                self.cell()
                if rows := self.rows():
                    self.blocks.append("\n".join(rows))
                self.table = None
            elif tag in self.BLOCKS:
                self.text.append(" ")
        elif tag in self.BLOCKS:
            self.flush()
            self.lead = ""

    def handle_data(self, data) -> None:
        if not self.silent:
            self.text.append(data)

    def close(self) -> None:
        super().close()
        if self.table is not None:
            self.handle_endtag("table")
        self.flush()


def to_markdown(html: str | None) -> str:
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    return "\n\n".join(parser.blocks)


def parsed_pages(pages: DataFrame, id_column: str = "page_id", html: str = "html", convert=to_markdown) -> DataFrame:
    """document_id, markdown. `convert` is the place of a hosted parser: one text in, one text out."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"document_id": batch["document_id"], "markdown": [convert(x) for x in batch["html"]]})

    rows = pages.select(F.col(id_column).cast("string").alias("document_id"), F.col(html).alias("html"))
    return rows.mapInPandas(run, "document_id string, markdown string")


class _Files:
    """The file system that a path is on, as the driver sees it: any that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(path))] if self.exists(path) else []

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def rename(self, old: str, new: str) -> None:
        if self.exists(new) or not self._fs.rename(self._path(old), self._path(new)):
            raise FileExistsError(f"{new} is there already")


#: Readers never look into folders whose names begin so: Spark takes them for hidden.
ASIDE = "_aside-"


def add(rows: DataFrame, path: str, name: str | None = None, by: tuple[str, ...] = ()) -> bool:
    """Add rows to the files under path as one batch, which readers see whole or not at all; False if a batch of that name is there, as nothing is written then.

    Written aside and published with one rename (atomic on file systems that have an atomic rename of folders). A writer that dies leaves a
    folder that no reader sees, and the next writer of the same batch begins anew.
    """
    files, name = _Files(rows.sparkSession, path), name or uuid4().hex
    if files.exists(f"{path}/batch={name}"):
        return False
    files.make(path)
    aside = f"{path}/{ASIDE}{name}"
    rows.write.mode("overwrite").partitionBy(*by).parquet(aside)
    files.rename(aside, f"{path}/batch={name}")
    return True


def has(spark: SparkSession, path: str, name: str) -> bool:
    return _Files(spark, path).exists(f"{path}/batch={name}")


def added(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """All batches under path; none where nothing was added."""
    _Files(spark, path).make(path)
    rows = spark.read.schema(schema).parquet(path)
    return rows.select([f.name for f in (schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema))])


@contextmanager
def publishing(spark: SparkSession, root: str) -> Iterator[str]:
    """A new folder to write a whole version of something to; it is published as the newest when the block ends, with one rename.

    One writer at a time: what writers that died have left is removed first. If the block fails, nothing is published.
    """
    files = _Files(spark, root)
    files.make(root)
    for name in files.names(root):
        if name.startswith(ASIDE):
            files.remove(f"{root}/{name}")
    aside = f"{root}/{ASIDE}{uuid4().hex}"
    yield aside
    files.rename(aside, f"{root}/{_version(_newest(files, root) + 1)}")


def _version(n: int) -> str:
    return f"version-{n:08d}"


def _newest(files: _Files, root: str) -> int:
    return max((int(x.removeprefix("version-")) for x in files.names(root) if x.startswith("version-")), default=0)


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the newest version under root."""
    newest = _newest(_Files(spark, root), root)
    if not newest:
        raise FileNotFoundError(f"nothing is published under {root}")
    return spark.read.parquet(f"{root}/{_version(newest)}/{name}")


def create(spark: SparkSession, root: str) -> None:
    """Empty tables where there are none yet."""
    for name in schemas.TABLES:
        _Files(spark, root).make(f"{root}/{name}")


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table; filters on its partition columns choose folders."""
    return added(spark, f"{root}/{name}", schemas.TABLES[name])


def append(rows: DataFrame, root: str, name: str, batch: str | None = None) -> None:
    """Add rows as one batch; fails, adding none, if one of their keys is there already or occurs twice."""
    keys = schemas.KEYS[name]
    there = read(rows.sparkSession, root, name).join(rows.select(keys), keys, "left_semi").limit(1).count()
    if there or duplicated(rows, *keys).limit(1).count():
        raise ValueError(f"{name}: a row with the same {', '.join(keys)} exists")
    add(rows.select([f.name for f in schemas.TABLES[name]]), f"{root}/{name}", batch, tuple(schemas.PARTITIONED.get(name, ())))


def completed(results: DataFrame, source_set: str) -> DataFrame:
    """Keys of finished cells; a row counts whatever its scores."""
    return results.where(F.col("source_set") == source_set).select("query_id", "pipeline", "k_value").distinct()


def as_json(ids: Column) -> Column:
    return F.to_json(ids)


def from_json(text: Column) -> Column:
    """A list of ids; null, empty and malformed text give an empty one."""
    return F.coalesce(F.from_json(F.nullif(text, F.lit("")), "array<string>"), F.array().cast("array<string>"))


def with_scores(results: DataFrame, scores: DataFrame) -> DataFrame:
    """results with the human and judge scores of a second table, where it has them."""
    keys = schemas.KEYS["results"]
    h, j = unused(results, "h", "j")
    s = scores.select(*keys, F.col("human_score").alias(h), F.col("judge_score").alias(j))
    return results.join(s, keys, "left").withColumns({"human_score": F.coalesce(h, "human_score"), "judge_score": F.coalesce(j, "judge_score")}).drop(h, j)


def save_trees(trees: DataFrame, root: str) -> None:
    """Add trees (document_id, level, pos, words, run), whole or not at all."""
    add(trees.select("document_id", "level", "pos", "words", "run"), f"{root}/trees")


def trees(spark: SparkSession, root: str) -> DataFrame:
    """Each document's tree of its newest run; none where none was saved."""
    rows = added(spark, f"{root}/trees", TREES)
    newest = rows.groupBy("document_id").agg(F.max("run").alias("run"))
    return rows.join(newest, ["document_id", "run"])


def to_build(documents: DataFrame, built: DataFrame) -> DataFrame:
    return documents.join(built.select("document_id").distinct(), "document_id", "left_anti")


def log_costs(costs: DataFrame, path: str) -> None:
    costs.write.mode("append").json(path)


def costs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of skipped builds have the first two columns only."""
    return spark.read.schema(schemas.BUILD_COST).json(path)


def audit_report(nodes: DataFrame) -> DataFrame:
    """value: the whole report over a sample of nodes, in the order of their ids: one row, as long as the sample."""
    section = F.coalesce(F.nullif("parent_item_header", F.lit("")), F.lit("(none)"))
    one = F.concat(
        F.lit("## "), F.col("node_id"), F.lit(" ("), F.col("node_type"), F.lit(")\n- Document: "), F.col("document_id").cast("string"), F.lit("\n- Section: "), section,
        F.lit("\n- Token count: "), F.col("token_count").cast("string"), F.lit("\n\n```\n"), F.col("content"), F.lit("\n```\n"),
    )
    all_ = nodes.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("node_id", one.alias("text")))).alias("x"))
    head = F.concat(F.lit("# Parsing Validation Audit\n\nSampled "), F.col("n").cast("string"), F.lit(" node(s) for manual review.\n\n"))
    return all_.select(F.concat(head, F.array_join("x.text", "\n")).alias("value"))
