"""The manifest of reports: rows read from index pages and report files, newest first, and the log's rules from a profile."""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodeworks.operators import experiment as x
from lodeworks.runtime import ship

#: A row of an index page, a report's heading, and the date that a report's file name begins with.
ROW = r"(?s)<td class=\"timestamp\">([^<]*)</td>\s*<td><a href=\"([^\"]+)\">(.*?)</a></td>\s*<td class=\"description\">(.*?)</td>"
HEADING = r"(?s)<h1>(.*?)</h1>"
DATE = r"^(\d{4}-\d\d-\d\d)"
INDEX = "index.html"


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    def settled(text: str | None) -> str | None:
        while text is not None and (less := unescape(text)) != text:
            text = less
        return text

    return texts.map(settled)


def plain(c: Column) -> Column:
    """A text without character references, however often they were escaped, and without space at its ends."""
    return F.regexp_replace(_unescaped(c), r"(?U)^\s+|\s+\z", "")


def escaped(c: Column) -> Column:
    out = c
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def file_date(file: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(file, DATE, 1), F.lit("")), fallback)


def listed(pages: DataFrame) -> DataFrame:
    """file, pos, date, title, description of the rows of index pages (page, value); pos: page, then place in it."""
    ship(pages.sparkSession)
    rows = pages.select("page", F.posexplode(F.regexp_extract_all("value", F.lit(ROW), F.lit(0))).alias("at", "row"))
    part = lambda i: F.regexp_extract("row", ROW, i)
    file = F.element_at(F.split(part(2), "/", -1), -1)
    out = rows.select(file.alias("file"), F.struct("page", "at").alias("pos"), file_date(file, F.trim(part(1))).alias("date"), part(3).alias("title"), part(4).alias("description"))
    return out.where(~F.col("file").isin("", INDEX)).withColumns({"title": plain(F.col("title")), "description": plain(F.col("description"))})


def found(files: DataFrame) -> DataFrame:
    """The same columns for report files (file, value): the first heading is the title, or the name without its ending; no description."""
    heading = plain(F.regexp_replace(F.regexp_extract("value", HEADING, 1), r"\s+", " "))
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    rows = files.where((F.col("file") != INDEX) & F.col("file").rlike(r"^20.*-.*\.html$"))
    # those that no index has, by name downwards
    return rows.select("file", F.struct(F.lit(2**31 - 1).alias("page"), F.lit(0).alias("at")).alias("pos"), file_date(F.col("file"), F.lit("")).alias("date"), F.when(F.col("value").rlike(HEADING), heading).otherwise(stem).alias("title"), F.lit("").alias("description"))


def seeded(pages: DataFrame, files: DataFrame) -> DataFrame:
    """date, file, title, description: each file once, from its first row in the index pages, else from the file; newest first."""
    return newest_first(x.first_by_key([listed(pages), found(files)], "file")).select("date", "file", "title", "description")


def newest_first(rows: DataFrame) -> DataFrame:
    """By date downwards; of one date in the order of the index pages, then by name downwards."""
    return rows.orderBy(F.col("date").desc(), "pos", F.col("file").desc())


def log_rules(fields: DataFrame) -> tuple[list[str], dict[str, list[str]]]:
    """Required keys and allowed values from a profile's fields (key, required, enum), of which there are a few."""
    rows = fields.select("key", "required", "enum").collect()
    return [r["key"] for r in rows if r["required"]], {r["key"]: r["enum"] for r in rows if r["enum"]}


def reconciled(existing: DataFrame, detected: DataFrame, version: int, key: str = "key") -> DataFrame:
    """What exists, as it is, and what was detected under keys that are not there, with the version that added it."""
    return x.merged_by_key(existing, detected.withColumn("added_in", F.lit(version)), key)

