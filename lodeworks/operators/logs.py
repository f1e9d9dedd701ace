"""Operation logs: blocks of text to rows and back.

An entry is a header, `time LEVEL [operation] (tool) summary -- status`, then lines of `key: value`; a line of 80 "=" ends it.
A log is a folder of such text that only grows; `newest_first` gives its order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks import schemas
from lodeworks.functions.text import bound

#: The line between entries, a header, the keys that have columns of their own, what an entry must have, and levels.
SEPARATOR = "\n" + "=" * 80 + "\n"
HEADER = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d+) (\w+) \[([^\]]*)\] (.*)$"
KNOWN = ("branch", "task", "files", "details")
REQUIRED = ("timestamp", "level", "operation", "tool", "summary", "status")
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR")
#: How the known keys are written, in this order; other keys stand before the details.
LABELS = {"branch": "branch:  ", "task": "task:    ", "files": "files:   ", "details": "details: "}


def read(spark: SparkSession, path: str) -> DataFrame:
    """value: one row a block."""
    return spark.read.option("lineSep", SEPARATOR).text(path)


def _tool_end(rest: Column) -> Column:
    """Place of the bracket that closes the one at the start, counting those between; 0 if none does."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(a: Column, c: Column) -> Column:
        depth = a.depth + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        at = a.at + 1
        return F.struct(depth.alias("depth"), at.alias("at"), F.when((a.end == 0) & (depth == 0) & (c == ")"), at).otherwise(a.end).alias("end"))

    return F.when(rest.startswith("("), F.aggregate(F.split(rest, ""), start, step, lambda a: a.end)).otherwise(0)


def parsed(blocks: DataFrame) -> DataFrame:
    """timestamp, level, operation, tool, summary, status, branch, task, files (a list), details, extra (a map), fragment.

    Lines before a block's first header are a row of their own, of which only `fragment` is not null; so is a block without
    one. What follows the last " -- " is the status if it is one of the three, else part of the summary. The tool is what
    the first bracket holds, brackets in it counted; one that is never closed is part of the summary. Of `key: value` lines
    with one key the last counts; a line without a colon is dropped.
    """
    lines = F.split(F.regexp_replace("value", r"^\n+|\n+\z", ""), "\n", -1)
    rows = blocks.select(lines.alias("lines")).where(F.array_join("lines", "") != "")
    at = F.array_position(F.transform("lines", lambda x: x.rlike(HEADER)), True)
    rows = rows.select("lines", F.when(at > 0, at.cast("int")).alias("at"))
    rows = rows.select("*", F.get("lines", F.col("at") - 1).alias("head"))
    part = lambda i: F.regexp_extract("head", HEADER, i)
    tail = F.trim(F.substring_index(part(4), " -- ", -1))
    closed = part(4).contains(" -- ") & tail.isin(*schemas.STATUSES)
    without = F.regexp_replace(part(4), r" -- (?:(?! -- ).)*\z", "")
    rows = rows.select("*", F.when(closed, tail).alias("status"), F.when(closed, without).otherwise(part(4)).alias("rest"))
    rows = rows.select("*", _tool_end(F.col("rest")).alias("end"))
    entry = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value"))
    pairs = F.transform(F.filter(F.expr("slice(lines, coalesce(at, size(lines)) + 1, size(lines))"), lambda x: x.contains(":")), entry)
    last = bound(pairs, lambda p: F.filter(p, lambda x, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda y: y.key == x.key)))
    rows = rows.select("*", last.alias("pairs"))
    value = lambda key: F.get(F.transform(F.filter("pairs", lambda p: p.key == key), lambda p: p.value), F.lit(0))
    files = F.filter(F.transform(F.split(F.coalesce(value("files"), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    columns = {
        "timestamp": part(1), "level": part(2), "operation": part(3), "tool": F.when(F.col("end") > 0, F.expr("substring(rest, 2, end - 2)")).otherwise(""),
        "summary": F.when(F.col("end") > 0, F.expr("trim(substring(rest, end + 1))")).otherwise(F.col("rest")), "status": F.col("status"), "branch": value("branch"), "task": value("task"),
        "files": files, "details": value("details"), "extra": F.map_from_entries(F.filter("pairs", lambda p: ~p.key.isin(*KNOWN))),
    }
    kinds = {"files": "array<string>", "extra": "map<string,string>"}
    before = F.array_join(F.expr("slice(lines, 1, coalesce(at - 1, size(lines)))"), "\n")
    none = F.lit(None)
    whole = F.when(F.col("at").isNotNull(), F.struct(*(c.alias(k) for k, c in columns.items()), none.cast("string").alias("fragment")))
    lost = F.when(F.coalesce(F.col("at"), F.lit(2)) > 1, F.struct(*(none.cast(kinds.get(k, "string")).alias(k) for k in columns), before.alias("fragment")))
    return rows.select(F.inline(F.array_compact(F.array(lost, whole))))


def newest_first(rows: DataFrame) -> DataFrame:
    """In the order of a log; fragments, which have no time, last."""
    return rows.orderBy(F.col("timestamp").desc_nulls_last(), "operation", "summary")


def rendered(rows: DataFrame) -> DataFrame:
    """value: an entry as text, null and empty parts left out."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    head = F.concat(text("timestamp"), F.lit(" "), text("level"), F.lit(" ["), text("operation"), F.lit("] ("), text("tool"), F.lit(") "), text("summary"), F.lit(" -- "), text("status"))
    values = {k: F.nullif(F.array_join("files", ", ") if k == "files" else F.col(k), F.lit("")) for k in LABELS}
    known = {k: F.concat(F.lit(label), values[k]) for k, label in LABELS.items()}
    extra = F.nullif(F.array_join(F.transform(F.array_sort(F.map_entries("extra")), lambda e: F.concat(e.key, F.lit(": "), e.value)), "\n"), F.lit(""))
    return rows.select(F.concat_ws("\n", head, known["branch"], known["task"], known["files"], extra, known["details"]).alias("value"))


def append(rows: DataFrame, path: str) -> None:
    """Add entries to a log; fails, adding none, if one is not valid."""
    if bad := invalid(rows).select("why").first():
        raise ValueError(f"an entry is not valid: {bad['why']}")
    rendered(rows).write.mode("append").option("lineSep", SEPARATOR).text(path)


def invalid(rows: DataFrame, statuses: tuple[str, ...] = schemas.STATUSES, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Rows that lack a required value or have one that is not allowed, and why."""
    lacks = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(f"no {c}")) for c in REQUIRED]
    wrong = [F.when(F.col(c) != "", F.when(~F.col(c).isin(*allowed), F.lit(c))) for c, allowed in (("level", levels), ("status", statuses))]
    return rows.withColumn("why", F.array_compact(F.array(*lacks, *wrong))).where(F.size("why") > 0)


def activity(rows: DataFrame) -> DataFrame:
    """status, n, and the summary of its latest entry, the last in order of equally late ones; fragments count under null."""
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.max_by("summary", F.struct("timestamp", "summary")).alias("latest"))
