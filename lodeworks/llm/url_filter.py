"""URL filters: a trie over reversed host labels, then path segments, broadcast to the tasks.

A rule is a host and a path prefix. It fits a url whose host is the rule's or a subdomain of it and whose path starts
with the rule's path. Of the rules that fit, the longest (host and path together) decides; of equally long ones that with
more host labels; where the same host and path is both allowed and blocked, block decides. No rule: `default`.

Defined results. Null url, or one without "://": empty host and path, no rule can fit an empty host, so the default.
Empty host labels ("a..org") are labels like any other. Repeated rows are judged one by one; an empty table gives an
empty result; other columns are not read by the query and are passed through, untouched, by `judge`, which refuses input
that already has one of its result columns.

Scale: a narrow map, no shuffle, and only the url column is read. The rules are cut into blocks of at most
`max_block_chars`, about 130 MB of trie in a worker, so what is broadcast at once is bounded; each block is one pass that keeps the
best rule so far. Rules are sent flat and each worker builds its trie, so that a rule may be as deep as it likes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.llm.text import UPPER, ascii_lower, unused
from lodeworks.runtime import cut, table

MAX_BLOCK_CHARS = 3_000_000


class Rule(NamedTuple):
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(action: str, text: str) -> Rule:
    """`rule("block", "example.org/es/")`; text without "/" fits every path, the empty one too."""
    if action not in ("allow", "block"):
        raise ValueError(f"a rule allows or blocks, not {action!r}")
    host, slash, path = text.partition("/")
    if not host:
        raise ValueError(f"a rule needs a host: {text!r}")
    return Rule(action, host.lower(), slash + path)


#: The rules the registered query is asked to apply.
RULES = (
    rule("allow", "org/"),
    rule("block", "example.org/es/"),
    rule("block", "example.org/en/1"),
    rule("allow", "com/fr/"),
    rule("block", "com/de/"),
)


def split_path(path: str) -> list[str]:
    """Segments, each with the slash that ends it; the last may have none."""
    parts = path.split("/")
    return [p + "/" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


class PathNode:
    """Rules below one host, by path segment. `stubs`: last segments without a slash, which fit as prefixes."""

    __slots__ = ("below", "rule", "stubs", "lengths")

    def __init__(self) -> None:
        self.below: dict[str, PathNode] = {}
        self.rule: Rule | None = None
        self.stubs: dict[str, Rule] = {}
        self.lengths: list[int] = []


class HostNode:
    __slots__ = ("below", "paths")

    def __init__(self) -> None:
        self.below: dict[str, HostNode] = {}
        self.paths: PathNode | None = None


class Trie:
    def __init__(self, rules: Iterable[Rule]) -> None:
        self.root = HostNode()
        self.rules = list(rules)
        for r in self.rules:
            self._add(r)

    def __reduce__(self):
        return Trie, (self.rules,)

    def _add(self, r: Rule) -> None:
        node = self.root
        for label in reversed(r.host.split(".")):
            node = node.below.setdefault(label, HostNode())
        node.paths = at = node.paths or PathNode()
        segments = split_path(r.path)
        stub = segments.pop() if segments and not segments[-1].endswith("/") else None
        for s in segments:
            at = at.below.setdefault(s, PathNode())
        if stub is None:
            at.rule = self._stronger(at.rule, r)
        else:
            at.stubs[stub] = self._stronger(at.stubs.get(stub), r)
            at.lengths = sorted({len(x) for x in at.stubs}, reverse=True)

    @staticmethod
    def _stronger(old: Rule | None, new: Rule) -> Rule:
        return new if old is None or new.action == "block" else old

    def longest(self, host: str, path: str) -> Rule | None:
        if not host:
            return None
        best, segments, node = None, None, self.root
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            if node.paths is None:
                continue
            if segments is None:
                segments = split_path(path)
            found = self._deepest(node.paths, segments)
            if found is not None and (best is None or len(found.text) >= len(best.text)):
                best = found
        return best

    @staticmethod
    def _deepest(node: PathNode, segments: list[str]) -> Rule | None:
        best = node.rule
        for s in segments:
            for n in node.lengths:
                if len(s) >= n and s[:n] in node.stubs:
                    best = node.stubs[s[:n]]
                    break
            node = node.below.get(s)
            if node is None:
                break
            best = node.rule or best
        return best


def blocks(rules: Iterable[Rule], max_chars: int = MAX_BLOCK_CHARS) -> Iterator[list[Rule]]:
    """The rules in runs of at most max_chars characters, so that no broadcast is larger than that."""
    block: list[Rule] = []
    size = 0
    for r in rules:
        if block and size + len(r.text) > max_chars:
            yield block
            block, size = [], 0
        block.append(r)
        size += len(r.text)
    yield block


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


FOUND = T.StructType([T.StructField("rule", T.StringType()), T.StructField("action", T.StringType()), T.StructField("labels", T.IntegerType())])


def judge(pages: DataFrame, rules: Iterable[Rule] = RULES, default: str = "allow", url: str = "url", max_block_chars: int = MAX_BLOCK_CHARS) -> DataFrame:
    """pages with host, path, rule and verdict."""
    if clash := {"host", "path", "rule", "verdict"} & {c.lower() for c in pages.columns}:
        raise ValueError(f"the input already has {sorted(clash)}")
    spark, kept = pages.sparkSession, pages.columns
    labels, found = unused(pages, "labels", "found")
    out = pages.select("*", host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    out = out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string"), labels: F.lit(0)})
    for k, block in enumerate(blocks(rules, max_block_chars)):
        find = _finder(spark.sparkContext.broadcast(Trie(block)))
        # asNondeterministic keeps the optimizer from calling the function once for each of its fields
        out = out.withColumn(found, find.asNondeterministic()("host", "path"))
        n, m = F.length(f"{found}.rule"), F.coalesce(F.length("rule"), F.lit(-1))
        same = (n == m) & (F.col(f"{found}.labels") == F.col(labels)) & (F.col(f"{found}.action") == "block")
        better = F.coalesce((n > m) | ((n == m) & (F.col(f"{found}.labels") > F.col(labels))) | same, F.lit(False))
        out = out.select(
            *(F.col(f"`{c}`") for c in kept), "host", "path",
            F.when(better, F.col(f"{found}.rule")).otherwise(F.col("rule")).alias("rule"),
            F.when(better, F.col(f"{found}.action")).otherwise(F.col("verdict")).alias("verdict"),
            F.when(better, F.col(f"{found}.labels")).otherwise(F.col(labels)).alias(labels),
        )
        if k % 4 == 3:  # else all blocks would be held by one task at once
            out = cut(out)
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default))).drop(labels)


def _finder(trie):
    @F.pandas_udf(FOUND)
    def find(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        longest = trie.value.longest
        found = [longest(h, p) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame({"rule": [r and r.text for r in found], "action": [r and r.action for r in found], "labels": [r.host.count(".") + 1 if r else 0 for r in found]})

    return find


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


#: The same five rules, longest first, written out for a SQL engine.
OP1_SQL = rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), named AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/'
  END AS rule FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM named
"""
