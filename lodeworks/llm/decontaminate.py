"""Benchmark decontamination: an FM-index for each training shard, searched backwards for every benchmark window.

A shard is a run of a task's documents of about `shard_words` words. Words that no benchmark item has stand between
phrases as separators; stretches too short for any window are left out, as nothing can occur there. What remains is one
sequence of word numbers: its suffix array gives the Burrows-Wheeler transform, kept as a wavelet tree with ranks by
block; all windows are searched together, last word first; the rows found are located by walking back to sampled
suffix positions; the spans are merged by document.

Words: `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. Windows: `window` consecutive words of an
item; an item of fewer words, but not none, is one window.

Defined results. A null or empty text has no words; a null or empty item has no windows; a null item_id with windows
hits words, and is not counted or named. Rows of one item_id count as one item. Repeated documents are judged one by one. Empty tables: no documents, or no
hits. Whole texts are used, whatever their length (a text longer than a shard is a shard of its own). Columns the
input has besides are kept by `remove`, whatever their names; the query reads two columns.

Scale: a narrow map over the documents, no shuffle. The benchmark is cut by hash into blocks of about `block_chars`; only one block is on
the driver or in a broadcast at a time, about 130 MB of windows, and each block is a pass that adds to the spans found before.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.llm.text import let, unused
from lodeworks.runtime import cut, ship, table

WINDOW = 10
SHARD_WORDS = 2_000_000
BLOCK_CHARS = 4_000_000
SAMPLE = 16
RANK_BLOCK = 64

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


class Windows:
    """The windows of a block of items: word numbers (from 1), distinct windows by length, and the items of each."""

    def __init__(self, items: list[tuple[str | None, str]], size: int) -> None:
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words((text or "").encode())]
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + size]), set()).update(() if item is None else (item,))
        self.by_length: dict[int, np.ndarray] = {}
        self.items: dict[int, list[tuple[str, ...]]] = {}
        for n in sorted({len(w) for w in found}):
            some = [w for w in found if len(w) == n]
            self.by_length[n] = np.array(some, dtype=np.int32)
            self.items[n] = [tuple(sorted(found[w])) for w in some]
        self.shortest = min(self.by_length, default=0)


class Wavelet:
    """Rank over a sequence of small numbers: one bit vector a level, most significant bit first, zeros moved left."""

    def __init__(self, seq: np.ndarray, top: int) -> None:
        self.bits = max(1, int(top).bit_length())
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for k in range(self.bits - 1, -1, -1):
            ones = (seq >> k & 1).astype(bool)
            packed = np.packbits(np.append(ones, np.zeros(-len(ones) % RANK_BLOCK + RANK_BLOCK, bool)), bitorder="little").view("<u8")
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            self.levels.append((packed, before, len(seq) - int(ones.sum())))
            seq = np.concatenate((seq[~ones], seq[ones]))

    @staticmethod
    def _ones(level: tuple[np.ndarray, np.ndarray, int], i: np.ndarray) -> np.ndarray:
        word, rest = i >> 6, (i & 63).astype(np.uint64)
        return level[1][word] + np.bitwise_count(level[0][word] & ((np.uint64(1) << rest) - np.uint64(1))).astype(np.int64)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol occurs before i."""
        start = np.zeros_like(i)
        for k, level in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            one = (symbol >> k & 1).astype(bool)
            a, b = self._ones(level, start), self._ones(level, i)
            start, i = np.where(one, level[2] + a, start - a), np.where(one, level[2] + b, i - b)
        return i - start

    def at(self, i: np.ndarray) -> np.ndarray:
        """The symbols at i."""
        out = np.zeros(len(i), np.int64)
        for level in self.levels:
            one = (level[0][i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self._ones(level, i)
            out, i = out * 2 + one, np.where(one, level[2] + ones, i - ones)
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling; zeros (separators) sort by position, so that no comparison runs past one."""
    n = len(seq)
    rank = seq.astype(np.int64)
    zeros = np.flatnonzero(seq == 0)
    rank[zeros] = np.arange(len(zeros))
    rank[seq > 0] += len(zeros)
    order, step = np.argsort(rank, kind="stable"), 1
    while True:
        ordered = rank[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        if new[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: n - step] = new[step:] + 1
        rank = new * (n + 1) + after
        order, step = np.argsort(rank, kind="stable"), step * 2


class FMIndex:
    """Backward search and locating over one sequence whose zeros are separators and whose last symbol is one."""

    def __init__(self, seq: np.ndarray) -> None:
        order = suffix_array(seq)
        last = seq[order - 1]
        self.tree = Wavelet(last.astype(np.int64), int(seq.max()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=int(seq.max()) + 2))))
        # a walk back must not pass a separator: what follows one is sampled too
        self.sampled = (order % SAMPLE == 0) | (last == 0)
        self.positions = order[self.sampled]
        self.nth = np.cumsum(self.sampled) - 1

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The phrases (one a row) that occur: their rows, and for each the range of suffixes."""
        who = np.arange(len(phrases))
        top = len(self.before) - 3  # the largest symbol there is: the tree has no bits for larger ones
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.before[-1], np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[who, k].astype(np.int64)
            ok = symbol <= top
            who, lo, hi, symbol = who[ok], lo[ok], hi[ok], symbol[ok]
            base = self.before[symbol]
            lo, hi = base + self.tree.rank(symbol, lo), base + self.tree.rank(symbol, hi)
            ok = lo < hi
            who, lo, hi = who[ok], lo[ok], hi[ok]
        return who, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps, open_ = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(open_):
            known = self.sampled[rows]
            out[open_[known]] = self.positions[self.nth[rows[known]]] + steps
            open_, rows = open_[~known], rows[~known]
            symbol = self.tree.at(rows)
            rows, steps = self.before[symbol] + self.tree.rank(symbol, rows), steps + 1
        return out


def search_shard(texts: list[list[bytes]], windows: Windows) -> tuple[list[np.ndarray], list[set[str]]]:
    """For each document of the shard: hit spans (start, end) in words, as found, and the items found."""
    spans: list[list[np.ndarray]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    sizes = np.array([len(t) for t in texts])
    ids = np.zeros(int(sizes.sum()) + len(texts) + 1, np.int32)  # a zero before each document, and one at the end
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1] + 1
    for at, t in zip(starts, texts, strict=True):
        ids[at : at + len(t)] = np.fromiter(map(windows.number.get, t, repeat(0)), np.int32, len(t))
    edge = np.flatnonzero(np.diff((ids > 0).astype(np.int8), prepend=0, append=0))
    runs = edge.reshape(-1, 2)
    runs = runs[runs[:, 1] - runs[:, 0] >= max(1, windows.shortest)]
    if windows.shortest and len(runs):
        length = runs[:, 1] - runs[:, 0] + 1  # with a separator
        where = np.repeat(runs[:, 0] - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
        seq = ids[where]
        seq[np.cumsum(length) - 1] = 0
        index = FMIndex(seq)
        for n, phrases in windows.by_length.items():
            who, lo, hi = index.search(phrases)
            if not len(who):
                continue
            count = hi - lo
            rows = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            found, phrase = where[index.locate(rows)], np.repeat(who, count)
            doc = np.searchsorted(starts, found, "right") - 1
            for d, at, p in zip(doc.tolist(), (found - starts[doc]).tolist(), phrase.tolist(), strict=True):
                spans[d].append((at, at + n))
                items[d].update(windows.items[n][p])
    return spans, items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def _pass(windows, shard_words: int, text: str, drop_text: bool, name: str):
    """A map over batches: adds to the spans and items in column `name` those of one block of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = windows.value
        for batch in batches:
            names = batch.schema.names
            column, at = batch.column(names.index(text)), 0
            while at < batch.num_rows:
                shard, size = [], 0
                while at + len(shard) < batch.num_rows and (not shard or size < shard_words):
                    value = column[at + len(shard)]
                    shard.append(words(value.as_buffer().to_pybytes()) if value.is_valid else [])
                    size += len(shard[-1])
                part = batch.slice(at, len(shard))
                spans, items = search_shard(shard, known)
                old = part.column(names.index(name)).to_pylist()
                rows = [
                    {"n_words": len(t), "spans": [list(x) for x in merge(s + [tuple(x) for x in (o or {}).get("spans", [])])], "items": sorted(i.union((o or {}).get("items", [])))}
                    for t, s, i, o in zip(shard, spans, items, old, strict=True)
                ]
                kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string()))])
                out = {n: pa.array(rows, kind) if n == name else part.column(k) for k, n in enumerate(names) if not (drop_text and n == text)}
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
                at += len(shard)

    return run


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_chars: int = BLOCK_CHARS, text: str = "text", item_id: str = "item_id", item_text: str = "text", drop_text: bool = False, name: str = "__hits") -> DataFrame:
    """docs with a struct `name`, which no column may have: n_words, merged spans of hit words, and the items found (as strings, sorted); without the text if drop_text."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{item_text}`").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the input already has {name}")
    out = docs.withColumn(name, F.lit(None).cast(HITS))
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        known = spark.sparkContext.broadcast(Windows([tuple(r) for r in block.toLocalIterator()], window))
        last = drop_text and k + 1 == n
        out = out.mapInArrow(_pass(known, shard_words, text, last, name), T.StructType([f for f in out.schema if not (last and f.name == text)]))
        if k + 1 < n:  # else a task would hold all blocks at once
            out = cut(out)
    return out


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), drop_text=True)
    n_hit = F.aggregate("__hits.spans", F.lit(0), lambda n, x: n + x[1] - x[0]).cast("long")
    items = F.col("__hits.items")
    out = out.select("doc_id", F.col("__hits.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs, the same columns, with every hit span cut out of the text, from its first word's start to its last word's end."""
    (name,) = unused(docs, "hits")
    found = hits(docs, benchmark, text=text, name=name, **options)
    spans = f"{name}.spans"
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # words, before letters are lower-cased
    some = F.size(spans) > 0
    # separators and words by turns: the k-th word stands between the k-th and the next separator
    apart, joined = F.split(F.col(f"`{text}`"), pattern, -1), F.regexp_extract_all(F.col(f"`{text}`"), F.lit(pattern), F.lit(0))
    hit = lambda i: F.exists(spans, lambda s: (s[0] <= i) & (i < s[1]))
    inside = lambda i: F.exists(spans, lambda s: (s[0] < i) & (i < s[1]))
    kept = lambda x: F.transform(x.a, lambda a, i: F.concat(F.when(inside(i), "").otherwise(a), F.when(hit(i), "").otherwise(F.coalesce(F.get(x.j, i), F.lit("")))))
    # bound once: inside the lambda the text would be split again for each of its words
    rest = let(F.struct(apart.alias("a"), joined.alias("j")), lambda x: F.array_join(kept(x), ""))
    clean = F.when(some, rest).otherwise(F.col(f"`{text}`"))
    return found.select(*(clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))


#: Two columns are read; windows and words are rows, joined on the window.
OP2_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), {WINDOW}) AS n, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS w
  FROM b, LATERAL (SELECT unnest(range(1, greatest(1, len(ws) - {WINDOW - 1}) + 1)) AS i) WHERE len(ws) > 0
), dw AS (
  SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w
  FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d), (SELECT DISTINCT n FROM bw) WHERE i + n - 1 <= len(ws)
), met AS (
  SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.w = bw.w AND dw.n = bw.n
), hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM met) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256 FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM met) GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
