"""Periodic runs: stretches of a text that repeat the same words over and over.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of at least max(`least`,
`times` * q) words that no neighbouring word extends with that period. Runs are found by their Lyndon roots: every run has a
place i where its root is the longest Lyndon word that begins at i, in the order of the words' numbers or in the reverse
order. That word ends before the next place whose suffix is smaller, so each order gives one candidate root [i, j) a place. A
candidate is extended to both sides by longest common extensions: of the suffixes at i and j forwards, and of the same places
backwards. Both come from a suffix tree (Ukkonen's construction, online, with suffix links), one of the words and one of
their reversal, as the depth of a lowest common ancestor, which is the least depth on the Euler tour between two leaves and
is looked up in constant time (least depths of blocks in a sparse table, of block ends as running minima).

Trees are built where runs can be. In a run of four periods or more each three consecutive words come three times or
more, so a place whose three words come less often in its stretch is in no run, and parts the text into stretches. Counting
again within these parts them further. This is exact for `times` of 4 or more and `least` of 6 or more, which are required. What is left is put end to
end, words of different stretches kept apart, so that a tree has some thousand words or one long stretch.

Words: `[^\\x20\\x09-\\x0D]+`. A collapsed text has all words but those that some run has after its first q, with one space between them.

Defined results. A null or empty text, or one of white space only, has no words, no runs and an empty collapsed text. Null ids pass
like others. Ties for the longest run: the smallest start, then the smallest period. Repeated rows are judged one by one; an
empty table gives an empty result. Columns the input has besides pass untouched; input that has one of the result's columns is refused.

Scale: a narrow map, no shuffle; rows go through in slices of bounded bytes. A tree takes about 400 bytes a word of the
longest stretch that repeats itself, not of the text, and is dropped with the slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.llm.text import let, unused, words
from lodeworks.runtime import ship, table

LEAST, TIMES = 6, 4
#: Bytes of texts handled at once, and words of short stretches that share a tree.
SLICE, TOGETHER = 4 << 20, 8_192
#: Rounds of counting; more would only make trees smaller.
ROUNDS = 12
_BLOCK = 16


class SuffixTree:
    """The suffix tree of a list of numbers that ends with one that occurs nowhere else and is the smallest.

    extension(a, b): how many numbers the suffixes at a and b have in common at their beginning, for arrays of places.
    rank and rank_reversed: each suffix's place in the order of the numbers, and in the reverse order (the end is the smallest in both).
    """

    def __init__(self, numbers: list[int]) -> None:
        self.n = len(numbers)
        start, end, edges, leaf_of = self._grown(numbers)
        self._toured(numbers, start, end, edges, leaf_of)

    @staticmethod
    def _grown(numbers: list[int]) -> tuple[list[int], list[int], dict[int, int], list[int]]:
        """Ukkonen's construction. Edges by parent and first number; a leaf's edge runs to the end. Leaves come in the order of their suffixes."""
        n, wide = len(numbers), max(numbers) + 1
        start, end, link, edges, leaves = [0], [0], [0], {}, []
        node = edge = length = waiting = 0
        for i, number in enumerate(numbers):
            waiting += 1
            unlinked = 0
            while waiting:
                if not length:
                    edge = i
                key = node * wide + numbers[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    leaves.append(len(start))
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    first, size = start[child], min(end[child], i + 1) - start[child]
                    if length >= size:
                        node, edge, length = child, edge + size, length - size
                        continue
                    if numbers[first + length] == number:
                        if unlinked:
                            link[unlinked] = node
                        length += 1
                        break
                    middle = len(start)
                    leaves.append(middle + 1)
                    start += (first, i)
                    end += (first + length, n)
                    link += (0, 0)
                    edges[key] = middle
                    start[child] = first + length
                    edges[middle * wide + numbers[first + length]] = child
                    edges[middle * wide + number] = middle + 1
                    if unlinked:
                        link[unlinked] = middle
                    unlinked = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        return start, end, edges, leaves

    def _toured(self, numbers: list[int], start: list[int], end: list[int], edges: dict[int, int], leaves: list[int]) -> None:
        wide, n_nodes = max(numbers) + 1, len(start)
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)  # by parent, then by first number
        children = np.fromiter(edges.values(), np.int64, len(edges))[order].tolist()
        bounds = np.searchsorted(keys[order] // wide, np.arange(n_nodes + 1)).tolist()
        suffix = dict(zip(leaves, range(self.n), strict=True))
        depth, tour, first, sequence = [0] * n_nodes, [0], [0] * self.n, []
        path, at = [0], bounds[:-1]
        while path:  # the Euler tour: a node's depth on arrival and after each child
            node = path[-1]
            k = at[node]
            if k == bounds[node + 1]:
                path.pop()
                if path:
                    tour.append(depth[path[-1]])
                continue
            at[node] = k + 1
            child = children[k]
            size = depth[node] + end[child] - start[child]
            if bounds[child] == bounds[child + 1]:
                place = suffix[child]
                first[place] = len(tour)
                sequence.append(place)
                tour += (size, depth[node])
            else:
                depth[child] = size
                tour.append(size)
                path.append(child)
        self.first, self.rank, self.rank_reversed = np.array(first), np.empty(self.n, np.int64), np.empty(self.n, np.int64)
        self.rank[sequence] = np.arange(self.n)
        self._indexed(np.array(tour, np.int32))
        # the reverse order: the same tour with each node's children from the last to the first, but the end before them
        backwards, path, stop = [], [0], numbers[-1]
        while path:
            node = path.pop()
            a, b = bounds[node], bounds[node + 1]
            if a == b:
                backwards.append(suffix[node])
            elif numbers[start[children[a]]] == stop:
                path += children[a + 1 : b]
                path.append(children[a])
            else:
                path += children[a:b]
        self.rank_reversed[backwards] = np.arange(self.n)

    def _indexed(self, tour: np.ndarray) -> None:
        blocks = -(-len(tour) // _BLOCK)
        self.tour = np.full(blocks * _BLOCK, np.iinfo(np.int32).max, np.int32)
        self.tour[: len(tour)] = tour
        grid = self.tour.reshape(blocks, _BLOCK)
        self.upto = np.minimum.accumulate(grid, axis=1).ravel()
        self.after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [grid.min(axis=1)]
        while 2 << len(self.table) - 1 <= blocks:
            last, half = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(last[:-half], last[half:]))

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        lo, hi = np.minimum(self.first[a], self.first[b]), np.maximum(self.first[a], self.first[b])
        low, high = lo // _BLOCK, hi // _BLOCK
        out = np.minimum(self.after[lo], self.upto[hi])
        wide = high - low - 1
        level = np.zeros(len(lo), np.int64)
        some = wide > 0
        level[some] = np.frexp(wide[some].astype(float))[1] - 1
        for k in np.unique(level[some]):
            at = np.flatnonzero(some & (level == k))
            t = self.table[k]
            out[at] = np.minimum(out[at], np.minimum(t[low[at] + 1], t[high[at] - (1 << int(k))]))
        same = np.flatnonzero(low == high)
        if len(same):
            x, y = lo[same], hi[same]
            least = self.tour[x]
            for step in range(1, _BLOCK):
                least = np.minimum(least, self.tour[np.minimum(x + step, y)])
            out[same] = least
        return out


def next_smaller(rank: list[int]) -> list[int]:
    """For each place the next one of smaller rank."""
    out, stack = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def runs_of(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """start, end and period of every run of at least max(least, times * period) numbers (times: 2 or more), by start, then period."""
    n = len(codes)
    if n < least:
        return np.empty((0, 3), np.int64)
    dense = np.unique(codes, return_inverse=True)[1] + 1
    forward, backward = SuffixTree([*dense.tolist(), 0]), SuffixTree([*dense[::-1].tolist(), 0])
    found = []
    for rank in (forward.rank, forward.rank_reversed):
        i, j = np.arange(n), np.array(next_smaller(rank.tolist()))[:n]
        ends = j + forward.extension(i, j)
        starts = i - backward.extension(n - i, n - j)  # the place before x is n - x in the reversal; n is its end
        period = j - i
        long = ends - starts >= np.maximum(least, times * period)
        found.append(np.stack((starts, ends, period), axis=1)[long])
    every = np.unique(np.concatenate(found), axis=0)
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def stretches(codes: np.ndarray, owner: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Parts [a, b) of codes, each of one owner, that hold every run of at least `least` numbers and four periods."""
    n = len(codes)
    if n < least:
        return []
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    three = mixed[:-2] * np.uint64(0xBF58476D1CE4E5B9) + mixed[1:-1] * np.uint64(0x94D049BB133111EB) + mixed[2:]
    good, part = owner[:-2] == owner[2:], owner[:-2].astype(np.uint64)
    at = np.flatnonzero(good)  # beginnings of three words of one part
    part = part[at]
    for k in range(ROUNDS):
        keys = three[at] ^ (part * np.uint64(0xD6E8FEB86659FD93))
        keys = (keys ^ keys >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        if k == 0:  # equal keys fall together, and some others: what is kept is counted again
            bits = np.uint64(64 - max(12, int(len(at)).bit_length() + 1))
            slots = (keys >> bits).astype(np.int64)
            often = np.bincount(slots)[slots] >= 3
        else:
            _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
            often = counts[which] >= 3
        kept, was = at[often], part[often]
        # a run's three-word places follow each other, least - 2 of them or more
        head = np.concatenate(([True], (np.diff(kept) > 1) | (was[1:] != was[:-1]))) if len(kept) else np.empty(0, bool)
        number = np.cumsum(head) - 1
        big = np.bincount(number)[number] >= least - 2 if len(kept) else head
        ended = k > 0 and len(kept) == len(at) and big.all()
        at, part = kept[big], number[big].astype(np.uint64)
        if ended or not len(at):
            break
    if not len(at):
        return []
    heads = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    return list(zip(at[heads].tolist(), (at[np.append(heads[1:], len(at)) - 1] + 3).tolist(), strict=True))


def runs_in_parts(codes: np.ndarray, parts: list[tuple[int, int]], least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """runs_of for each of some parts of codes; short parts share a tree, with a number of its own after each."""
    found, own = [np.empty((0, 3), np.int64)], int(codes.max(initial=0)) + 1
    k = 0
    while k < len(parts):
        pieces, places, size = [], [], 0
        while k < len(parts) and (not pieces or size + parts[k][1] - parts[k][0] < TOGETHER):
            a, b = parts[k]
            pieces += (codes[a:b], [own + k])
            places.append(np.arange(a, b + 1))
            size += b - a + 1
            k += 1
        runs = runs_of(np.concatenate(pieces), least, times)
        place = np.concatenate(places)
        runs[:, 0], runs[:, 1] = place[runs[:, 0]], place[runs[:, 1] - 1] + 1
        found.append(runs)
    return np.concatenate(found)


def _slices(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the batch, as many at once as have SLICE bytes, one at least."""
    at, total = 0, np.concatenate(([0], np.cumsum(sizes)))
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + SLICE, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts as numbers that are equal for equal words, and where each text's begin and end."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    real = pc.greater(pc.binary_length(flat), 0)
    bounds = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))[offsets - offsets[0]]
    return flat.filter(real).dictionary_encode().indices.to_numpy().astype(np.int64), bounds


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
COLUMNS = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]


def with_runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES, drop_text: bool = False) -> DataFrame:
    """docs with n_words, runs (start, length and period in words, by start, then period) and collapsed, the text without repetitions."""
    if least < 6 or times < 4:
        raise ValueError("runs of fewer than six words or four periods are not looked for")
    if clash := {f.name for f in COLUMNS} & {c.lower() for c in docs.columns if not (drop_text and c == text)}:
        raise ValueError(f"the input already has {sorted(clash)}")
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            column = names.index(text)
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
            for part in _slices(batch, sizes):
                new = judged(part.column(column), least, times)
                old = {c: part.column(k) for k, c in enumerate(names) if not (drop_text and c == text)}
                yield pa.RecordBatch.from_arrays([*old.values(), *new], names=[*old, *(f.name for f in COLUMNS)])

    return docs.mapInArrow(run, T.StructType([f for f in docs.schema if not (drop_text and f.name == text)] + COLUMNS))


def judged(texts: pa.Array, least: int = LEAST, times: int = TIMES) -> list[pa.Array]:
    """The three new columns."""
    codes, bounds = _words(texts)
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(counts)), counts)
    runs = runs_in_parts(codes, stretches(codes, owner, least), least, times)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    of = owner[runs[:, 0]] if len(runs) else np.empty(0, np.int64)
    n_runs = np.bincount(of, minlength=len(counts))
    dropped = np.zeros(len(codes) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 1], -1)
    kept = np.cumsum(dropped)[:-1] == 0
    collapsed = []
    for k, t in enumerate(texts):
        own = t.as_buffer().to_pybytes().split() if t.is_valid else []
        if n_runs[k]:
            own = [own[i] for i in np.flatnonzero(kept[bounds[k] : bounds[k + 1]]).tolist()]
        collapsed.append(b" ".join(own))
    fields = [pa.array(x, pa.int64()) for x in (runs[:, 0] - bounds[of], runs[:, 1] - runs[:, 0], runs[:, 2])]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_runs))).astype(np.int32)), pa.StructArray.from_arrays(fields, names=RUN.names))
    return [pa.array(counts.astype(np.int64)), lists, pa.array(collapsed, pa.binary()).cast(pa.string())]


def planted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs in which one document of ten repeats itself to its end: with h = crc32 of the id's digits, g = h // 10 and n words, if h
    divides by ten, each word i from a = g % n on becomes word a + (i - a) % p, where p = 1 + (n - a) // (3 + g % 8). No id: as it is."""
    h, i = unused(docs, "h", "g")
    g, whole = F.col(f"`{i}`"), F.col(f"`{text}`")

    def changed(w):
        a, n = g % F.size(w), F.size(w)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n == 0, whole).otherwise(F.array_join(F.transform(w, lambda x, at: F.when(at < a, x).otherwise(F.get(w, (a + (at - a) % p).cast("int")))), " "))

    out = docs.withColumn(h, F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary"))).withColumn(i, F.floor(F.col(f"`{h}`") / 10))
    new = F.when(F.col(f"`{h}`") % 10 == 0, let(words(whole), changed)).otherwise(whole)
    return out.select(*((new if c == text else F.col(f"`{c}`")).alias(c) for c in docs.columns))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")), drop_text=True)
    longest = F.get(F.array_sort("runs", lambda x, y: F.when(x.length != y.length, F.sign(y.length - x.length)).when(x.start != y.start, F.sign(x.start - y.start)).otherwise(F.sign(x.period - y.period)).cast("int")), F.lit(0))
    out = out.withColumn("longest", longest)
    line = lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))
    best = [F.col("longest")[c].alias(c) for c in RUN.names]
    milli = F.floor(1000 * F.col("longest")["length"] / F.col("longest")["period"]).alias("exponent_milli")
    runs = F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli, runs, F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
