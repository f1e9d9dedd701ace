"""Cross-tokenizer alignment: which tokens of one tokenizer stand for which of another, and how well pairs agree corpus-wide.

A text, with a space in front, is encoded by a byte-level vocabulary (A) and by a piece vocabulary (B, which puts the space
there itself). All A and B tokens of many stretches of text are sorted by where their bytes start (one lexsort), the
running maximum of their ends is taken, and a group of tokens begins where a start reaches that maximum. Within a
group, overlaps expand: between each two neighbouring places where some token starts, one A and one B token share bytes, a link.

Neither tokenizer joins what a space parts that stands between two characters that are no white space: A splits there
first, and no piece of B has a space after another character (checked when the model is read). So a text falls into parts, each
with a space in front, and its tokens, groups and links are those of its parts, one after the other. Parts are worked out once and
remembered. A part of ASCII and Latin-1 letters and marks goes through the same vocabulary in its faster form (its ranks), the others through the
tokenizer itself; tests hold one against the other.

Links are counted corpus-wide: each task counts the parts it meets, then the id pairs of these, and the pairs are summed up. A link is
best if no A id is linked more often with its B id. For each document, links are looked up in the table of pairs: the most frequent pairs, at most
`head` of them, are broadcast; the links of the others are combined a document and meet the table in a join.

Defined results. Null and empty texts, and texts whose tokens' bytes, joined, are not the text with a space in front (U+2581
in a text), have no tokens: zeros, no groups, and their links count nowhere. Special tokens inside texts are plain text. Rows that share a doc_id or repeat are encoded
and counted one by one. Null ids pass like others. Ties for best: all of them. An empty table gives an empty result. Columns the
input has besides are kept by `aligned`; input that has one of the result's columns is refused.

Scale: two narrow maps over the texts and one small aggregate of pairs (51,000 x 32,000 at most, in practice some millions). What a worker remembers is bounded in bytes
and begun anew when full. Broadcast: `head` pairs of 17 bytes at most.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.llm.text import unused
from lodeworks.runtime import cut, ship, table

A_JSON, A_RANKS, B_MODEL = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Pairs that are broadcast at most.
HEAD = 1 << 20
#: Bytes that a worker remembers, what Python adds counted too; bytes of texts handled at once; pairs a task holds before it hands them on.
MEMORY, SLICE, PAIRS = 400 << 20, 4 << 20, 1 << 20
#: Parts that are encoded together, and what they may have: letters and marks of ASCII and Latin-1, and single line ends between those.
TOGETHER = 2_000
PLAIN = re.compile(r"[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+(?:\n[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+)*\Z")
CUT = re.compile(r"(?<=\S) (?=\S)")
SPACE = "▁"
_BITS = 32


def paths() -> tuple[str, str, str]:
    import public_tokenizers

    return tuple(map(public_tokenizers.path, (A_JSON, A_RANKS, B_MODEL)))


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if it can be seen, else 256 on, in order."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers over many parts at once. Ids come as one flat array with the number of ids of each part."""

    def __init__(self, a_json: str, a_ranks: str, b_model: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already use the cores
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_json)
        self.a.encode_special_tokens = True
        ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, Path(a_ranks).read_bytes().splitlines())}
        self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_model)
        byte_of = _byte_of()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for piece, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(map(byte_of.get, piece)) if all(c in byte_of for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece has a space after another character: texts do not fall into parts")
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))

    def encoded(self, parts: list[str]) -> tuple[list[str], list[np.ndarray], list[np.ndarray]]:
        """The parts in another order, and for A and B the ids of all of them, each with a space in front, one after the other, and how many each has.

        Plain parts are encoded together and told apart by their sizes.
        """
        plain, other = [], []
        for p in parts:
            (plain if PLAIN.match(p) else other).append(p)
        ids, counts = [[], []], [[], []]
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            text = " ".join(some)
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, some)), np.int64, len(some)) + 1)
            for side, found, size in ((0, self.quick.encode_ordinary(" " + text), self.a_size), (1, self.b.encode(text), self.b_size)):
                found = np.array(found, np.int64)
                cuts = np.searchsorted(np.cumsum(size[found]), ends) + 1
                ids[side].append(found)
                counts[side].append(np.diff(cuts, prepend=0))
        if other:
            for side, found in ((0, [e.ids for e in self.a.encode_batch_fast([" " + p for p in other], add_special_tokens=False)]), (1, self.b.encode(other, num_threads=1))):
                counts[side].append(np.fromiter(map(len, found), np.int64, len(other)))
                ids[side].append(np.fromiter(chain.from_iterable(found), np.int64, int(counts[side][-1].sum())))
        return plain + other, [np.concatenate(x) for x in ids], [np.concatenate(x) for x in counts]

    def same(self, raw: list[bytes], ids: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
        """Of each part, whether its tokens have its bytes."""
        sides, whole = [(self.a_bytes, ids[0], counts[0]), (self.b_bytes, ids[1], counts[1])], b"".join(raw)
        if all(b"".join(map(of.__getitem__, some.tolist())) == whole and np.array_equal(self._sizes(k, some, n), list(map(len, raw))) for k, (of, some, n) in enumerate(sides)):
            return np.ones(len(raw), bool)
        out = np.ones(len(raw), bool)
        for of, some, n in sides:
            at, tokens = 0, some.tolist()
            for k, size in enumerate(n.tolist()):
                out[k] &= b"".join(map(of.__getitem__, tokens[at : at + size])) == raw[k]
                at += size
        return out

    def _sizes(self, side: int, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum((self.a_size, self.b_size)[side][ids])))
        ends = np.cumsum(counts)
        return total[ends] - total[ends - counts]


def touching(part: str) -> bool:
    return not part or part[0].isspace() or part[-1].isspace()


def _joined(lists: pa.Array, counts: np.ndarray, between: str) -> pa.Array:
    """Strings, `counts` of them each time, with `between` between them."""
    offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, lists), between)


class Alignments:
    """What is known of parts: numbers of tokens, groups and links, the groups as text, the links as pairs of ids."""

    _one: dict[tuple, Alignments] = {}

    def __init__(self, paths: tuple[str, str, str], memory: int = MEMORY) -> None:
        self.tools, self.memory, self.round = Tokenizers(*paths), memory, 0
        self.clear()

    @classmethod
    def of(cls, paths: tuple[str, str, str], memory: int = MEMORY) -> Alignments:
        if (paths, memory) not in cls._one:
            cls._one[paths, memory] = cls(paths, memory)
        return cls._one[paths, memory]

    def clear(self) -> None:
        #: parts that spaces alone set apart, and those that have or touch other white space, which are found another way
        self.known: dict[str, int] = {}
        self.odd: dict[str, int] = {}
        self.groups: list[bytes] = []
        #: n_a, n_b, n_groups, n_links and whether the bytes are the part's, a row a part
        self.numbers = array("q")
        self.links, self.link_ends = array("q"), array("q", [0])
        self.held, self.round = 0, self.round + 1

    def trim(self) -> bool:
        """Begin anew if what is held is too much; numbers given out before are void then."""
        if self.held <= self.memory:
            return False
        self.clear()
        return True

    def numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the parts of all texts, one after the other, and how many parts each text has; what is not known yet is learnt, all at once."""
        parts = [t.split(" ") if t else [] for t in texts]
        while True:
            flat = list(chain.from_iterable(parts))
            counts = np.fromiter(map(len, parts), np.int64, len(parts))
            found = list(map(self.known.get, flat))
            if None not in found:
                return np.array(found, np.int64), counts
            missing = [i for i, x in enumerate(found) if x is None]
            new = {flat[i] for i in missing}
            touched = set(filter(touching, new))
            if not touched:
                self.learn(list(new))
                continue
            # texts in which a space stands beside other white space, where it parts nothing
            owner = np.searchsorted(np.cumsum(counts), [i for i in missing if flat[i] in touched], "right")
            odd = {k: CUT.split(texts[k]) for k in sorted(set(owner.tolist()))}
            self.learn(list({p for k, x in enumerate(parts) if k not in odd for p in x if p not in self.known}))
            self.learn(list({p for x in odd.values() for p in x if p not in self.known and p not in self.odd}))
            numbers = [[self.known[p] if p in self.known else self.odd[p] for p in odd[k]] if k in odd else [self.known[p] for p in x] for k, x in enumerate(parts)]
            return np.fromiter(chain.from_iterable(numbers), np.int64), np.fromiter(map(len, numbers), np.int64, len(numbers))

    def learn(self, parts: list[str]) -> None:
        if not parts:
            return
        parts, ids, (n_a, n_b) = self.tools.encoded(parts)
        raw = [b" " + p for p in map(str.encode, parts)]
        same = self.tools.same(raw, ids, [n_a, n_b])
        if not same.all():  # such a part has no tokens
            ids = [x[np.repeat(same, n)] for x, n in zip(ids, (n_a, n_b), strict=True)]
            n_a, n_b = n_a * same, n_b * same
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) * same
        part, side, number, begins, ends, group, first = coalesced(ids, (n_a, n_b), sizes, (self.tools.a_size, self.tools.b_size))
        # the groups as text: ids joined by commas, A then B, then group by group
        order = np.lexsort((np.arange(len(group)), side, group))
        per = np.bincount(group * 2 + side, minlength=2 * len(first))
        halves = _joined(pc.cast(pa.array(number[order]), pa.string()), per, ",")
        texts = pc.binary_join_element_wise(halves.take(pa.array(np.arange(0, len(halves), 2))), halves.take(pa.array(np.arange(1, len(halves), 2))), "|")
        n_groups = np.bincount(part[first], minlength=len(parts))
        groups = _joined(texts, n_groups, ";").cast(pa.binary()).to_pylist()
        links, n_links = linked(part, side, number, begins, len(parts))
        at = len(self.groups)
        for k, p in enumerate(parts, at):
            (self.odd if touching(p) else self.known)[p] = k
        self.groups += groups
        self.numbers.frombytes(np.stack((n_a, n_b, n_groups, n_links, same), axis=1).astype(np.int64).tobytes())
        self.links.frombytes(links.tobytes())
        self.link_ends.frombytes((np.cumsum(n_links) + self.link_ends[-1]).astype(np.int64).tobytes())
        self.held += sum(map(len, groups)) + 4 * int(sizes.sum()) + 8 * len(links) + 320 * len(parts)

    def table(self) -> np.ndarray:
        return np.frombuffer(self.numbers, np.int64).reshape(-1, 5).copy()

    def links_from(self, at: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of all parts from number `at` on, and how many each has."""
        ends = np.array(self.link_ends, np.int64)[at:]
        return np.array(self.links[ends[0] :], np.int64), np.diff(ends)


def coalesced(ids: list[np.ndarray], counts: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, token_sizes: tuple[np.ndarray, np.ndarray]) -> tuple:
    """All tokens of many parts sorted by where they start: part, side, id, start, end, group of each, and where groups begin.

    The parts lie one after the other, so that one lexsort and one running maximum do for all.
    """
    base = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
    columns = []
    for side in (0, 1):
        part = np.repeat(np.arange(len(sizes)), counts[side])
        width = token_sizes[side][ids[side]]
        ends = np.cumsum(width)  # a part's tokens have its bytes, and parts follow each other without gaps
        columns.append((part, np.full(len(part), side), ids[side], ends - width, ends))
    part, side, number, begins, ends = (np.concatenate(x) for x in zip(*columns, strict=True))
    order = np.lexsort((side, begins))
    part, side, number, begins, ends = (x[order] for x in (part, side, number, begins, ends))
    reached = np.maximum.accumulate(ends)
    new = np.concatenate(([True], begins[1:] >= reached[:-1])) if len(begins) else np.empty(0, bool)
    assert not len(begins) or reached[-1] == base[-1] + sizes[-1]
    return part, side, number, begins, ends, np.cumsum(new) - 1, np.flatnonzero(new)


def linked(part: np.ndarray, side: np.ndarray, number: np.ndarray, begins: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The id pairs (A << 32 | B) whose tokens overlap, one for each place where a token starts, and how many each part has.

    Tokens come sorted by start. After the tokens that start at a place, the last A and the last B token met are the ones there.
    """
    last = np.append(begins[1:] != begins[:-1], True) if len(begins) else np.empty(0, bool)
    at = np.arange(len(begins))
    newest = [np.maximum.accumulate(np.where(side == s, at, -1))[last] for s in (0, 1)]
    return number[newest[0]] << _BITS | number[newest[1]], np.bincount(part[last], minlength=n_parts)


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Where each slice begins, and its texts: some at once, SLICE bytes of them."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, "right")))
        yield at, [t or "" for t in texts.slice(at, to - at).to_pylist()]
        at = to


def _numbered(tool: Alignments, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The parts of all texts one after the other, and how many each has; none for a text with a part whose bytes differ."""
    places, counts = tool.numbered(texts)
    bad = tool.table()[:, 4] == 0
    if bad.any() and (hit := bad[places]).any():
        owner = np.repeat(np.arange(len(counts)), counts)
        out = np.isin(np.arange(len(counts)), owner[hit])
        return places[~out[owner]], np.where(out, 0, counts)
    return places, counts


def pair_counts(docs: DataFrame, paths: tuple[str, str, str], text: str = "text", memory: int = MEMORY) -> DataFrame:
    """pair (A id << 32 | B id), n: how many links of the corpus hold it."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Alignments.of(paths, memory)
        tool.trim()
        met, pairs, counts, waiting = np.zeros(0, np.int64), [], [], 0

        def taken() -> None:
            """From counts of parts to counts of their pairs."""
            nonlocal met, waiting
            if met.any():
                links, each = tool.links_from()
                times = np.repeat(met, each)
                keys, which = np.unique(links[times > 0], return_inverse=True)
                pairs.append(keys)
                counts.append(np.bincount(which, times[times > 0], len(keys)).astype(np.int64))
                waiting += len(keys)
            met = np.zeros(0, np.int64)

        def handed() -> pa.RecordBatch:
            nonlocal waiting
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate([*pairs, np.empty(0, np.int64)])), pa.array(np.concatenate([*counts, np.empty(0, np.int64)]))], names=["pair", "n"])
            pairs.clear()
            counts.clear()
            waiting = 0
            return out

        for batch in batches:
            for _, texts in _slices(batch.column(0)):
                places, _ = _numbered(tool, texts)
                met = np.concatenate((met, np.zeros(len(tool.groups) - len(met), np.int64))) + np.bincount(places, minlength=len(tool.groups))
                if tool.held > tool.memory:
                    taken()
                    tool.trim()
                if waiting > PAIRS:
                    yield handed()
        taken()
        yield handed()

    found = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "pair long, n long")
    return found.groupBy("pair").agg(F.sum("n").alias("n"))


def with_best(pairs: DataFrame) -> DataFrame:
    """pairs with best: whether no pair of the same B id has more links."""
    b = F.col("pair").bitwiseAND(F.lit((1 << _BITS) - 1))
    most = pairs.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return pairs.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))  # one row a B id: 32,000


def head_of(pairs: DataFrame, head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """pair (sorted), n and best of at most `head` pairs, the most frequent down to a power of two, and whether these are all."""
    sizes = {r["p"]: r["c"] for r in pairs.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("c")).collect()}  # a row a power of two
    least, total = 64, 0
    for p in sorted(sizes, reverse=True):
        if total + sizes[p] > head:
            break
        least, total = p, total + sizes[p]
    rows = pairs.where(F.floor(F.log2("n")) >= least).select("pair", "n", "best").toArrow().sort_by("pair")
    return *(rows[c].to_numpy() for c in ("pair", "n", "best")), total == sum(sizes.values())


_TAIL = T.ArrayType(T.StructType([T.StructField("pair", T.LongType()), T.StructField("times", T.LongType())]))
NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def among(keys: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each link is in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(links), np.int64), np.zeros(len(links), bool)
    at = np.minimum(np.searchsorted(keys, links), len(keys) - 1)
    return at, keys[at] == links


class _Scores:
    """n_best, count_sum and number of pairs outside the head, a row a part, kept in step with what is known of parts."""

    def __init__(self, tool: Alignments, head: tuple) -> None:
        self.tool, self.head, self.round, self.rows = tool, head, -1, np.zeros((0, 3), np.int64)

    def table(self) -> np.ndarray:
        if self.round != self.tool.round:
            self.round, self.rows = self.tool.round, np.zeros((0, 3), np.int64)
        if len(self.rows) < len(self.tool.groups):
            links, each = self.tool.links_from(len(self.rows))
            keys, n, best, _ = self.head
            at, there = among(keys, links)
            owner = np.repeat(np.arange(len(each)), each)
            sums = [np.bincount(owner[some], weights, len(each)) for some, weights in ((there, best[at[there]]), (there, n[at[there]]), (~there, None))]
            self.rows = np.concatenate((self.rows, np.stack(sums, axis=1).astype(np.int64)))
        return self.rows


def aligned(docs: DataFrame, paths: tuple[str, str, str], doc_id: str = "doc_id", text: str = "text", head: int = HEAD, memory: int = MEMORY, digest: bool = False, drop_text: bool = False) -> DataFrame:
    """docs with n_a, n_b, n_groups, n_links, n_best, count_sum and groups: `a1,a2|b1;a3|b2,b3`, ids of A and B group by group.

    digest: groups_sha256 in place of groups, its SHA-256 in hexadecimal ("" without tokens).
    """
    last = "groups_sha256" if digest else "groups"
    if clash := {*NUMBERS, last} & {c.lower() for c in docs.columns if not (drop_text and c == text)}:
        raise ValueError(f"the input already has {sorted(clash)}")
    spark = docs.sparkSession
    ship(spark)
    pairs = cut(with_best(pair_counts(docs, paths, text, memory)))
    found = head_of(pairs, head)
    sent, complete = spark.sparkContext.broadcast(found), found[3]
    hashed, tail = unused(docs, "hash", "tail")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Alignments.of(paths, memory)
        scores = _Scores(tool, sent.value)
        for batch in batches:
            names = batch.schema.names
            for at, texts in _slices(batch.column(names.index(text))):
                tool.trim()
                places, counts = _numbered(tool, texts)
                rows = np.concatenate((tool.table()[:, :4], scores.table()), axis=1)
                ends = np.cumsum(counts)
                sums = np.zeros((len(texts), 7), np.int64)
                some = counts > 0
                if some.any():
                    sums[some] = np.add.reduceat(rows[places], (ends - counts)[some], axis=0)
                joined, rest = [], []
                for a, b, missing in zip((ends - counts).tolist(), ends.tolist(), sums[:, 6].tolist(), strict=True):
                    groups = b";".join([tool.groups[i] for i in places[a:b].tolist()])
                    joined.append((hashlib.sha256(groups).hexdigest() if groups else "") if digest else groups.decode())
                    rest.append(_outside(tool, places[a:b], rows[:, 6], sent.value[0]) if missing else None)
                part = batch.slice(at, len(texts))
                old = {c: part.column(k) for k, c in enumerate(names) if not (drop_text and c == text)}
                new = [pa.array(sums[:, k]) for k in range(6)] + [pa.array(joined, pa.string())]
                more = [] if complete else [pa.array(rest, pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())])))]
                yield pa.RecordBatch.from_arrays([*old.values(), *new, *more], names=[*old, *NUMBERS, last, *([] if complete else [tail])])

    kinds = [f for f in docs.schema if not (drop_text and f.name == text)] + [T.StructField(c, T.LongType()) for c in NUMBERS] + [T.StructField(last, T.StringType())]
    if complete:
        return docs.mapInArrow(run, T.StructType(kinds))
    rows = docs.mapInArrow(run, T.StructType([*kinds, T.StructField(tail, _TAIL)]))
    # rows of one id and one row of groups have the same links
    rows = cut(rows.withColumn(hashed, F.xxhash64(F.col(last), F.col("n_a"), F.col("n_b"), F.col("n_links"))))
    key = F.col(f"`{doc_id}`")
    own = rows.where(F.col(tail).isNotNull()).select(key.alias("id"), F.col(hashed).alias("h"), tail).dropDuplicates(["id", "h"])
    met = own.select("id", "h", F.inline(tail)).join(pairs, "pair")
    more = met.groupBy("id", "h").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("times") * F.col("n")).alias("c"))
    i, h, b, c = unused(rows, "id", "h", "b", "c")
    more = more.withColumnsRenamed({"id": i, "h": h, "b": b, "c": c})
    out = rows.join(more, key.eqNullSafe(F.col(i)) & (F.col(hashed) == F.col(h)), "left")
    added = {"n_best": b, "count_sum": c}
    return out.select(*((F.col(f.name) + F.coalesce(F.col(added[f.name]), F.lit(0))).alias(f.name) if f.name in added else F.col(f"`{f.name}`") for f in kinds))


def _outside(tool: Alignments, places: np.ndarray, missing: np.ndarray, keys: np.ndarray) -> list[dict[str, int]]:
    """The pairs of a document's parts that are not among keys, each with how often it occurs."""
    some, times = np.unique(places[missing[places] > 0], return_counts=True)
    links = np.concatenate([np.array(tool.links[tool.link_ends[i] : tool.link_ends[i + 1]], np.int64) for i in some.tolist()])
    times = np.repeat(times, [tool.link_ends[i + 1] - tool.link_ends[i] for i in some.tolist()])
    _, there = among(keys, links)
    pairs, which = np.unique(links[~there], return_inverse=True)
    sums = np.bincount(which, times[~there], len(pairs)).astype(np.int64)
    return [{"pair": p, "times": n} for p, n in zip(pairs.tolist(), sums.tolist(), strict=True)]


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents").select("doc_id", "text"), paths(), digest=True, drop_text=True)
