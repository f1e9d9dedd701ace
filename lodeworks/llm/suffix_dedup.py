"""Suffix-array dedup: bytes covered by a string of `SPAN` bytes that also starts earlier are removed, across all documents.

Texts are UTF-8 bytes; a window is a string of SPAN bytes within a document; places are ordered by (doc_id, start).

1. Anchors. Of the grams within a window, the one with the least hash anchors it (the leftmost of equal ones), so equal windows have equal
   anchors. Neighbouring windows with one anchor form a run. Runs are dealt by their anchor's hash: a record of hashes and places, no text.
   Runs whose anchor occurs once hold no repeated window. Equal runs are kept once; the later ones are occurrences of the same suffixes, and wholly covered.
2. Enhanced suffix arrays. What remains are different runs that share an anchor. Their texts, dealt by anchor, form one suffix array a part, with
   longest common prefixes; a stack scan over these gives the tree of common-prefix intervals; an interval of SPAN bytes or more whose suffixes have different
   bytes before them is a maximal repeat, with all its occurrences, all of which but the first are covered for the interval's length.
3. The spans of a document are merged and cut out.

An anchor shared by more than MOST_RUNS different runs would load one task. Its runs' windows are dealt one by one, by their own
hash, each part's equal windows sent once; that gives the same spans by grouping.

Defined results. Null and empty texts have no bytes; shorter texts than SPAN no windows. A null doc_id orders after all others. Rows that share a
doc_id count as one document: places that are equal in both are equally early, and none removes the other. An empty table gives an empty result.
Other columns are not read. Texts are used whole; hashes have 64 bits and are taken as equal strings where no text is compared.

Scale: four shuffles: run records (about 30 bytes for 35 of text, less compressed), the texts twice by document, and the texts of undecided
runs. Parts are sized from the texts' total size, and each is handled by itself, so memory does not grow with the input. A task sends equal runs once, so that a passage
in a third of all documents costs each task one record; rows are dealt by a hash of id and text, so that equal ids or nulls spread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.runtime import cut, ship, table

SPAN = 100
GRAM = 32
MOST_RUNS = 2_000
PART_BYTES = 16 << 20
CHUNK = 1 << 20

_WINDOW = SPAN - GRAM + 1
_SEED = np.random.default_rng(20_240_601)
_OF_BYTE = _SEED.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RATIO = 0x9E3779B97F4A7C15
_INVERSE = pow(_RATIO, -1, 2**64)
_PLACE = np.uint64((1 << 28) - 1)
RUN, LATER, UNDECIDED, HOT, FLAG = range(5)
RECORD = [("h", "<u8"), ("f", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("p", "<u4"), ("n", "<i2"), ("kind", "i1")]
SPANS = [("row", "<i8"), ("p", "<i8"), ("n", "<i8")]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

Columns = dict[str, np.ndarray]


def pack(c: Columns, kinds: list[tuple[str, str]]) -> bytes:
    """Column after column, compressed: ids and places of one document stand together; only hashes keep their size."""
    return zstandard.compress(b"".join(np.ascontiguousarray(c[k], t).tobytes() for k, t in kinds), 1)


def unpack(blobs: list[bytes], kinds: list[tuple[str, str]]) -> Columns:
    width = sum(np.dtype(t).itemsize for _, t in kinds)
    parts: dict[str, list[np.ndarray]] = {k: [np.empty(0, t)] for k, t in kinds}
    for b in map(zstandard.decompress, blobs):
        n, at = len(b) // width, 0
        for k, t in kinds:
            parts[k].append(np.frombuffer(b, t, n, at))
            at += n * np.dtype(t).itemsize
    out = {k: np.concatenate(v) for k, v in parts.items()}
    return out | {"p": out["p"].astype(np.int64)}


def take(c: Columns, which: np.ndarray) -> Columns:
    return {k: v[which] for k, v in c.items()}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


class Hashes:
    """Hashes of any stretches of one byte string."""

    def __init__(self, raw: np.ndarray) -> None:
        n = 1 << max(10, len(raw).bit_length())
        if n not in _powers:
            _powers.clear()
            both = []
            for ratio in (_RATIO, _INVERSE):
                steps = np.full(n, ratio, np.uint64)
                steps[0] = 1
                both.append(np.multiply.accumulate(steps))
            _powers[n] = both[0], both[1]
        up, self.down = _powers[n]
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_OF_BYTE[raw] * up[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * self.down[start] + np.asarray(size).astype(np.uint64))


def runs(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers of windows, anchors' hashes and texts' hashes of the runs in texts that end at `ends`, one after another."""
    none = np.empty(0, np.int64)
    if len(raw) < SPAN:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    hashes = Hashes(raw)
    grams = hashes.of(np.arange(len(raw) - GRAM + 1), GRAM)
    least = grams & ~_PLACE | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size * 2 <= _WINDOW:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = _WINDOW - size
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    starts = np.concatenate(([0], ends[:-1]))
    inside = np.zeros(len(raw) + 1, np.int8)
    long = ends - starts >= SPAN
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - SPAN + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]))
    anchor = (least[at] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)))) if len(at) else none
    p, n = at[new], np.diff(np.append(new, len(at)))
    return p, n, grams[anchor[new]], hashes.of(p, n + SPAN - 1)


def _chunks(texts: list[bytes], chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts together, `chunk` bytes or so at a time, long ones in overlapping pieces: bytes, ends, text number and offset of each piece."""
    pieces, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - SPAN + 1), chunk):
            pieces.append((i, at, t[at : at + chunk + SPAN - 1]))
            size += len(pieces[-1][2])
            if size >= chunk:
                yield _joined(pieces)
                pieces, size = [], 0
    if pieces:
        yield _joined(pieces)


def _joined(pieces):
    return np.frombuffer(b"".join(x[2] for x in pieces), np.uint8), np.cumsum([len(x[2]) for x in pieces]), np.array([x[0] for x in pieces]), np.array([x[1] for x in pieces])


def _ranks(c: Columns) -> np.ndarray:
    """Places in order; equal ones have equal numbers."""
    order = np.lexsort((c["p"], c["doc"]))
    new = np.concatenate(([0], (np.diff(c["p"][order]) != 0) | (np.diff(c["doc"][order]) != 0)))[: len(order)]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _later(key: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, then rank; where a key begins; which rows are later than their key's first."""
    order = np.lexsort((rank, key))
    first = np.concatenate(([True], key[order][1:] != key[order][:-1]))[: len(order)]
    group = np.cumsum(first) - 1
    return order, first, rank[order] > rank[order][np.flatnonzero(first)][group]


def emit(c: Columns, part: np.ndarray, kinds) -> list[tuple[int, bytes]]:
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    return [(int(part[x[0]]), pack(take(c, x), kinds)) for x in np.split(order, cuts) if len(x)]


def _anchored(parts: int, most: int, chunk: int):
    """Batches of documents to records of their runs, dealt by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = [t.as_buffer().to_pybytes() for t in batch.column(2)]
            found = []
            for raw, ends, who, offset in _chunks(texts, chunk):
                p, n, h, f = runs(raw, ends)
                piece = np.searchsorted(ends, p, "right")
                begin = np.concatenate(([0], ends[:-1]))[piece]
                doc = who[piece]
                found.append({"h": h, "f": f, "doc": docs[doc], "row": rows[doc], "p": p - begin + offset[piece], "n": n, "kind": np.full(len(p), RUN, np.int8)})
            if not found:
                continue
            c = {k: np.concatenate([x[k] for x in found]) for k, _ in RECORD}
            order, first, later = _later(c["f"], _ranks(c))
            c = take(c, order)
            c["kind"][later] = LATER
            # an anchor with many different runs in this batch alone: they need no answer from elsewhere
            sent = np.flatnonzero(~later)
            by_h = sent[np.argsort(c["h"][sent], kind="stable")]
            new = np.concatenate(([True], np.diff(c["h"][by_h]) != 0))[: len(by_h)]
            many = np.diff(np.append(np.flatnonzero(new), len(by_h)))
            crowded = by_h[np.repeat(many > most, many)]
            c["kind"][crowded] = HOT
            flags = take(c, by_h[new][many > most])
            flags["kind"] = np.full(len(flags["kind"]), FLAG, np.int8)
            c = {k: np.concatenate((c[k], flags[k])) for k in c}
            spread = np.isin(c["kind"], (LATER, HOT))
            part = (np.where(spread, c["row"].view(np.uint64), c["h"]) % np.uint64(parts)).astype(np.int64)
            out = emit(c, part, RECORD)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["part", "blob"])

    return run


def _blobs(t: pa.Table) -> list[bytes]:
    return t.column("blob").to_pylist()


def _table(out: list[tuple], *columns: tuple[str, pa.DataType]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([x[i] for x in out], kind) for i, (_, kind) in enumerate(columns)], names=[c for c, _ in columns])


_TO = ("to", pa.int32()), ("blob", pa.binary())


def decide(parts: int, most: int):
    """What is known of a part's runs once all of an anchor's are together: later copies, and runs for the suffix arrays."""

    def run(t: pa.Table) -> pa.Table:
        c = unpack(_blobs(t), RECORD)
        known = take(c, np.isin(c["kind"], (LATER, HOT)))
        c = take(c, np.isin(c["kind"], (RUN, FLAG)))
        _, inverse, many = np.unique(c["h"], return_inverse=True, return_counts=True)
        c = take(c, many[inverse] > 1)
        flagged = np.isin(c["h"], c["h"][c["kind"] == FLAG])
        run = c["kind"] == RUN
        c, flagged = take(c, run), flagged[run]
        order, first, later = _later(c["f"], _ranks(c))
        c, flagged = take(c, order), flagged[order]
        _, inverse = np.unique(c["h"], return_inverse=True)
        texts = np.bincount(inverse, first, minlength=1)[inverse] if len(inverse) else np.empty(0)
        kind = np.full(len(c["h"]), RUN, np.int8)
        kind[(texts > 1)] = UNDECIDED
        kind[(texts > most) | flagged] = HOT
        kind[later] = LATER
        c["kind"] = kind
        c = take(c, kind != RUN)
        c = {k: np.concatenate((c[k], known[k])) for k in c}
        return _table(emit(c, c["row"] % parts, RECORD), *_TO)

    return run


def _fetch(parts: int):
    """The texts of undecided runs, dealt by anchor; the windows of crowded ones, dealt by their hashes."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        c = unpack(_blobs(found), RECORD)
        c = take(c, np.isin(c["kind"], (UNDECIDED, HOT)))
        out: list[tuple[int, bytes, bytes]] = []
        if len(c["h"]):
            place = {r: i for i, r in enumerate(docs.column("row").to_pylist())}
            text = docs.column("text").combine_chunks()
            order = np.argsort(c["row"], kind="stable")
            c = take(c, order)
            texts, windows = [b""] * len(order), []
            for at in np.split(np.arange(len(order)), np.flatnonzero(np.diff(c["row"])) + 1):
                i = place.get(int(c["row"][at[0]]))
                if i is None:
                    continue
                raw = text[i].as_buffer().to_pybytes()
                hot = at[c["kind"][at] == HOT]
                for k in at[c["kind"][at] == UNDECIDED].tolist():
                    p = int(c["p"][k])
                    texts[k] = raw[p : p + int(c["n"][k]) + SPAN - 1]
                if len(hot):
                    n = c["n"][hot].astype(np.int64)
                    p = np.repeat(c["p"][hot] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                    same = {k: np.full(len(p), c[k][at[0]]) for k in ("doc", "row")}
                    windows.append({"h": Hashes(np.frombuffer(raw, np.uint8)).of(p, SPAN), "f": np.zeros(len(p), np.uint64), "p": p, "n": np.ones(len(p), np.int16), "kind": np.full(len(p), HOT, np.int8), **same})
            some = np.flatnonzero(c["kind"] == UNDECIDED)
            part = (c["h"][some] % np.uint64(parts)).astype(np.int64)
            for k in np.unique(part).tolist():
                mine = some[part == k]
                out.append((k, pack(take(c, mine), RECORD), b"".join(texts[i] for i in mine.tolist())))
            if windows:
                w = {k: np.concatenate([x[k] for x in windows]) for k, _ in RECORD}
                order, _, later = _later(w["h"], _ranks(w))
                w = take(w, order)
                w["kind"][later] = LATER
                spread = np.where(later, w["row"].view(np.uint64), w["h"]) % np.uint64(parts)
                out += [(k, blob, b"") for k, blob in emit(w, spread.astype(np.int64), RECORD)]
        return _table(out, ("part", pa.int32()), ("blob", pa.binary()), ("texts", pa.binary()))

    return run


def _word_ranks(buffer: np.ndarray) -> dict[int, np.ndarray]:
    """Ranks of every place by its next 8, 16, 32, 64 bytes, by doubling."""
    n = len(buffer)
    padded = np.concatenate((buffer, np.zeros(512, np.uint8)))
    words = np.zeros(n + 504, np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | padded[k : k + n + 504].astype(np.uint64)
    rank, out = np.unique(words, return_inverse=True)[1].astype(np.int64), {}
    out[8] = rank
    for size in (8, 16, 32):
        after = np.concatenate((rank[size:], np.zeros(size, np.int64)))
        rank = np.unique(rank * (n + 505) + after, return_inverse=True)[1].astype(np.int64)
        out[size * 2] = rank
    return out


def maximal_repeats(buffer: np.ndarray, starts: np.ndarray, room: np.ndarray, before: np.ndarray, least: int = SPAN) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Suffixes in order (indexes of starts), and the maximal repeats as (length, from, to) in that order.

    room: how many bytes of a suffix are its own (168 at most are compared); before: the byte before it, or a number of its own. An interval whose suffixes all have one byte
    before them is left out: the interval one byte to the left holds it.
    """
    ranks = _word_ranks(buffer)
    at = lambda size, shift: ranks[size][starts + shift]
    order = np.lexsort((at(64, 108), at(64, 64), at(64, 0)))
    a, b = order[:-1], order[1:]
    near = np.flatnonzero((at(64, 0)[a] == at(64, 0)[b]) & (at(64, least - 64)[a] == at(64, least - 64)[b]) & (np.minimum(room[a], room[b]) >= least))
    prefix = np.zeros(len(order), np.int64)  # of each suffix with the one before it in order
    padded = np.concatenate((buffer, np.zeros(256, np.uint8)))
    for part in np.array_split(near, max(1, len(near) // 100_000)):
        i, j = starts[a[part]], starts[b[part]]
        more = np.arange(least, least + _WINDOW)
        same = padded[i[:, None] + more] == padded[j[:, None] + more]
        run = np.where(same.all(axis=1), _WINDOW, same.argmin(axis=1)) if len(part) else np.empty(0, np.int64)
        prefix[part + 1] = np.minimum(least + run, np.minimum(room[a[part]], room[b[part]]))
    out: list[tuple[int, int, int]] = []
    bytes_before = before[order]
    # diversity of an interval: the next place at which the byte before differs lies inside it
    change = np.flatnonzero(bytes_before[1:] != bytes_before[:-1]) + 1
    diverse = lambda lo, hi: (k := np.searchsorted(change, lo, "right")) < len(change) and change[k] <= hi
    blocks = np.split(near + 1, np.flatnonzero(np.diff(near) > 1) + 1) if len(near) else []
    for block in blocks:
        stack = [(0, int(block[0]) - 1)]
        for k, n in zip([*block.tolist(), int(block[-1]) + 1], [*prefix[block].tolist(), 0], strict=True):
            left = k - 1
            while stack[-1][0] > n:
                size, left = stack.pop()
                if diverse(left, k - 1):
                    out.append((size, left, k - 1))
            if n > stack[-1][0]:
                stack.append((n, left))
    return order, out


def repeats(parts: int):
    """Spans to remove, from a part's runs (suffix arrays) and windows (grouping)."""

    def run(t: pa.Table) -> pa.Table:
        out = []
        of_runs = [x for x in t.to_pylist() if x["texts"]]
        c = unpack([x["blob"] for x in of_runs], RECORD)
        if len(c["h"]):
            buffer = np.frombuffer(b"".join(x["texts"] for x in of_runs), np.uint8)
            n = c["n"].astype(np.int64)
            size = n + SPAN - 1
            base = np.concatenate(([0], np.cumsum(size)[:-1]))
            which = np.repeat(np.arange(len(n)), n)
            within = np.arange(n.sum()) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
            starts = base[which] + within
            before = np.where(within > 0, buffer[np.maximum(starts - 1, 0)].astype(np.int64), -1 - which)
            order, groups = maximal_repeats(buffer, starts, size[which] - within, before)
            place = {"doc": c["doc"][which], "p": c["p"][which] + within}
            rank = _ranks(place)[order]
            for length, a, b in groups:
                mine = np.arange(a, b + 1)
                mine = order[mine[rank[a : b + 1] > rank[a : b + 1].min()]]
                out.append({"row": c["row"][which[mine]], "p": place["p"][mine], "n": np.full(len(mine), length)})
        w = unpack([x["blob"] for x in t.to_pylist() if not x["texts"]], RECORD)
        if len(w["h"]):
            done, w = take(w, w["kind"] == LATER), take(w, w["kind"] == HOT)
            order, _, later = _later(w["h"], _ranks(w))
            w = take(w, order[later])
            for x in (done, w):
                out.append({"row": x["row"], "p": x["p"], "n": np.full(len(x["p"]), SPAN)})
        if not out:
            return _table([], *_TO)
        spans = {k: np.concatenate([x[k] for x in out]) for k in ("row", "p", "n")}
        return _table(emit(spans, spans["row"] % parts, SPANS), *_TO)

    return run


def _kept(size: int, p: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """Maximal removed stretches of a text."""
    depth = np.zeros(size + 1, np.int64)
    np.add.at(depth, p, 1)
    np.add.at(depth, p + n, -1)
    gone = np.cumsum(depth[:-1]) > 0
    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def finish(docs: pa.Table, found: pa.Table) -> pa.Table:
    """Each document of a part with its removed stretches, as doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = found.to_pylist()
    runs_ = unpack([x["blob"] for x in rows if x["whole"]], RECORD)
    runs_ = take(runs_, runs_["kind"] == LATER)
    spans = unpack([x["blob"] for x in rows if not x["whole"]], SPANS)
    row = np.concatenate((runs_["row"], spans["row"]))
    p, n = np.concatenate((runs_["p"], spans["p"])), np.concatenate((runs_["n"].astype(np.int64) + SPAN - 1, spans["n"]))
    order = np.argsort(row, kind="stable")
    row, p, n = row[order], p[order], n[order]
    out = []
    for doc, key, text in zip(docs.column("doc_id").to_pylist(), docs.column("row").to_pylist(), docs.column("text"), strict=True):
        raw = text.as_buffer().to_pybytes()
        a, b = np.searchsorted(row, (key, key + 1)) if key < 2**63 - 1 else (np.searchsorted(row, key), len(row))
        gone = _kept(len(raw), p[a:b], n[a:b]) if b > a else []
        at, digest = 0, hashlib.sha256()
        for x, y in gone:
            digest.update(raw[at:x])
            at = y
        digest.update(raw[at:])
        out.append((doc, len(raw), sum(y - x for x, y in gone), len(gone), digest.hexdigest()))
    return _table(out, ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()))


def deduped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES, most: int = MOST_RUNS, chunk: int = CHUNK) -> DataFrame:
    ship(docs.sparkSession)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), whole.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    key = F.xxhash64("doc_id", "text")
    rows = rows.select("doc_id", key.alias("row"), F.pmod(key, F.lit(parts)).cast("int").alias("to"), "text")
    order = F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc")
    dealt = rows.select(order, "row", "text").mapInArrow(_anchored(parts, most, chunk), "part int, blob binary")
    decided = cut(dealt.groupBy("part").applyInArrow(decide(parts, most), "to int, blob binary"))
    by_doc = rows.groupBy("to")
    fetched = by_doc.cogroup(decided.groupBy("to")).applyInArrow(_fetch(parts), "part int, blob binary, texts binary")
    spans = fetched.groupBy("part").applyInArrow(repeats(parts), "to int, blob binary")
    found = decided.withColumn("whole", F.lit(True)).unionByName(spans.withColumn("whole", F.lit(False)))
    return by_doc.cogroup(found.groupBy("to")).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(table(spark, sf_dir, "documents"))
