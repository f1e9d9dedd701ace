"""SimHash near-dedup: fingerprints linked through deletion-variant signatures, then connected components.

A fingerprint has 64 bits: bit b is 1 if it is set in over half of the XXH64 hashes (seed 42) of the text's shingles. To
link fingerprints that differ in at most `bits` = 2 bits, it is cut into two segments of 32 bits: of two such fingerprints,
one segment differs in one bit at most (of two that differ in three bits, too, so `bits` may be 3). Each segment is indexed 32 times, with one bit left out each time; fingerprints
meet in an equality join on (segment, bit left out, the other bits), are verified by their distance, and one meeting
place, the same for both, reports the link. Only distinct fingerprints take part, so exact copies cost one row a copy, not
one a pair. Components spread the smallest document id along links, hooking roots to smaller roots, then jumping.

Texts that are `least` per cent alike by their shingle sets (`one_of_each(least=80)`) are mostly further apart than three bits, and segments
short enough to find them would fill up with the square of the corpus. Such pairs are found by the sets themselves
(`alike`): equal bands of minimal hashes make candidates, and every link is verified on the whole sets. BANDS bands of ROWS
hashes miss a pair at 0.8 with a chance of 3e-7, one that is more alike with less. In a band, texts are compared with the
one that has most neighbours, which links the copies of one original without comparing the copies with each other; bands in
which several components are left go on, without that one, and after `rounds` rounds the texts of different components that are
left in a band are compared, each pair once, if they can be alike at all: shingles that only one of these texts has count against it. A
loose group of copies, each with changes of its own, makes no pairs by that, though all of its texts meet.

Words: `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; `size`-word shingles, repeats included; a text with fewer
words is one shingle, one with none has fingerprint zero and is linked like any other, but is alike to none by sets.

Defined results. Null and empty texts have fingerprint zero. A null doc_id takes no part in the smallest id of its
component; a component of nulls only has a null id; `one_of_each` keeps rows without an id, as it could not name the one that stays. Repeated rows are rows of one component.
Of rows with the smallest id of their component, `one_of_each` keeps those of one text (the least by hash), of these the first as JSON. An empty table gives an
empty result. Texts are used whole. Columns the input has besides are kept by `one_of_each`, whatever their names.

Scale: one narrow pass over the texts; from then on 8-byte fingerprints, keys and ids, and of texts that share a band their sets. Groups by fingerprint are combined
before their shuffle. A variant table has 64 rows for each distinct fingerprint, whatever the number of copies. A
fingerprint has at most 2,080 others within two bits (43,744 within three), so links cannot grow with the square of a group. The skew-join
splitting of Spark's adaptive execution splits a signature that many share. Tables that grow with the corpus are joined by sorting and never broadcast: Spark
takes exploded rows for as many as before, so it broadcast 64 variants of each fingerprint where it saw one. What is broadcast is checked to be few rows. Lineage is cut by checkpoints in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm.text import UPPER
from lodeworks.runtime import cut, is_small, ship, sorted_side, table

SIZE = 3
BITS = 2
SEED = 42
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_CHUNK = 65_536  # hashes whose bits are counted at once
BANDS, ROWS = 50, 6
#: Rounds in which a band's texts meet the one with most neighbours, before all pairs that are left do.
HUB_ROUNDS = 1
#: Rows that may be broadcast, two or three numbers each, and shingle hashes: 380,000 such rows took a driver over 300 MB.
MAX_BROADCAST, MAX_HASHES = 100_000, 500_000
#: Rows of a graph in each task that spreads its components, and how many tasks a small graph gets.
GRAPH_ROWS, GRAPH_TASKS = 100_000, 8
_SEED = np.random.default_rng(11)
_FLIP, _TIMES = _SEED.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32), _SEED.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(text: bytes, size: int = SIZE) -> np.ndarray:
    """The hash of each shingle, in the text's order."""
    words = text.translate(_LOWER).split()
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([digest(joined, SEED)] if words else [], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], "<u8")


def fingerprint(text: bytes, size: int = SIZE) -> int:
    return _majority(shingles(text, size))


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        counts += np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def minima(distinct: np.ndarray) -> np.ndarray:
    """The least value of each of BANDS * ROWS hashes over a set of shingle hashes."""
    low = (distinct ^ distinct >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for i in range(0, len(low), 512):
        np.minimum(out, ((low[i : i + 512, None] ^ _FLIP) * _TIMES).min(axis=0), out=out)
    return out


def bands(many: np.ndarray) -> np.ndarray:
    """One key a band from the minima of many sets (sets by BANDS * ROWS)."""
    parts = many.reshape(len(many), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        out = (out ^ out >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k]
    return out ^ out >> np.uint64(32)


def fingerprints(docs: DataFrame, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """__id and __fp (the 64 bits as a long) of each row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_buffer().to_pybytes(), size) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["__id", "__fp"])

    ids = docs.select(F.col(f"`{doc_id}`").cast("long").alias("__id"), F.col(f"`{text}`").alias("__text"))
    return ids.mapInArrow(run, "__id long, __fp long")


def _longs(x) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def marked(docs: DataFrame, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """__id, __key (a hash of the text), __fp, n (distinct shingles) and bands (none where n is 0) of each row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fps, sizes, least = [], [], []
                for t in part.column(2):
                    found = shingles(t.as_buffer().to_pybytes(), size) if t.is_valid else np.empty(0, "<u8")
                    fps.append(_majority(found))
                    found = np.unique(found)
                    sizes.append(len(found))
                    least.append(minima(found))
                n = np.array(sizes)
                keys = bands(np.array(least))[n > 0].ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum((n > 0) * BANDS))).astype(np.int32)), _longs(keys))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _longs(fps), pa.array(n), lists], names=["__id", "__key", "__fp", "n", "bands"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("__id"), F.xxhash64(F.col(f"`{text}`")).alias("__key"), F.col(f"`{text}`").alias("__text"))
    return rows.mapInArrow(run, "__id long, __key long, __fp long, n long, bands array<long>")


def shingle_sets(texts: DataFrame, size: int = SIZE) -> DataFrame:
    """__key and set (the distinct shingle hashes) of texts (__key, __text)."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.unique(shingles(t.as_buffer().to_pybytes(), size)).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["__key", "set"])

    return texts.where("__text IS NOT NULL").mapInArrow(run, "__key long, set array<long>")


def _few(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if they are few; read twice, so cut them first."""
    return F.broadcast(rows) if is_small(rows, MAX_BROADCAST) else sorted_side(rows)


def alike(marks: DataFrame, texts: DataFrame, edges: DataFrame, least: int, size: int = SIZE, rounds: int = HUB_ROUNDS) -> DataFrame:
    """edges (a, b: fingerprints) and links of texts whose shingle sets have `least` per cent of their union in common.

    marks: from `marked`, cut; texts: __key, __text. Texts that edges connect already are not compared.
    """
    one = marks.where("n > 0").dropDuplicates(["__key"]).select("__key", "__fp", "n", F.explode("bands").alias("band"))
    met = one.groupBy("band").agg(F.count("*").alias("c")).where("c > 1")
    shared = cut(one.join(sorted_side(met), "band"))
    degree = shared.groupBy("__key").agg(F.sum("c").alias("degree"))
    shared = cut(shared.drop("c").join(sorted_side(degree), "__key"))
    some = _few(cut(shared.select("__key").distinct()))
    sets = cut(shingle_sets(texts.join(some, "__key", "left_semi"), size).dropDuplicates(["__key"]))
    own = [F.col(c) for c in ("band", "__key", "__fp", "n", "degree")]
    near = lambda n, m: 100 * F.least(n, m) >= least * F.greatest(n, m)

    def homed(rows: DataFrame) -> DataFrame:
        roots = components(edges).withColumnsRenamed({"node": "__node", "root": "__root"})
        return rows.join(sorted_side(roots), F.col("__fp") == F.col("__node"), "left").select(*own, F.coalesce("__root", "__fp").alias("home"))

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """pairs: ka, a, kb, b (keys and fingerprints)."""
        few = (sets.agg(F.sum(F.size("set"))).first()[0] or 0) <= MAX_HASHES
        side = lambda x: (F.broadcast if few else sorted_side)(sets.select(F.col("__key").alias(f"k{x}"), F.col("set").alias(f"s{x}")))
        both = pairs.join(side("a"), "ka").join(side("b"), "kb").withColumn("common", F.size(F.array_intersect("sa", "sb")))
        return both.where(100 * F.col("common") >= least * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")

    for _ in range(rounds):  # bands with one component are settled
        shared = cut(homed(shared))
        hub = F.max_by(F.struct("__key", "__fp", "n", "home"), F.struct("degree", "__key"))
        groups = shared.groupBy("band").agg(F.min("home").alias("lo"), F.max("home").alias("hi"), hub.alias("hub")).where("lo <> hi").select("band", "hub")
        against = cut(shared.join(sorted_side(groups), "band").where(F.col("__key") != F.col("hub.__key")))
        pairs = against.where((F.col("home") != F.col("hub.home")) & near(F.col("n"), F.col("hub.n")))
        pairs = pairs.select(F.col("__key").alias("ka"), F.col("__fp").alias("a"), F.col("hub.__key").alias("kb"), F.col("hub.__fp").alias("b")).distinct()
        found = cut(verified(pairs, sets))
        edges = cut(edges.unionByName(found))
        shared = against.select(*own)  # without the hubs, whose pairs are all done
        if not shared.limit(1).count():
            return edges
    shared = cut(homed(shared))
    left = shared.groupBy("band").agg(F.min("home").alias("lo"), F.max("home").alias("hi")).where("lo <> hi").select("band")
    shared = shared.join(sorted_side(left), "band")
    lists = cut(shared.groupBy("__key").agg(F.collect_set("band").alias("bands")))
    sets = cut(sets.join(sorted_side(lists.select("__key")), "__key", "left_semi"))
    # shingles that no other of these texts has are in no intersection: what is left of a text bounds how alike it can be to any of them
    alone = sets.select("__key", F.explode("set").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("__key").alias("__key")).where("c = 1").groupBy("__key").agg(F.count("*").alias("alone"))
    bounded = lists.join(sorted_side(alone), "__key", "left").select("__key", "bands", F.coalesce("alone", F.lit(0)).alias("alone"))
    shared = shared.join(sorted_side(bounded), "__key").withColumn("most", F.col("n") - F.col("alone")).drop("alone")
    shared = cut(shared.where(100 * F.col("most") >= least * F.col("n")))
    a, b = shared.alias("x"), shared.alias("y")
    common = F.least("x.most", "y.most")
    close = 100 * common >= least * (F.col("x.n") + F.col("y.n") - common)
    apart = (F.col("x.__key") < F.col("y.__key")) & (F.col("x.home") != F.col("y.home")) & close
    first = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.band")  # a pair meets in one of its bands
    pairs = a.join(sorted_side(b), (F.col("x.band") == F.col("y.band")) & apart & first)
    found = verified(pairs.select(F.col("x.__key").alias("ka"), F.col("x.__fp").alias("a"), F.col("y.__key").alias("kb"), F.col("y.__fp").alias("b")), sets)
    return cut(edges.unionByName(found))


def _halves(fp: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """a, b: distinct fingerprints, a < b, that differ in `bits` bits at most. fps: __fp, distinct."""
    if not 0 < bits <= 3:
        raise ValueError("two segments find fingerprints that differ in one to three bits")
    high, low = _halves(F.col("__fp"))
    one = lambda half, seg: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: F.struct(F.lit(seg).alias("seg"), j.alias("out"), half.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), j))).alias("rest")))
    variants = fps.select("__fp", F.inline(F.concat(one(high, 0), one(low, 1))))
    a, b = variants.alias("a"), variants.alias("b")
    apart = F.col("a.__fp").bitwiseXOR(F.col("b.__fp"))
    high, low = _halves(apart)
    # where both meet: the first segment that differs in one bit at most, at that bit, or at bit 0 if it is the same
    bit = lambda half: F.when(half == 0, 0).otherwise(F.bit_count(half - 1))
    place = F.when(F.bit_count(high) <= 1, (F.col("a.seg") == 0) & (F.col("a.out") == bit(high))).otherwise((F.col("a.seg") == 1) & (F.col("a.out") == bit(low)))
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("seg", "out", "rest")]
    met = a.join(sorted_side(b), on[0] & on[1] & on[2] & (F.col("a.__fp") < F.col("b.__fp")) & (F.bit_count(apart) <= bits) & place)
    return met.select(F.col("a.__fp").alias("a"), F.col("b.__fp").alias("b"))


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, root: the smallest node of the component of every node that has an edge. edges: a, b.

    Each round leaves several shuffles and checkpoints behind; of a small graph they are in few files, however many partitions a shuffle has.
    """
    pairs = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("x"))
    both = pairs.select("x.*")
    both = cut(both.union(both.select("node", F.col("node").alias("other"))).distinct())  # each node is next to itself, too
    tasks = max(GRAPH_TASKS, both.count() // GRAPH_ROWS)
    both = both.coalesce(tasks)
    label = both.groupBy("node").agg(F.min("other").alias("root")).coalesce(tasks)
    for _ in range(most_rounds):
        # the smallest label next to a node goes to the node and to its root (hook), then labels take their label's (jump)
        near = both.join(sorted_side(label.withColumnsRenamed({"node": "other", "root": "theirs"})), "other")
        best = near.groupBy("node").agg(F.min("theirs").alias("best"), F.max(F.when(F.col("node") == F.col("other"), F.col("theirs"))).alias("root"))
        best = cut(best.coalesce(tasks))
        changed = best.where("best < root").limit(1).count()
        if not changed:
            return best.select("node", "root")
        hook = best.where("best < root").groupBy(F.col("root").alias("node")).agg(F.min("best").alias("hooked"))
        new = best.join(sorted_side(hook), "node", "left").select("node", F.least("best", F.coalesce("hooked", "best")).alias("root"))
        up = new.select(F.col("node").alias("root"), F.col("root").alias("up"))
        label = cut(new.join(sorted_side(up), "root").select("node", F.col("up").alias("root")).coalesce(tasks))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def labelled(prints: DataFrame, bits: int = BITS, further=None) -> DataFrame:
    """prints (__id, __fp) with component, the smallest id reachable over links. prints is read several times: cut it first.

    further: a function that adds to the links between fingerprints (a, b).
    """
    groups = prints.groupBy("__fp").agg(F.min("__id").alias("least"))
    edges = cut(links(groups.select("__fp"), bits))
    roots = components(edges if further is None else further(edges))
    # the root is the smallest fingerprint, which names the component; its id is the smallest of its fingerprints'
    ids = roots.join(sorted_side(groups), roots["node"] == groups["__fp"]).groupBy("root").agg(F.min("least").alias("linked"))
    named = roots.join(sorted_side(ids), "root").select(F.col("node").alias("__fp"), "linked")
    every = groups.join(sorted_side(named), "__fp", "left").select("__fp", F.coalesce("linked", "least").alias("component"))
    return prints.join(sorted_side(every), "__fp", "left")


def one_of_each(docs: DataFrame, size: int = SIZE, bits: int = BITS, doc_id: str = "doc_id", text: str = "text", least: int | None = None) -> DataFrame:
    """docs, the same columns, with one row of each component, of its smallest id; rows without an id stay.

    least: also link texts whose shingle sets have that many per cent of their union in common.
    """
    key, whole = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    some = docs.where(key.isNotNull())
    marks = cut(marked(some, size, doc_id, text))
    texts = some.select(F.xxhash64(whole).alias("__key"), whole.alias("__text"))
    further = (lambda edges: alike(marks, texts, edges, least, size)) if least else None
    found = cut(labelled(marks.select("__id", "__key", "__fp"), bits, further).select("__id", "__key", "component"))
    first = found.where("__id = component")
    several = first.groupBy("component").agg(F.min("__key").alias("lo"), F.max("__key").alias("hi")).where("lo <> hi")
    others = first.join(sorted_side(several), "component").where("__key <> lo").select("__id", "__key")
    gone = _few(cut(found.where("__id <> component").select("__id", "__key").union(others).distinct()))
    same = (F.col(f"d.`{doc_id}`").cast("long") == F.col("g.__id")) & (F.xxhash64(F.col(f"d.`{text}`")) == F.col("g.__key"))
    docs = docs.alias("d").join(gone.alias("g"), same, "left_anti")
    if not first.groupBy("__id", "__key").count().where("count > 1").limit(1).count():
        return docs
    # rows of one id and one text are copies too
    whole_row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = docs.where(key.isNotNull()).select(key.alias("k"), F.xxhash64(whole).alias("h"), whole_row.alias("row")).groupBy("k", "h").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return docs.where(key.isNull()).unionByName(one.select("row.*"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = cut(fingerprints(table(spark, sf_dir, "documents")))
    out = labelled(prints)
    return out.select(F.col("__id").alias("doc_id"), F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
