"""Stored indexes for exact retrieval: a tree of vectors, inverted lists of vectors, and postings with block maxima.

Each has rows with an upper bound for all that is below or in them, so that a search leaves out what cannot be among the k
best and gives the same rows as ranking everything. Vectors are compared by cosine; with u the unit vector of a question,
c the centre of some unit vectors and r the largest distance from it, each of them has a cosine between u.c - r and u.c + r (a
vector of nought has the cosine nought, and is its own unit vector).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.functions import text as t
from lodeworks.functions.text import bound
from lodeworks.operators import retrieval as r
from lodeworks.operators.nearest import SLACK, matrix, nearest, units
from lodeworks.runtime import cut, few, written
from lodeworks.sources import store

#: Tasks that share the vectors of a scope in one list.
_BLOCKS = 4


def unit(v: Column) -> Column:
    return bound(F.sqrt(r.dot(v, v)), lambda size: F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(0.0)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def kth(rows: DataFrame, k: int, score: str, n: str | None = None) -> DataFrame:
    """query_id, least: the score below which nothing is among the k best, for questions that have k rows (or rows that stand for k, by n)."""
    best = r.top(rows.select("query_id", F.col(score).alias("score"), (F.lit(1) if n is None else F.col(n)).alias("n"), F.monotonically_increasing_id().alias("tie")), k, tie="tie")
    before = F.sum("n").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))  # k rows a question at most
    return best.withColumn("upto", before).where(F.col("upto") >= k).groupBy("query_id").agg(F.max("score").alias("least"))


def _write(rows: DataFrame, path: str, by: str, there: bool) -> None:
    """A folder for each value of `by`; a table without rows (not there) keeps its columns in a file without any."""
    rows = rows.write.option("compression", "zstd")
    (rows.partitionBy(by) if there else rows).parquet(path)


# A tree of vectors over the nodes of a document, in their order.


def vector_tree(vectors: DataFrame, fanout: int = r.FANOUT) -> DataFrame:
    """document_id, level, pos, centre, radius, n from document_id, node_seq, vector: leaves are level 0, each run of `fanout` has a parent.

    A parent's centre is the mean of the unit vectors of its leaves; its radius holds them all. One small aggregate a level.
    """
    level = cut(vectors.select("document_id", F.lit(0).alias("level"), (F.col("node_seq") - 1).cast("long").alias("pos"), unit(F.col("vector")).alias("centre"), F.lit(0.0).alias("radius"), F.lit(1).cast("long").alias("n")))
    out, last = level, level.agg(F.max("pos")).first()[0] or 0
    scaled = lambda v, by: F.transform(v, lambda x: x * by)
    while last > 0:
        last //= fanout
        wide = level.groupBy("document_id").agg(F.max("pos").alias("last")).where("last > 0").select("document_id")
        below = level.join(wide, "document_id").select("document_id", F.col("level") + 1, F.floor(F.col("pos") / fanout).alias("pos"), F.struct("pos", "centre", "radius", "n").alias("x"))
        below = below.toDF("document_id", "level", "pos", "x").groupBy("document_id", "level", "pos").agg(F.array_sort(F.collect_list("x")).alias("kids"), F.sum("x.n").alias("n"))
        total = F.aggregate(F.slice("kids", 2, fanout), scaled(F.col("kids")[0]["centre"], F.col("kids")[0]["n"]), lambda a, x: F.zip_with(a, x.centre, lambda p, q: p + q * x.n))
        below = below.withColumn("centre", bound(total, lambda v: F.transform(v, lambda x: x / F.col("n"))))
        reach = F.array_max(F.transform("kids", lambda x: distance(F.col("centre"), x.centre) + x.radius))
        level = cut(below.select("document_id", "level", "pos", "centre", reach.alias("radius"), "n"))
        out = out.unionByName(level)
    return out


def tree_leaves(asked: DataFrame, tree: DataFrame, k: int, fanout: int = r.FANOUT) -> DataFrame:
    """query_id, document_id, query_vector, pos: the leaves that can be among a question's k nearest.

    From the root down, all questions at once: of the children of what is held, those stay whose best possible cosine is not below one that k leaves are sure to have.
    """
    roots = tree.groupBy("document_id").agg(F.max("level").alias("level"))
    depth = roots.agg(F.max("level")).first()[0] or 0
    held = asked.join(roots, "document_id").select("query_id", "document_id", "query_vector", unit(F.col("query_vector")).alias("u"), "level", F.lit(0).cast("long").alias("pos"))
    for level in range(depth, 0, -1):  # a logarithm of the longest document
        here = held.where(F.col("level") == level).withColumn("parent", F.col("pos")).drop("level", "pos")
        children = tree.where(F.col("level") == level - 1).withColumn("parent", F.floor(F.col("pos") / fanout))
        met = here.join(children, ["document_id", "parent"]).withColumn("s", r.dot(F.col("u"), F.col("centre")))
        met = cut(met.select("query_id", "document_id", "query_vector", "u", "level", "pos", (F.col("s") - F.col("radius")).alias("lo"), (F.col("s") + F.col("radius")).alias("hi"), "n"))
        stay = met.join(kth(met, k, "lo", "n"), "query_id", "left").where(F.col("least").isNull() | (F.col("hi") >= F.col("least") - SLACK))
        held = held.where(F.col("level") < level).unionByName(stay.select("query_id", "document_id", "query_vector", "u", "level", "pos"))
    return held.select("query_id", "document_id", "query_vector", "pos")


def by_vector_tree(asked: DataFrame, tree: DataFrame, vectors: DataFrame, k: int, fanout: int = r.FANOUT) -> DataFrame:
    """Exact top k by cosine within the question's document, through the tree. asked: query_id, document_id, query_vector."""
    leaves = tree_leaves(asked, tree, k, fanout).withColumn("node_seq", (F.col("pos") + 1).cast("int")).drop("pos")
    near = F.round(r.cosine(F.col("query_vector"), F.col("vector")), 6) + 0.0
    return r.top(leaves.join(vectors, ["document_id", "node_seq"]).withColumn("score", near), k).select("query_id", "document_id", "rank", "node_seq", "score")


# Inverted lists of vectors.


def _constant(rows: list[list[float]]) -> Column:
    """A list of vectors as one constant."""
    return F.from_json(F.lit(str([list(map(float, v)) for v in rows])), "array<array<double>>")


def _listed(vectors: DataFrame, centres: list[list[float]], scope: str) -> DataFrame:
    """scope, node_seq, vector, list, far: the number of the centre that a vector's unit vector is nearest to, the first of equals, and how far that is."""
    given = np.array(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = units(matrix(batch["vector"], given.shape[1]))
            at = np.argmax(np.nan_to_num(u) @ given.T - (given * given).sum(1) / 2, axis=1)
            far = np.sqrt(((u - given[at]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(far)], [*batch.schema.names, "list", "far"])

    return vectors.select(scope, "node_seq", "vector").mapInArrow(run, _schema(vectors, scope) + ", list int, far double")


def _schema(rows: DataFrame, scope: str) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (scope, "node_seq", "vector"))


def _sums(placed: DataFrame, size: int) -> DataFrame:
    """list, n, sum: how many vectors a list has in a batch, and the sum of their unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, at = np.nan_to_num(units(matrix(batch["vector"], size))), batch["list"].to_numpy()
            lists, at = np.unique(at, return_inverse=True)
            sums = np.zeros((len(lists), size))
            np.add.at(sums, at, u)
            yield pa.RecordBatch.from_arrays([pa.array(lists), pa.array(np.bincount(at, minlength=len(lists))), pa.array(list(sums), pa.list_(pa.float64()))], ["list", "n", "sum"])

    return placed.select("list", "vector").mapInArrow(run, "list int, n long, sum array<double>")


def write_lists(vectors: DataFrame, root: str, scope: str = "document_id", lists: int = 16, rounds: int = 2) -> None:
    """Store vectors (scope, node_seq, vector) under root, a folder a list, and for each scope and list its size, centre and radius.

    Centres begin as the `lists` vectors that come first by hash, and move to the means of their lists `rounds` times; a
    search is exact whatever they are. Published at once: a reader sees the whole index or the one before.
    """
    spark, some = vectors.sparkSession, vectors.select(scope, "node_seq", "vector")
    first = some.orderBy(F.xxhash64("node_seq", F.col(scope)), F.col(scope), "node_seq").limit(lists).select(unit(F.col("vector")).alias("u"))
    centres = [row["u"] for row in first.collect()]  # `lists` rows at most
    there = bool(centres)
    centres = centres or [[0.0]]
    for _ in range(rounds if there else 0):
        size = len(centres[0])
        sums = _sums(_listed(some, centres, scope), size).groupBy("list").agg(F.sum("n").alias("n"), *(F.sum(F.get("sum", F.lit(i))).alias(f"m{i}") for i in range(size)))
        for row in sums.collect():  # a row a list
            centres[row["list"]] = [x / row["n"] for x in list(row)[2:]]
    given = _constant(centres)
    placed = cut(_listed(some, centres, scope))
    sizes = placed.groupBy(scope, "list").agg(F.count("*").alias("n"), F.max("far").alias("radius")).withColumn("centre", F.get(given, F.col("list")))
    with store.publishing(spark, root) as aside:
        _write(placed.drop("far").repartition("list", F.pmod(F.xxhash64("node_seq"), F.lit(8))), f"{aside}/vectors", "list", there)
        sizes.write.parquet(f"{aside}/lists")


def _in_lists(asked: DataFrame, pairs: DataFrame, stored: DataFrame, scope: str, k: int | None = None) -> DataFrame:
    """query_id, scope, node_seq, score of the vectors, the k best of each at least, in the lists that pairs (query_id, list) name; folders of no such list are not read."""
    wanted = [row["list"] for row in pairs.select("list").distinct().collect()]  # as many as there are lists
    met = few(pairs).join(asked, "query_id").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(_BLOCKS - 1))))
    stored = stored.where(F.col("list").isin(wanted)).withColumn("block", F.pmod(F.xxhash64("node_seq"), F.lit(_BLOCKS)).cast("int"))
    return nearest(met, stored, k, (scope, "list", "block")).select("query_id", scope, "node_seq", (F.round("score", 6) + 0.0).alias("score"))


def in_lists(asked: DataFrame, root: str, k: int, scope: str = "document_id") -> DataFrame:
    """The rows of retrieval.by_vector from a stored index: first the nearest lists that have k vectors, then those that could hold a nearer one than the k-th found."""
    stored, sizes = (store.published(asked.sparkSession, root, name) for name in ("vectors", "lists"))
    asked = asked.select("query_id", scope, "query_vector")
    near = asked.withColumn("u", unit(F.col("query_vector"))).join(sizes, scope).withColumn("s", r.dot(F.col("u"), F.col("centre")))
    near = cut(near.select("query_id", "list", "s", (F.col("s") + F.col("radius")).alias("hi"), "n"))
    order = Window.partitionBy("query_id").orderBy(F.col("s").desc(), "list")  # a row a list
    placed = cut(near.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    found = cut(_in_lists(asked, placed.where(F.col("before") < k), stored, scope, k))
    more = placed.where(F.col("before") >= k).join(kth(found, k, "score"), "query_id").where(F.col("hi") >= F.col("least") - SLACK)
    return r.top(found.unionByName(_in_lists(asked, cut(more.select("query_id", "list")), stored, scope, k)), k).select("query_id", scope, "rank", "node_seq", "score")


# Postings with block maxima.


#: What is stored of a term and some nodes that follow each other.
POSTINGS = "part int, document_id {}, block long, term string, idf double, avgdl double, most double, list array<struct<node_seq: int, tf: int, dl: int>>"


def _counted(batch: pa.RecordBatch, block: int, smoothed: bool) -> pa.RecordBatch:
    """POSTINGS of all nodes of some documents. batch: part, document_id, node_seq, tokens, in this order."""
    part, document, seq, tokens = batch.columns
    seq = seq.to_numpy()
    own = np.cumsum(np.isin(np.arange(len(seq)), _changes(document)))
    n = np.bincount(own)
    dl = tokens.value_lengths()
    avgdl = np.bincount(own, dl.fill_null(0).to_numpy()) / np.maximum(1, np.bincount(own, dl.is_valid().to_numpy(zero_copy_only=False)))
    dl = dl.fill_null(0).to_numpy()
    words = tokens.flatten().dictionary_encode()
    order = pc.sort_indices(words.dictionary).to_numpy()
    names, codes = words.dictionary.take(pa.array(order)), np.argsort(order)[words.indices.to_numpy()]
    node = np.repeat(np.arange(len(seq)), dl)
    term, node = np.divmod(np.sort((own[node] * len(names) + codes) * len(seq) + node), len(seq))  # by document, term and node
    first = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(node, prepend=-1))
    tf, term, node = np.diff(first, append=len(term)), term[first], node[first]
    here = np.diff(term, prepend=-1) != 0  # where a term of a document begins
    df, of = np.diff(np.flatnonzero(here), append=len(term)), own[node[here]]
    raw = np.log(n[of] - df + 0.5) - np.log(df + 0.5)
    if smoothed:
        idf = np.log(1 + (n[of] - df + 0.5) / (df + 0.5))
    else:
        idf = np.where(raw < 0, r.EPSILON * (np.bincount(of, raw, len(n)) / np.maximum(1, np.bincount(of, minlength=len(n))))[of], raw)
    idf, at = idf[np.cumsum(here) - 1], (seq[node] - 1) // block
    impact = idf * tf * (r.K1 + 1) / (tf + r.K1 * (1 - r.B + r.B * dl[node] / avgdl[own[node]]))
    begins = np.flatnonzero(here | (np.diff(at, prepend=-1) != 0))
    lists = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (seq[node], tf, dl[node])], ["node_seq", "tf", "dl"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(node)).astype(np.int32)), lists)
    rows, most = pa.array(node[begins]), np.maximum.reduceat(impact, begins) if len(begins) else impact
    out = [part.take(rows), document.take(rows), pa.array(at[begins].astype(np.int64)), names.take(pa.array(term[begins] % max(1, len(names)))), pa.array(idf[begins]), pa.array(avgdl[own[node[begins]]]), pa.array(most), lists]
    return pa.RecordBatch.from_arrays(out, ["part", "document_id", "block", "term", "idf", "avgdl", "most", "list"])


def _changes(ids: pa.Array) -> np.ndarray:
    """Places of values that differ from the one before."""
    codes = ids.dictionary_encode().indices.fill_null(-1).to_numpy()
    return np.flatnonzero(codes[1:] != codes[:-1]) + 1


def stored_postings(nodes: DataFrame, block: int, part: Column, smoothed: bool = False) -> DataFrame:
    """POSTINGS of nodes: of each term of a document and `block` nodes that follow each other, which have it how often, and the most it adds to a score there.

    A document is its own corpus, so its nodes meet in one shuffle, of texts, and are counted where they are, as many documents at once as
    an Arrow batch has; words never leave their task. part: a function of document_id.
    """
    dealt = nodes.select(part.alias("part"), "document_id", "node_seq", "content").repartition("document_id").sortWithinPartitions("part", "document_id", "node_seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the document that the last batch ended in
        for batch in batches:
            held.append(batch)
            if len(ends := _changes(pa.concat_arrays([x["document_id"][-1:] for x in held[-2:-1]] + [batch["document_id"]]))):
                at = int(ends[-1]) - (len(held) > 1)
                yield _counted(pa.concat_batches([*held[:-1], batch[:at]]), block, smoothed)
                held = [batch[at:]]
        if held:
            yield _counted(pa.concat_batches(held), block, smoothed)

    return dealt.select("part", "document_id", "node_seq", t.tokens(F.col("content")).alias("tokens")).mapInArrow(run, POSTINGS.format(nodes.schema["document_id"].dataType.simpleString()))


def write_postings(nodes: DataFrame, root: str, block: int = 64, parts: int = 16, smoothed: bool = False) -> None:
    """Store what BM25 needs of nodes (document_id, node_id, node_seq, content) under root, in `parts` folders by document.

    A row of `postings` has what gives the impacts of one term in the `block` nodes that follow each other, and the largest of them; a
    reader of the maxima alone does not read the lists. `nodes` has the nodes of each block.
    """
    part = F.pmod(F.xxhash64("document_id"), F.lit(parts)).cast("int").alias("part")
    there = not nodes.isEmpty()
    with store.publishing(nodes.sparkSession, root) as aside:
        _write(stored_postings(nodes, block, part, smoothed), f"{aside}/postings", "part", there)
        _write(nodes.select("document_id", F.floor((F.col("node_seq") - 1) / block).alias("block"), "node_seq", "node_id", F.lit(parts).alias("parts"), part), f"{aside}/nodes", "part", there)


def _blocks_scored(pairs: DataFrame, terms: DataFrame, postings: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, document_id, node_seq, node_id, score of all nodes in the blocks that pairs (query_id, document_id, block) name."""
    pairs = few(pairs)
    lists = postings.join(terms, ["document_id", "term"]).join(pairs, ["query_id", "document_id", "block"]).select("query_id", "document_id", "qf", "idf", "avgdl", F.inline("list"))
    sums = lists.groupBy("query_id", "document_id", "node_seq").agg(F.sum(F.col("qf") * r.impact()).alias("sum"))
    every = nodes.join(pairs, ["document_id", "block"]).join(sums, ["query_id", "document_id", "node_seq"], "left")
    return every.select("query_id", "document_id", "node_seq", "node_id", (F.round(F.coalesce("sum", F.lit(0.0)), 6) + 0.0).alias("score"))


def block_bounds(asked: DataFrame, root: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """query_id, document_id, block, n, hi: for each block of a question's document what its nodes score at most; with the question's terms, and the stored postings and nodes of such documents' folders."""
    spark = asked.sparkSession
    postings, nodes = (store.published(spark, root, name) for name in ("postings", "nodes"))
    first = nodes.select("parts").first()
    parts = first["parts"] if first else 1
    part = F.pmod(F.xxhash64("document_id"), F.lit(parts)).cast("int")
    wanted = [row["part"] for row in asked.select(part.alias("part")).distinct().collect()]  # as many as there are folders
    documents = few(asked.select("document_id").distinct())  # of what is stored, little is met in the joins that follow
    postings, nodes = (x.where(F.col("part").isin(wanted)).join(documents, "document_id", "left_semi") for x in (postings, nodes))
    terms = cut(asked.select("query_id", "document_id", F.explode(t.tokens(F.col("query_text"))).alias("term")).groupBy("query_id", "document_id", "term").agg(F.count("*").alias("qf")))
    most = postings.select("document_id", "block", "term", "most").join(few(terms), ["document_id", "term"])
    most = most.groupBy("query_id", "document_id", "block").agg(F.sum(F.col("qf") * F.greatest("most", F.lit(0.0))).alias("hi"))
    blocks = nodes.groupBy("document_id", "block").agg(F.count("*").alias("n"))
    every = asked.select("query_id", "document_id").join(blocks, "document_id").join(most, ["query_id", "document_id", "block"], "left")
    return cut(every.select("query_id", "document_id", "block", "n", F.coalesce("hi", F.lit(0.0)).alias("hi"))), terms, postings, nodes


def chosen_blocks(bounds: DataFrame, k: int) -> DataFrame:
    """The blocks to score first: for each question the k with the highest bounds, as each of them may have but one of the best."""
    return r.top(bounds.withColumn("score", F.col("hi")), k, tie="block").select("query_id", "document_id", "block")


def in_postings(asked: DataFrame, root: str, k: int) -> DataFrame:
    """The rows of retrieval.bm25 from stored postings: blocks whose bound is below the k-th score found so far are never scored."""
    bounds, terms, postings, nodes = block_bounds(asked, root)
    postings, nodes = written(postings), written(nodes)  # of the documents asked about, read once
    first = cut(chosen_blocks(bounds, k))
    found = cut(_blocks_scored(first, terms, postings, nodes))
    more = cut(later_blocks(bounds, first, found, k))
    return r.top(found.unionByName(_blocks_scored(more, terms, postings, nodes)), k).select("query_id", "document_id", "rank", "node_id", "node_seq", "score")


def later_blocks(bounds: DataFrame, first: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Of the blocks not scored yet, those that could hold one of the k best."""
    rest = bounds.join(first, ["query_id", "document_id", "block"], "left_anti").join(kth(found, k, "score"), "query_id", "left")
    return rest.where(F.col("least").isNull() | (F.col("hi") >= F.col("least") - SLACK)).select("query_id", "document_id", "block")
