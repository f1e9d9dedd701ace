"""Ranking the nodes of a question's own document: BM25, vectors, both, and a summary tree.

Every retriever takes questions with their document_id and never leaves that document: the scope is a join key, so only
documents that are asked about are scored. A ranked list is long: query_id, rank, node_id, score. Equal scores are in
node order. Ranks are worked out once, for the largest K; smaller K are filters on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions import text as t
from lodeworks.functions.text import bound
from lodeworks.operators.nearest import nearest
from lodeworks.runtime import cut, few

K1, B, EPSILON = 1.5, 0.75, 0.25
FANOUT = 10


def top(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), tie: str = "node_seq") -> DataFrame:
    """The k best rows of each group with their rank; Spark limits each group before it shuffles."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Bits of the filter that keeps words of the corpus from leaving their task.
_FILTER_BITS = 1 << 20


def _keys(text: Column, n: int, begins=None) -> Column:
    """Hashes of all runs of three words (n = 0) whose first word's hash begins lets through, or of n characters, of a text."""
    size = n or 3
    parts = F.split(text, "" if n else " ", -1)
    every = lambda p: F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(p) - size + 1))
    places = every if n else lambda p: F.filter(every(p), lambda i: begins(F.xxhash64(F.get(p, i - 1))))
    return bound(parts, lambda p: F.transform(places(p), lambda i: F.xxhash64(F.lit(n), F.array_join(F.slice(p, i, size), "" if n else " "))))


def _filter(keys: DataFrame) -> Column:
    """A condition on a hash, made of the hashes in keys: true for all of them and for few others. A bit array of fixed size, as one constant."""
    bit = F.pmod(F.xxhash64("key"), F.lit(_FILTER_BITS))
    rows = keys.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int"))).alias("bits")).collect()  # _FILTER_BITS / 64 rows at most
    words = ["0"] * (_FILTER_BITS >> 6)
    for row in rows:
        words[row["word"]] = str(row["bits"])
    array = F.split(F.lit(",".join(words)), ",").cast("array<bigint>")

    def there(h: Column) -> Column:
        at = F.pmod(F.xxhash64(h), F.lit(_FILTER_BITS))
        return F.call_function("shiftright", F.get(array, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

    return there


def ground_truth(nodes: DataFrame, benchmark: DataFrame) -> DataFrame:
    """query_id (item_id), query_text, document_id, node_id, node_seq: nodes that an item of the benchmark runs over.

    An item's lines, without white space at their ends and without empty ones, are looked for as they would be nodes: an item of
    one line within a node; one of several lines where a node ends with the first, the next ones are the lines between, and the
    node after those begins with the last. Nothing of an item is left out.

    Nodes and items meet in an equality join on one key an item. It is made of three whole words within the item's longest line, the longest there
    are, as those are the rarest; for a line with too few words for that (short ones, and languages written without spaces) of the
    middle of it: 1, 2, 4, 8 or 16 characters, as many as it has. Nodes give the hashes of their keys that a bit array of
    fixed size lets through, so what leaves a task grows with what is found, not with the words of the corpus. Then
    every line of an item is compared with the node in its place.
    """
    lines = F.filter(F.transform(F.split("text", "\n", -1), t.strip), lambda x: x != "")
    items = benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"), lines.alias("lines")).where("size(lines) > 0")
    items = cut(items.withColumn("at", F.array_position(F.transform("lines", F.length), F.array_max(F.transform("lines", F.length))).cast("int") - 1))
    line = F.get("lines", F.col("at"))
    words, length = F.split(line, " ", -1), F.length(line)
    few_ = F.when(length >= 16, 16).when(length >= 8, 8).when(length >= 4, 4).when(length >= 2, 2).otherwise(1)
    middle = F.substring(line, F.floor((length - F.col("kind")) / 2).cast("int") + 1, F.col("kind"))
    threes = bound(words, lambda w: F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(w) - 3)), lambda i: F.array_join(F.slice(w, i, 3), " ")))
    three = F.array_max(F.transform(threes, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))["x"]
    keyed = items.withColumn("kind", F.when(F.size(words) >= 5, 0).otherwise(few_))
    keyed = cut(keyed.withColumn("key", F.xxhash64("kind", F.when(F.col("kind") == 0, three).otherwise(middle))).withColumn("word", F.when(F.col("kind") == 0, F.xxhash64(F.substring_index(three, " ", 1)))).select("query_id", "query_text", "lines", "at", "kind", "key", "word"))
    kinds = [row["kind"] for row in keyed.select("kind").distinct().collect()]  # six rows at most
    if not kinds:
        return nodes.limit(0).select(F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("query_id"), F.lit("").alias("query_text"), "document_id", "node_id", "node_seq")
    there, begins = _filter(keyed.select("key")), _filter(keyed.where("kind = 0").select(F.col("word").alias("key")))
    found = nodes.select("document_id", "node_seq", F.explode(F.array_distinct(F.filter(F.concat(*(_keys(F.col("content"), n, begins) for n in kinds)), there))).alias("key"))
    met = found.join(few(keyed.select("query_id", "key", "lines", "at"), 10_000), "key").select("document_id", (F.col("node_seq") - F.col("at")).alias("start"), "query_id", "lines")
    parts = met.select("document_id", "start", "query_id", F.size("lines").alias("n"), F.posexplode("lines").alias("i", "line"))
    parts = cut(parts.select(F.col("document_id").alias("of"), "start", "query_id", "n", "i", "line", (F.col("start") + F.col("i")).alias("seq")).distinct())
    some = nodes.join(few(parts.select("of").distinct()), F.col("document_id").eqNullSafe(F.col("of")), "left_semi")  # contents of other documents are met by nothing
    same = F.when(F.col("n") == 1, F.col("content").contains(F.col("line"))).when(F.col("i") == 0, F.col("content").endswith(F.col("line"))).when(F.col("i") == F.col("n") - 1, F.col("content").startswith(F.col("line"))).otherwise(F.col("content") == F.col("line"))
    held = some.join(few(parts, 20_000), F.col("document_id").eqNullSafe(F.col("of")) & (F.col("node_seq") == F.col("seq")) & same)
    held = cut(held.select("query_id", "document_id", "start", "n", "node_id", "node_seq").distinct())
    whole = held.groupBy("query_id", "document_id", "start", "n").agg(F.count("*").alias("c")).where("c = n").select("query_id", F.col("document_id").alias("of"), "start")
    out = held.alias("h").join(whole.alias("w"), (F.col("h.query_id") == F.col("w.query_id")) & F.col("document_id").eqNullSafe(F.col("of")) & (F.col("h.start") == F.col("w.start")))
    return out.select("h.query_id", "document_id", "node_id", "node_seq").distinct().join(benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text")), "query_id").select("query_id", "query_text", "document_id", "node_id", "node_seq").distinct()


def questions(truth: DataFrame) -> DataFrame:
    """query_id, query_text, document_id, gt_citations: one row for each item and document that has it."""
    rows = truth.groupBy("query_id", "query_text", "document_id").agg(F.array_sort(F.collect_list("node_id")).alias("gt_citations"))
    return rows.withColumn("query_id", F.format_string("V_%05d_%s", F.col("query_id").cast("long"), F.col("document_id").cast("string")))


def postings(nodes: DataFrame) -> DataFrame:
    """document_id, node_id, node_seq, term, tf: the inverted index."""
    rows = nodes.select("document_id", "node_id", "node_seq", F.explode(t.tokens(F.col("content"))).alias("term"))
    return rows.groupBy("document_id", "node_id", "node_seq", "term").agg(F.count("*").alias("tf"))


def bm25_stats(nodes: DataFrame) -> DataFrame:
    """document_id, n_nodes, total_tokens, avgdl."""
    sized = nodes.select("document_id", F.size(t.tokens(F.col("content"))).cast("long").alias("dl"))
    return sized.groupBy("document_id").agg(F.count("*").alias("n_nodes"), F.sum("dl").alias("total_tokens"), F.avg("dl").alias("avgdl"))


def _with_idf(df: DataFrame, smoothed: bool) -> DataFrame:
    if smoothed:
        return df.withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = F.avg("raw").over(Window.partitionBy("document_id"))
    return df.withColumn("raw", raw).withColumn("mean", mean).withColumn("idf", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")))


def impact() -> Column:
    """What a term in a question adds to a node's score."""
    return F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def _of_asked(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """The nodes of documents that are asked about: Spark meets them before it makes nodes of documents, and shuffles no others."""
    return nodes.join(few(asked.select("document_id").distinct()), "document_id", "left_semi")


def bm25(asked: DataFrame, nodes: DataFrame, k: int, smoothed: bool = False) -> DataFrame:
    """BM25 with each document as its own corpus; every node of the document is scored, so zero scores can fill a list.

    Inverse document frequency is ln(N - df + 0.5) - ln(df + 0.5), a negative one replaced by EPSILON times the document's mean;
    smoothed: ln(1 + (N - df + 0.5) / (df + 0.5)).
    """
    some = _of_asked(nodes, asked)
    some = cut(some.select("document_id", "node_id", "node_seq", t.tokens(F.col("content")).alias("tokens"))).withColumn("dl", F.size("tokens"))
    stats = some.groupBy("document_id").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = some.select("document_id", "node_seq", "dl", F.explode("tokens").alias("term")).groupBy("document_id", "node_seq", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("document_id", "term").agg(F.count("*").alias("df")).join(stats, "document_id")
    idf = _with_idf(df, smoothed)
    terms = asked.select("query_id", "document_id", F.explode(t.tokens(F.col("query_text"))).alias("term")).groupBy("query_id", "document_id", "term").agg(F.count("*").alias("qf"))
    met = terms.join(idf, ["document_id", "term"]).join(tf, ["document_id", "term"])
    part = F.col("qf") * impact()
    sums = met.groupBy("query_id", "document_id", "node_seq").agg(F.sum(part).alias("sum"))
    every = asked.select("query_id", "document_id").join(some.select("document_id", "node_seq", "node_id"), "document_id")
    scored = every.join(sums, ["query_id", "document_id", "node_seq"], "left").withColumn("score", F.round(F.coalesce("sum", F.lit(0.0)), 6) + 0.0)
    return top(scored, k).select("query_id", "document_id", "rank", "node_id", "node_seq", "score")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Nought where either has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / F.nullif(size, F.lit(0.0))).otherwise(0.0)


def by_vector(asked: DataFrame, vectors: DataFrame, k: int, scope: str = "document_id", score=cosine, blocks: int = 16) -> DataFrame:
    """Exact top k by cosine within the scope. asked: query_id, scope, query_vector; vectors: scope, node_seq, vector.

    A scope's vectors are dealt over `blocks` blocks, each question goes to all of them; the k best of each are merged. Cosines are found by products of matrices in
    tasks; another score, an expression over two vectors, is worked out for each pair.
    """
    dealt = vectors.select(scope, "node_seq", "vector", F.pmod(F.xxhash64("node_seq"), F.lit(blocks)).cast("int").alias("block"))
    met = asked.select("query_id", scope, "query_vector", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    if score is cosine:
        best = nearest(met, dealt, k, (scope, "block")).withColumn("score", F.round("score", 6) + 0.0)
    else:
        scored = met.join(dealt, [scope, "block"]).select("query_id", scope, "block", "node_seq", (F.round(score(F.col("query_vector"), F.col("vector")), 6) + 0.0).alias("score"))
        best = top(scored, k, ("query_id", "block"))
    return top(best, k).select("query_id", scope, "rank", "node_seq", "score")


def reranked(ranked: DataFrame, rescored: Column, k: int) -> DataFrame:
    """The k best of a ranked list by another score: cheap first, dear second. Earlier rank wins ties."""
    return top(ranked.withColumnRenamed("rank", "first_rank").withColumn("score", rescored), k, tie="first_rank")


def overlap_score(question: Column, content: Column) -> Column:
    """A stand-in for a cross-encoder: the share of the question's distinct tokens that the node has."""
    q = F.array_distinct(t.tokens(question))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(q, t.tokens(content))) / F.size(q), 6))


def hashed_vector(content: Column, size: int = 64) -> Column:
    """A stand-in for an embedder: counts of token hashes."""
    at = F.transform(t.tokens(content), lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 6), 16, 10).cast("int") % size)
    return bound(at, lambda a: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (F.size(a) - F.size(F.array_remove(a, i))).cast("double")))


def hybrid(asked: DataFrame, nodes: DataFrame, k: int, n: int) -> DataFrame:
    """BM25 narrows a document to n nodes, hashed vectors rank those. Each text is hashed once."""
    some = bm25(asked, nodes, n).select("query_id", "document_id", "node_seq", "node_id")
    questions = cut(asked.select("query_id", hashed_vector(F.col("query_text")).alias("a")))
    contents = some.join(_of_asked(nodes, asked).select("document_id", "node_seq", "content"), ["document_id", "node_seq"])
    rows = cut(contents.select("query_id", "document_id", "node_seq", "node_id", hashed_vector(F.col("content")).alias("b"))).join(questions, "query_id")
    return top(rows.withColumn("score", F.round(cosine(F.col("a"), F.col("b")), 6) + 0.0), k).select("query_id", "document_id", "rank", "node_id", "node_seq", "score")


def tree_levels(nodes: DataFrame, fanout: int = FANOUT, most_levels: int = 20) -> DataFrame:
    """document_id, level, pos, parent: leaves are level 0; each run of `fanout` nodes has a parent; one root a document.

    The number of levels is a logarithm of the largest document, found with one aggregate.
    """
    sizes = nodes.groupBy("document_id").agg(F.count("*").alias("n"))
    levels = F.aggregate(F.sequence(F.lit(1), F.lit(most_levels)), F.struct(F.col("n").alias("n"), F.array(F.col("n")).alias("all")), lambda a, _: F.when(a.n > 1, F.struct(F.ceil(a.n / fanout).alias("n"), F.concat(a.all, F.array(F.ceil(a.n / fanout))).alias("all"))).otherwise(a), lambda a: a.all)
    rows = sizes.select("document_id", F.posexplode(levels).alias("level", "width"))
    rows = rows.select("document_id", "level", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)).alias("pos"))
    return rows.select("document_id", "level", "pos", F.when(F.col("width") > 1, F.floor(F.col("pos") / fanout)).alias("parent"))


def tree_texts(nodes: DataFrame, fanout: int = FANOUT, each: int = 5) -> DataFrame:
    """document_id, level, pos, words: a leaf has all its tokens, a parent the first `each` of each child, in their order.

    One small aggregation a level: a parent has fanout times `each` words at most, whatever is below it.
    """
    pos = (F.col("node_seq") - 1).cast("long")
    level = cut(nodes.select("document_id", F.lit(0).alias("level"), pos.alias("pos"), t.tokens(F.col("content")).alias("words")))
    out = level
    widest = level.groupBy("document_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while widest > 1:
        widest = -(-widest // fanout)
        wide = level.groupBy("document_id").agg(F.max("pos").alias("last")).where("last > 0").select("document_id")
        below = level.join(wide, "document_id").select("document_id", "level", F.floor(F.col("pos") / fanout).alias("parent"), F.struct("pos", F.slice("words", 1, each).alias("w")).alias("x"))
        words = F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.w))
        level = cut(below.groupBy("document_id", "parent", "level").agg(words.alias("words")).select("document_id", (F.col("level") + 1).alias("level"), F.col("parent").alias("pos"), "words"))
        out = out.unionByName(level)
    return out


def by_tree(asked: DataFrame, nodes: DataFrame, k: int, fanout: int = FANOUT, beam: int = 2, each: int = 5) -> DataFrame:
    """From the root of the question's document downwards: of the children of the nodes held, the `beam` that share most tokens
    with the question are held, those further left of equal ones; the leaves met in the end are ranked so by all their tokens, k of them.

    Summaries are short, so a beam may pass a leaf by; indexes.by_vector_tree is exact."""
    tree = cut(tree_texts(nodes.join(asked.select("document_id").distinct(), "document_id", "left_semi"), fanout, each))
    roots = tree.groupBy("document_id").agg(F.max("level").alias("level"))
    depth = roots.agg(F.max("level")).first()[0] or 0
    wanted = asked.select("query_id", "document_id", F.array_distinct(t.tokens(F.col("query_text"))).alias("q"))
    held = wanted.join(roots, "document_id").select("query_id", "document_id", "q", "level", F.lit(0).cast("long").alias("pos"))
    for level in range(depth, 0, -1):  # as many rounds as the tallest tree has levels
        here = held.where(F.col("level") == level).withColumn("parent", F.col("pos")).drop("level", "pos")
        children = tree.where(F.col("level") == level - 1).withColumn("parent", F.floor(F.col("pos") / fanout))
        met = here.join(children, ["document_id", "parent"]).withColumn("score", F.size(F.array_intersect("q", "words")).cast("double"))
        best = top(met, beam, tie="pos") if level > 1 else met
        held = held.where(F.col("level") < level).unionByName(best.select("query_id", "document_id", "q", "level", "pos"))
    leaves = held.join(tree.where("level = 0").select("document_id", "pos", "words"), ["document_id", "pos"])
    scored = leaves.select("query_id", "document_id", (F.col("pos") + 1).cast("int").alias("node_seq"), F.size(F.array_intersect("q", "words")).cast("double").alias("score"))
    return top(scored, k).select("query_id", "document_id", "rank", "node_seq", "score")
