"""Making question sets: chunks of sections go to a generator, its questions to a critic that sees nothing else, and what both agree on fills the quotas.

A round proposes questions for the quadrants that still lack some; rejected chunks are sent back and asked for another
question in a later round, after chunks that were asked less often. Rounds end when all quotas are full, or after `most_rounds`.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks import schemas
from lodeworks.functions import text as t
from lodeworks.operators import experiment as x
from lodeworks.operators import retrieval as r
from lodeworks.runtime import few, written

SETS = {"PQ": 25, "GQ": 5, "JEQ": 5}
#: What a critic sees of a question.
BLIND = ("query_id", "query_text", "document_id")
#: What a generator sees of the corpus.
CHUNK = ("chunk_id", "document_id", "quadrant", "round", "contents", "node_ids")


def packed(nodes: DataFrame, budget: int) -> DataFrame:
    """nodes with a chunk number within their section (from 0): in order, a node opens a new chunk if it would take the open one above budget; a node above budget stands alone.

    nodes: document_id, parent_item_header, node_seq, token_count, ... What depends on all that came before is worked out a section at a time, over three
    numbers a node; a section is a part of one document.
    """

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node_seq")
        used, chunk, out = 0, 0, []
        for tokens in rows["token_count"].fillna(0).tolist():
            if used and used + tokens > budget:
                used, chunk = 0, chunk + 1
            used += tokens
            out.append(chunk)
        return rows.assign(chunk=out)[["document_id", "section", "node_seq", "chunk"]]

    kinds = dict(nodes.dtypes)
    section = F.coalesce("parent_item_header", F.lit("")).alias("section")
    narrow = nodes.select("document_id", section, "node_seq", "token_count")
    found = narrow.groupBy("document_id", "section").applyInPandas(pack, f"document_id {kinds['document_id']}, section string, node_seq {kinds['node_seq']}, chunk int")
    return nodes.join(found.drop("section"), ["document_id", "node_seq"])


def chunks(packed_nodes: DataFrame, seed: str = "5") -> DataFrame:
    """chunk_id, document_id, quadrant, contents, node_ids of packed nodes: a chunk belongs to one quadrant, by a hash, so that no two sets share one."""
    section = F.coalesce("parent_item_header", F.lit(""))
    parts = packed_nodes.groupBy("document_id", section.alias("section"), "chunk").agg(F.array_sort(F.collect_list(F.struct("node_seq", "node_id", "content"))).alias("x"))
    name = F.concat_ws(":", F.col("document_id").cast("string"), F.md5("section"), F.col("chunk").cast("string"))
    rows = parts.select(name.alias("chunk_id"), "document_id", F.col("x.content").alias("contents"), F.col("x.node_id").alias("node_ids"))
    quadrant = F.get(F.array(*map(F.lit, schemas.QUADRANTS)), F.pmod(F.conv(F.substring(F.md5(F.concat("chunk_id", F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long"), F.lit(4)).cast("int"))
    return rows.withColumn("quadrant", quadrant)


def propose(asked: DataFrame) -> DataFrame:
    """A deterministic stand-in for a generator: query_id, chunk_id, document_id, quadrant, query_text, answer, citations. Each round it takes another node of the
    chunk, asks with its words from the fourth on, eight at most, and answers with its first number, or its first word."""
    at = F.pmod(F.col("round") - 1, F.size("node_ids"))
    content = F.get("contents", at)
    words = t.tokens(content)
    return asked.select(
        F.concat_ws("#", "chunk_id", F.col("round").cast("string")).alias("query_id"), "chunk_id", "document_id", "quadrant", F.array_join(F.slice(words, 4, 8), " ").alias("query_text"),
        answer(content).alias("answer"), F.array(F.get("node_ids", at)).alias("citations"),
    )


def answer(content):
    """A node's first number, or its first word."""
    words = t.tokens(content)
    return F.coalesce(F.get(F.filter(words, lambda w: w.rlike(r"\d")), F.lit(0)), F.get(words, F.lit(0)), F.lit(""))


def criticise(blind: DataFrame, nodes: DataFrame) -> DataFrame:
    """A stand-in for a critic: query_id, answer, citations of blind questions. It searches the question's document by BM25, cites the best node and answers from it."""
    if set(blind.columns) != set(BLIND):
        raise ValueError(f"a critic sees {BLIND} only, not {blind.columns}")
    best = r.bm25(blind, nodes, 1).where("score > 0").select("query_id", "node_id")
    return best.join(nodes.select("node_id", "content"), "node_id").select("query_id", answer(F.col("content")).alias("answer"), F.array("node_id").alias("citations"))


def generated(pool: DataFrame, nodes: DataFrame, generator: Callable[[DataFrame], DataFrame] = propose, critic: Callable[[DataFrame, DataFrame], DataFrame] = criticise, sets: dict[str, int] = SETS, most_rounds: int = 6, more: int = 2) -> tuple[DataFrame, DataFrame]:
    """Question sets (set, query_id, chunk_id, document_id, quadrant, query_text, answer, citations) and yields (round, quadrant, tried, kept, share).

    pool: from `chunks`. A round asks for `more` questions for each that a quadrant lacks: of the chunks asked least often, then by a hash of their id. Of what the critic
    agrees with, as many as are lacking are kept, in the order they were asked; a chunk gives one question at most. Cells of an unfilled
    quadrant stay empty: the yields show it. What is collected is four counts a round.
    """
    total, spark = sum(sets.values()), pool.sparkSession
    order = F.md5(F.concat("chunk_id", F.lit(":order")))
    pool = written(pool.withColumn("order", order))
    kept, tried, log = None, None, None
    for number in range(1, most_rounds + 1):
        counts = {} if kept is None else {row["quadrant"]: row["count"] for row in kept.groupBy("quadrant").count().collect()}
        lacking = [(q, total - counts.get(q, 0)) for q in schemas.QUADRANTS if counts.get(q, 0) < total]
        if not lacking:
            break
        lack = F.broadcast(spark.createDataFrame(lacking, "quadrant string, lacking int"))  # four rows
        free = pool if kept is None else pool.join(few(kept.select("chunk_id")), "chunk_id", "left_anti")
        free = free.withColumn("again", F.lit(0).cast("long")) if tried is None else free.join(few(tried), "chunk_id", "left").withColumn("again", F.coalesce("again", F.lit(0)))
        first = r.top(free.select("chunk_id", "quadrant", (-F.col("again")).alias("score"), "order"), total * more, ("quadrant",), "order")
        asked = first.join(lack, "quadrant").where(F.col("rank") <= F.col("lacking") * more).select("chunk_id", F.col("rank").alias("place"))
        asked = written(free.join(few(asked, 10_000), "chunk_id").withColumn("round", F.lit(number)).drop("order", "again"))
        proposed = written(generator(asked.select(*CHUNK)).join(asked.select("chunk_id", "place"), "chunk_id"))
        verdicts = x.cross_checked(proposed.select("query_id", "citations", "answer"), critic(proposed.select(*BLIND), nodes))
        judged = written(proposed.join(verdicts, "query_id"))
        good = judged.where("accepted").withColumn("nth", F.row_number().over(Window.partitionBy("quadrant").orderBy("place"))).join(lack, "quadrant")
        good = written(good.where(F.col("nth") <= F.col("lacking")).select("query_id", "chunk_id", "document_id", "quadrant", "query_text", "answer", "citations", F.lit(number).alias("round"), "nth"))
        kept = good if kept is None else written(kept.unionByName(good))
        once = judged.select("chunk_id", F.lit(1).cast("long").alias("again"))
        tried = written((once if tried is None else tried.unionByName(once)).groupBy("chunk_id").agg(F.sum("again").alias("again")))
        entry = x.yields(judged.select("quadrant", "accepted")).select(F.lit(number).alias("round"), "*")
        log = written(entry if log is None else log.unionByName(entry))
    upto, name = total, F.lit(None).cast("string")
    kept = kept.withColumn("place", F.row_number().over(Window.partitionBy("quadrant").orderBy("round", "nth")))  # as many rows as the quotas
    for set_name, n in reversed(sets.items()):
        name, upto = F.when(F.col("place") <= upto, set_name).otherwise(name), upto - n
    return kept.select(name.alias("set"), "query_id", "chunk_id", "document_id", "quadrant", "query_text", "answer", "citations"), log
