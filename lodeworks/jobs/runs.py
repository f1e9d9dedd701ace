"""Composed jobs over a store: ingesting documents, building summary trees, and running the cells of an experiment.

What a hosted service or a model would do has a place for a `Model`, a function over batches that a worker loads once: embed (texts
to vectors), rerank (questions and contents to scores), answer (questions and contexts to outputs) and judge (outputs and
truths to scores). Left out, a deterministic column expression stands in.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks import schemas
from lodeworks.functions import metrics as m
from lodeworks.functions import text as t
from lodeworks.functions.models import Model, column
from lodeworks.operators import experiment as x
from lodeworks.operators import indexes
from lodeworks.operators import retrieval as r
from lodeworks.runtime import cut, ship, unused
from lodeworks.sources import store

#: How many nodes P1 ranks by vectors before it ranks them again.
FIRST = 20


def ingest(spark: SparkSession, documents: DataFrame, build: Callable[[DataFrame], DataFrame], root: str, document_id: str = "document_id") -> DataFrame:
    """document_id, n_nodes, skipped: documents of which the store has no node are built and appended, all at once; the others are skipped.

    They are added as one batch, which readers see whole or not at all, so a run that dies leaves no part of a document.
    """
    store.create(spark, root)
    have = cut(store.read(spark, root, "nodes").groupBy("document_id").agg(F.count("*").alias("n_nodes")))
    (key,) = unused(documents, "key")
    wanted = documents.withColumn(key, F.col(document_id).cast("string"))
    new = cut(build(wanted.join(have, F.col(key) == have["document_id"], "left_anti").drop(key)).select(*(F.col(f.name).cast(f.dataType) for f in schemas.NODES)))
    store.append(new, root, "nodes")
    counts = new.groupBy("document_id").agg(F.count("*").alias("n_nodes"), F.lit(False).alias("skipped"))
    return counts.unionByName(have.join(wanted.select(F.col(key).alias("document_id")).distinct(), "document_id", "left_semi").withColumn("skipped", F.lit(True)))


def build_trees(spark: SparkSession, documents: DataFrame, nodes: DataFrame, root: str, run: int, fanout: int = r.FANOUT, each: int = 5) -> DataFrame:
    """Cost rows of a run: trees of documents (document_id) that have none yet are built and added; the others are skipped.

    A document without nodes fails the run before anything is written: an empty tree would count as built for good. Readers take a
    document's newest run, so a tree is replaced by adding one. The stand-in summary reads its children's words and writes some. The
    time that building all trees took is shared out by their nodes.
    """
    wanted = documents.select("document_id").distinct()
    todo = cut(store.to_build(wanted, store.trees(spark, root)))
    if none := todo.join(nodes, "document_id", "left_anti").first():
        raise ValueError(f"no nodes of {none['document_id']}: it has not been ingested")
    began = time.perf_counter()
    tree = cut(r.tree_texts(nodes.join(todo, "document_id", "left_semi"), fanout, each))
    each_node = (time.perf_counter() - began) / max(1, tree.count())
    store.save_trees(tree.withColumn("run", F.lit(run)), root)
    words = F.size("words").cast("long")
    # what a parent reads are the words of its children, all but the root's; what is written are the parents'
    top = tree.groupBy("document_id").agg(F.max("level").alias("top"))
    spent = tree.join(top, "document_id").groupBy("document_id").agg(
        F.sum(F.when(F.col("level") < F.col("top"), words).otherwise(0)).alias("input_tokens"), F.sum(F.when(F.col("level") > 0, words).otherwise(0)).alias("output_tokens"), (F.count("*") * each_node).alias("wall_clock_sec")
    )
    built = spent.select("document_id", F.lit(False).alias("skipped"), "wall_clock_sec", "input_tokens", "output_tokens")
    skipped = wanted.join(todo, "document_id", "left_anti").withColumn("skipped", F.lit(True))
    return built.unionByName(skipped, allowMissingColumns=True)


def ranked(asked: dict[str, DataFrame], nodes: DataFrame, k: int, embed: Model | None = None, rerank: Model | None = None) -> DataFrame:
    """query_id, pipeline, rank, node_id, each within the question's document; asked: the questions of each pipeline that has some.

    P1: the FIRST nearest vectors, ranked again. P2: BM25. P3: vectors over a tree of summaries, exact.
    """
    every = reduce(DataFrame.unionByName, (q.select("document_id") for q in asked.values())).distinct()
    some = cut(nodes.join(every, "document_id", "left_semi").select("document_id", "node_id", "node_seq", "content"))
    vector = (lambda c: r.hashed_vector(c)) if embed is None else lambda c: column(embed, c)
    score = r.overlap_score if rerank is None else lambda q, c: column(rerank, q, c)
    ship(nodes.sparkSession)
    out = []
    vectors = cut(some.select("document_id", "node_seq", vector(F.col("content")).alias("vector"))) if {"P1", "P3"} & set(asked) else None
    for name, rows in asked.items():
        questions = rows.select("query_id", "document_id", "query_text")
        if name == "P2":
            out.append(r.bm25(questions, some, k).select("query_id", F.lit("P2").alias("pipeline"), "rank", "node_id"))
            continue
        wanted = questions.select("query_id", "document_id", vector(F.col("query_text")).alias("query_vector"))
        if name == "P1":
            near = r.by_vector(wanted, vectors, max(k, FIRST)).drop("score").join(questions.select("query_id", "query_text"), "query_id").join(some, ["document_id", "node_seq"])
            again = cut(near.select("query_id", "rank", "node_id", score(F.col("query_text"), F.col("content")).alias("again")))
            best = r.reranked(again, F.round("again", 6) + 0.0, k)
        else:
            near = indexes.by_vector_tree(wanted, indexes.vector_tree(vectors), vectors, k)
            best = near.join(some.select("document_id", "node_seq", "node_id"), ["document_id", "node_seq"])
        out.append(best.select("query_id", F.lit(name).alias("pipeline"), "rank", "node_id"))
    return reduce(DataFrame.unionByName, out)


#: What an answerer gets: the question and what was retrieved for it, and nothing of the truth, its citations or scores.
SEEN = ("result_id", "query_text", "context", "first_node")


def answered(cells: DataFrame, answer: Model | None = None) -> DataFrame:
    """result_id, pipeline_output, latency_sec, input_tokens and output_tokens of cells that have the columns SEEN and no others.

    The stand-in quotes the context's first words and cites its first node.
    """
    if set(cells.columns) != set(SEEN):
        raise ValueError(f"an answerer sees {SEEN} only, not {cells.columns}")
    if answer is None:
        quoted = F.array_join(F.slice(F.split("context", t.GAPS), 1, 40), " ")
        out = cells.withColumn("pipeline_output", F.coalesce(F.concat(quoted, F.lit(" [[node:"), F.col("first_node"), F.lit("]]")), F.lit(""))).withColumn("latency_sec", F.lit(0.0))
    else:
        ship(cells.sparkSession)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = answer.get()
            for batch in batches:
                began = time.perf_counter()
                batch["pipeline_output"] = model(batch["query_text"].tolist(), batch["context"].fillna("").tolist())
                batch["latency_sec"] = (time.perf_counter() - began) / max(1, len(batch))
                yield batch

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema)
        out = cut(cells.mapInPandas(run, f"{kinds}, pipeline_output string, latency_sec double"))  # called once a cell, and timed once
    sent = t.token_count(F.col("query_text")) + F.coalesce(t.token_count(F.col("context")), F.lit(0))
    return out.withColumns({"input_tokens": sent, "output_tokens": t.token_count(F.col("pipeline_output"))}).select("result_id", "pipeline_output", "latency_sec", "input_tokens", "output_tokens")


def run_cells(cells: DataFrame, asked: DataFrame, nodes: DataFrame, done: DataFrame, answer: Model | None = None, judge: Model | None = None, embed: Model | None = None, rerank: Model | None = None) -> DataFrame:
    """Rows of the results table for the cells that done lacks: retrieved, answered, cited and scored.

    cells: the matrix; asked: query_id, query_text, ground_truth_answer, quadrant, document_id, gt_citations. A pipeline ranks
    for the questions it still has cells of; where nothing is left to do, nothing is ranked.
    """
    todo = cut(x.remaining(cells, done))
    left = sorted(row["pipeline"] for row in todo.select("pipeline").distinct().collect())  # three rows at most
    if not left:
        return cells.sparkSession.createDataFrame([], schemas.RESULTS)
    need = {p: asked.join(todo.where(F.col("pipeline") == p).select("query_id").distinct(), "query_id", "left_semi") for p in left}
    lists = ranked(need, nodes, max(schemas.K_VALUES), embed, rerank).groupBy("query_id", "pipeline").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_id"))), lambda y: y.node_id).alias("list"))
    rows = todo.join(asked, "query_id").join(lists, ["query_id", "pipeline"], "left")
    rows = rows.withColumn("retrieved_node_ids", F.slice(F.coalesce("list", F.array().cast("array<string>")), 1, F.col("k_value"))).drop("list")
    rows = cut(rows.withColumn("result_id", F.md5(F.concat_ws(":", *x.CELL))))
    parts = rows.select("result_id", F.posexplode("retrieved_node_ids").alias("at", "node_id")).join(nodes.select("node_id", "content"), "node_id")
    contexts = parts.groupBy("result_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "content"))), lambda y: y.content), "\n\n").alias("context"))
    seen = rows.join(contexts, "result_id", "left").withColumn("first_node", F.get("retrieved_node_ids", F.lit(0))).select(*SEEN)
    out = rows.join(answered(seen, answer), "result_id")
    said, truth, got, right, k = (F.col(c) for c in ("pipeline_output", "ground_truth_answer", "retrieved_node_ids", "gt_citations", "k_value"))
    cited = t.citations(said)
    scores = {
        "cited_node_ids": cited, "precision_at_k": F.round(m.precision_at_k(got, right, k), 6), "recall_at_k": F.round(m.recall_at_k(got, right, k), 6), "evidence_hit": m.evidence_hit(got, right, k),
        "citation_match": m.citation_match(cited, right), "token_f1": F.round(t.token_f1(said, truth), 6), "exact_match": t.exact_match(said, truth, F.col("quadrant")),
        "judge_score": x.stand_in_judge(said, truth) if judge is None else column(judge, said, truth), "human_score": F.lit(None).cast("int"),
    }
    out = out.withColumns(scores)
    return out.select(*(F.col(f.name) if f.name.endswith("_ids") else F.col(f.name).cast(f.dataType) for f in schemas.RESULTS))


def judged_gate(results: DataFrame, asked: DataFrame, golden: DataFrame, human: DataFrame, rubric: str, judge: Model | None = None, tolerance: int = 1, least: float = 0.8, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """The gate before a full run: scored cells of the judge's question set at K = k, and n, agreement, passed.

    Each cell's prompt is the rubric and exemplars of its question's quadrant with the cell's output; the judge gives a score for it. human:
    the cell's key and human_score; a cell without one counts as no agreement. judge: prompts to scores; the stand-in scores outputs against the question's truth.
    """
    cells = results.where((F.col("source_set") == "JEQ") & (F.col("k_value") == k)).drop("human_score", "judge_score")
    rows = cells.join(asked.select("query_id", "quadrant", "query_text", "ground_truth_answer"), "query_id")
    rows = x.prompts(x.prompt_prefixes(golden, rubric), rows)
    score: Column = x.stand_in_judge(F.col("pipeline_output"), F.col("ground_truth_answer")) if judge is None else column(judge, F.col("prompt"))
    ship(results.sparkSession)
    rows = rows.withColumn("judge_score", score.cast("int")).join(human.select(*x.CELL, "human_score"), x.CELL, "left")
    scored = cut(rows.select(*x.CELL, "quadrant", "prompt", "judge_score", "human_score"))
    return scored, x.gate(scored.withColumn("human_score", F.coalesce("human_score", F.lit(-1_000))), tolerance, least)


def write_tables(results: DataFrame, root: str) -> None:
    """The analysis tables of results (with their quadrant) as a version of CSV files under root: by pipeline and K, by quadrant too, and all sums above those."""
    tables = {"by_pipeline": x.summary(results, "pipeline", "k_value"), "by_quadrant": x.summary(results, "pipeline", "k_value", "quadrant"), "cube": x.summary_cube(results, "pipeline", "k_value", "quadrant")}
    with store.publishing(results.sparkSession, root) as aside:
        for name, rows in tables.items():  # some dozen rows each
            rows.coalesce(1).write.option("header", True).csv(f"{aside}/{name}")
