"""Documents into nodes: blocks with ids, types, sections and token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions import text as t

COLUMNS = ["node_id", "document_id", "parent_item_header", "node_type", "source_page_num", "content", "token_count", "node_seq"]


def from_markdown(parsed: DataFrame) -> DataFrame:
    """Nodes of document_id, markdown: blank-line blocks; a heading is no node and names the section of those that follow.

    One shuffle and one sort by document serve both windows; a document is as large as one window gets.
    """
    blocks = parsed.select("document_id", F.posexplode(F.split("markdown", "\n\n", -1)).alias("pos", "block"))
    blocks = blocks.select("document_id", "pos", t.strip(F.col("block")).alias("content")).where("content <> ''")
    blocks = blocks.withColumn("title", t.section(F.col("content")))
    order = Window.partitionBy("document_id").orderBy("pos")
    filled = F.last("title", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = blocks.withColumn("parent_item_header", filled).where("title IS NULL").withColumn("node_seq", F.row_number().over(order))
    kind = F.when(t.is_table(F.col("content")), "table").otherwise("text")
    return rows.withColumns({
        "node_id": t.node_id(F.col("document_id"), F.col("node_seq")), "node_type": kind,
        "source_page_num": F.lit(None).cast("int"), "token_count": t.token_count(F.col("content")),
    }).select(COLUMNS)


def from_lines(docs: DataFrame, document_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Nodes of documents whose blocks are lines. Numbers come from the place in the array: a narrow map, no shuffle."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), t.strip), lambda x: x != "")
    rows = docs.select(F.col(document_id).alias("document_id"), F.posexplode(lines).alias("pos", "content"))
    return rows.select(
        t.node_id(F.col("document_id"), F.col("pos") + 1).alias("node_id"), "document_id", F.when(t.is_table(F.col("content")), "table").otherwise("text").alias("node_type"),
        "content", t.token_count(F.col("content")).alias("token_count"), (F.col("pos") + 1).alias("node_seq"),
    )


def as_text_nodes(nodes: DataFrame) -> DataFrame:
    """id_, text and metadata of each node; token counts stay behind."""
    return nodes.select(F.col("node_id").alias("id_"), F.col("content").alias("text"), F.struct("document_id", "parent_item_header", "node_type", "source_page_num").alias("metadata"))


def whole_documents(nodes: DataFrame) -> DataFrame:
    """The no-retrieval baseline: all nodes of a document, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("node_seq", "node_id", "token_count")))
    rows = nodes.groupBy("document_id").agg(ordered.alias("all"))
    return rows.select("document_id", F.col("all.node_id").alias("retrieved_node_ids"), F.aggregate("all.token_count", F.lit(0), lambda a, b: a + b).alias("context_tokens"))


def hydrated(ranked: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, context: the retrieved nodes' contents in rank order. ranked: query_id, rank, node_id."""
    rows = ranked.join(nodes.select("node_id", "content", "token_count"), "node_id")
    packed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("x"), F.sum("token_count").alias("context_tokens"))
    return packed.select("query_id", F.array_join("x.content", "\n\n").alias("context"), "context_tokens")
