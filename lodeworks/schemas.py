"""Tables of an evaluation store: their columns, keys and the values that closed columns may have."""

from __future__ import annotations

from pyspark.sql import types as T

#: What closed columns may hold.
NODE_TYPES = ("text", "table")
QUADRANTS = ("Q1", "Q2", "Q3", "Q4")
SOURCE_SETS = ("PQ", "JEQ")
PIPELINES = ("P1", "P2", "P3")
K_VALUES = (3, 5, 10)
SCORES = tuple(range(1, 11))
STATUSES = ("success", "partial", "failure")

_S, _I, _D, _B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_IDS = T.ArrayType(T.StringType(), False)


def _table(needed: str, optional: str = "", **kinds: T.DataType) -> T.StructType:
    fields = [T.StructField(c, kinds.get(c, _S), False) for c in needed.split()]
    return T.StructType(fields + [T.StructField(c, kinds.get(c, _S), True) for c in optional.split()])


MANIFEST = _table("document_id ticker fiscal_year", fiscal_year=_I)
NODES = _table("node_id document_id node_type content token_count", "parent_item_header source_page_num", token_count=_I, source_page_num=_I)
QUERIES = _table("query_id quadrant query_text ground_truth_answer gt_citations document_id verified", gt_citations=_IDS, verified=_B)
GOLDEN = _table("query_id quadrant query_text ground_truth_answer gt_citations example_output human_score human_reasoning document_id", gt_citations=_IDS, human_score=_I)
JUDGE_VALIDATION = _table("query_id quadrant query_text ground_truth_answer gt_citations document_id", gt_citations=_IDS)
RESULTS = _table(
    "result_id source_set query_id pipeline k_value retrieved_node_ids",
    "pipeline_output cited_node_ids precision_at_k recall_at_k evidence_hit citation_match token_f1 exact_match judge_score human_score latency_sec input_tokens output_tokens",
    retrieved_node_ids=_IDS, cited_node_ids=_IDS, k_value=_I, precision_at_k=_D, recall_at_k=_D, token_f1=_D, latency_sec=_D,
    **dict.fromkeys("evidence_hit citation_match exact_match judge_score human_score input_tokens output_tokens".split(), _I),
)
BUILD_COST = _table("document_id skipped", "wall_clock_sec input_tokens output_tokens", skipped=_B, wall_clock_sec=_D, input_tokens=_I, output_tokens=_I)

TABLES = {"nodes": NODES, "queries": QUERIES, "golden_queries": GOLDEN, "judge_validation": JUDGE_VALIDATION, "results": RESULTS}
KEYS = {"nodes": ["node_id"], "queries": ["query_id"], "golden_queries": ["query_id"], "judge_validation": ["query_id"], "results": ["source_set", "query_id", "pipeline", "k_value"]}
#: By columns of few values only: a folder a document would be as many small files.
PARTITIONED = {"results": ["pipeline", "k_value"]}
