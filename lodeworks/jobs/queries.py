"""Every registered query over the given tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

import contextlib
import math
from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.functions import metrics as m
from lodeworks.functions import text as t
from lodeworks.jobs import runs
from lodeworks.operators import experiment as x
from lodeworks.operators import generation, indexes, latency, logs
from lodeworks.operators import nodes as n
from lodeworks.operators import reports
from lodeworks.operators import retrieval as r
from lodeworks.runtime import cut, scratch, table
from lodeworks.sources import landed, store
from lodeworks.streaming import resumable, usage

QUERIES: dict = {}
SQL: dict[str, str] = {}


#: Levels of parents that the SQL twins of the summary tree write out.
_LEVELS = 5


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# Parts of the SQL that several queries need.
NODES = r"""
lines AS (SELECT doc_id AS document_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM documents),
nodes AS (SELECT document_id, i::INTEGER AS node_seq, ls[i] AS content, document_id || '_n' || lpad(i::VARCHAR, greatest(4, length(i::VARCHAR))::INTEGER, '0') AS node_id
          FROM lines, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i))"""
TOKENS = r"regexp_extract_all(lower({}), '[$£€]?\d+(?:,\d{{3}})*(?:\.\d+)?%?|\p{{L}}+')"
ASKED = rf"""{NODES},
items AS (SELECT item_id, text AS query_text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM benchmark),
met AS (SELECT item_id, query_text, document_id, node_seq AS first, node_seq + len(ps) - 1 AS last FROM nodes JOIN lines USING (document_id) JOIN items ON contains(content, ps[1])
  WHERE len(ps) = 1 OR len(ps) > 1 AND ends_with(content, ps[1]) AND ls[node_seq + 1:node_seq + len(ps) - 2] = ps[2:len(ps) - 1] AND starts_with(ls[node_seq + len(ps) - 1], ps[len(ps)])),
truth AS (SELECT DISTINCT item_id, query_text, document_id, node_id, node_seq FROM met JOIN nodes USING (document_id) WHERE node_seq BETWEEN first AND last),
asked AS (SELECT printf('V_%05d_%s', item_id::BIGINT, document_id::VARCHAR) AS query_id, item_id, query_text, document_id, list(node_id ORDER BY node_id) AS gt_citations FROM truth GROUP BY ALL)"""


def _bm25_sql(idf: str) -> str:
    return rf"""{ASKED},
few AS (SELECT nodes.*, {TOKENS.format("content")} AS tokens FROM nodes WHERE document_id IN (SELECT document_id FROM asked)),
stats AS (SELECT document_id, count(*) AS n, avg(len(tokens)) AS avgdl FROM few GROUP BY ALL),
tf AS (SELECT document_id, node_seq, len(tokens) AS dl, term, count(*) AS tf FROM (SELECT document_id, node_seq, tokens, unnest(tokens) AS term FROM few) GROUP BY document_id, node_seq, len(tokens), term),
df AS (SELECT document_id, term, count(*) AS df FROM tf GROUP BY ALL),
raw AS (SELECT document_id, term, n, df, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df JOIN stats USING (document_id)),
idf AS (SELECT *, {idf} AS idf FROM raw),
terms AS (SELECT query_id, document_id, term, count(*) AS qf FROM (SELECT query_id, document_id, unnest({TOKENS.format("query_text")}) AS term FROM asked) GROUP BY ALL),
sums AS (SELECT query_id, document_id, node_seq, sum(qf * idf * tf * {r.K1 + 1} / (tf + {r.K1} * ({1 - r.B} + {r.B} * dl / avgdl))) AS s FROM terms JOIN idf USING (document_id, term) JOIN tf USING (document_id, term) GROUP BY ALL),
scored AS (SELECT query_id, document_id, node_id, node_seq, round(coalesce(s, 0), 6) + 0.0 AS score FROM asked JOIN few USING (document_id) LEFT JOIN sums USING (query_id, document_id, node_seq)),
ranked AS (SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_seq)::INTEGER AS rank, node_id, node_seq, score FROM scored)"""


BM25 = _bm25_sql(f"CASE WHEN raw < 0 THEN {r.EPSILON} * avg(raw) OVER (PARTITION BY document_id) ELSE raw END")
METRICS = rf"""{BM25},
lists AS (SELECT query_id, list(node_id ORDER BY rank) AS retrieved FROM ranked WHERE rank <= 10 GROUP BY ALL),
found AS (SELECT query_id, item_id, k AS k_value, gt_citations, retrieved, len(list_intersect(retrieved[:k], gt_citations)) AS h FROM asked JOIN lists USING (query_id), (VALUES (3), (5), (10)) AS ks(k)),
metrics AS (SELECT query_id, item_id, k_value, round(h / k_value, 6) AS precision_at_k, round(h / len(gt_citations), 6) AS recall_at_k, (h > 0)::INTEGER AS evidence_hit FROM found)"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return n.from_lines(table(spark, d, "documents"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The questions, found once for a query."""
    return cut(r.questions(r.ground_truth(_nodes(spark, d), table(spark, d, "benchmark"))))


def _ranked(spark: SparkSession, d: str, k: int = 10, asked: DataFrame | None = None) -> DataFrame:
    return r.bm25(_asked(spark, d) if asked is None else asked, _nodes(spark, d), k)


@query(rf"WITH {NODES} SELECT node_id, document_id, 'text' AS node_type, content, len(regexp_split_to_array(content, '\s+'))::INTEGER AS token_count, node_seq FROM nodes")
def nodes_from_lines(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d)


@query(f"WITH {NODES} SELECT document_id, count(*) AS n FROM nodes GROUP BY ALL")
def nodes_per_document(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).groupBy("document_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 3")
def throttled_documents(spark: SparkSession, d: str) -> DataFrame:
    return x.throttled(table(spark, d, "documents").select("doc_id", "lang", "source"), True, "doc_id")


@query(f"WITH {NODES} SELECT node_id, content FROM nodes ORDER BY md5(node_id || ':7'), node_id LIMIT 30")
def audit_sample(spark: SparkSession, d: str) -> DataFrame:
    return x.audit_sample(_nodes(spark, d).select("node_id", "content"), 30)


_MARKED = r"""marked AS (SELECT document_id, u.i AS i, regexp_replace(u.c, '^\s+|\s+$', '', 'g') AS content, CASE WHEN u.i % 7 = 1 THEN regexp_replace(u.c, '\s+$', '') END AS title
  FROM (SELECT doc_id AS document_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'i': i, 'c': CASE WHEN i % 7 = 1 THEN 'Item ' || i || '. of ' || doc_id ELSE x END})) AS u FROM documents)),
sections AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY i)::INTEGER AS node_seq, content, section FROM (
  SELECT *, last_value(title IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS section FROM marked) WHERE title IS NULL AND content <> '')"""


@query(rf"""WITH {_MARKED} SELECT document_id || '_n' || lpad(node_seq::VARCHAR, greatest(4, length(node_seq::VARCHAR))::INTEGER, '0') AS node_id, section AS parent_item_header, node_seq, len(regexp_split_to_array(content, '\s+'))::INTEGER AS token_count FROM sections""")
def nodes_from_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Documents as Markdown whose every seventh line is a heading: blocks, sections filled forward, ids."""
    heading = lambda i: F.concat(F.lit("## Item "), (i + 1).cast("string"), F.lit(". of "), F.col("doc_id").cast("string"))
    blocks = F.transform(F.split("text", "\n", -1), lambda line, i: F.when(i % 7 == 0, heading(i)).otherwise(line))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.array_join(blocks, "\n\n").alias("markdown"))
    return n.from_markdown(docs).select("node_id", "parent_item_header", "node_seq", "token_count")


@query(rf"""WITH {NODES}, sized AS (SELECT document_id, len({TOKENS.format("content")}) AS dl FROM nodes)
SELECT document_id, count(*) AS n_nodes, sum(dl)::BIGINT AS total_tokens, round(avg(dl), 6) AS avgdl FROM sized GROUP BY ALL""")
def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    return r.bm25_stats(_nodes(spark, d)).withColumn("avgdl", F.round("avgdl", 6))


@query(rf"""WITH {NODES} SELECT document_id, node_id, term, count(*) AS tf FROM (SELECT document_id, node_id, unnest({TOKENS.format("content")}) AS term FROM nodes) GROUP BY ALL""")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    return r.postings(_nodes(spark, d)).drop("node_seq")


@query(f"WITH {ASKED} SELECT query_id, document_id, gt_citations FROM asked")
def question_ground_truth(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("query_id", "document_id", "gt_citations")


@query(f"WITH {BM25} SELECT query_id, document_id, rank, node_id, node_seq, score FROM ranked WHERE rank <= 3")
def bm25_topk_k3(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).where("rank <= 3")


@query(f"WITH {BM25} SELECT query_id, document_id, rank, node_id, node_seq, score FROM ranked WHERE rank <= 5")
def bm25_topk_k5(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).where("rank <= 5")


@query(f"WITH {BM25} SELECT query_id, document_id, rank, node_id, node_seq, score FROM ranked WHERE rank <= 10")
def bm25_topk_k10(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d)


@query(f"WITH {_bm25_sql('ln(1 + (n - df + 0.5) / (df + 0.5))')} SELECT query_id, document_id, rank, node_id, node_seq, score FROM ranked WHERE rank <= 10")
def bm25_smoothed_topk(spark: SparkSession, d: str) -> DataFrame:
    return r.bm25(_asked(spark, d), _nodes(spark, d), 10, smoothed=True)


@query(f"WITH {METRICS} SELECT query_id, k_value, precision_at_k, recall_at_k, evidence_hit FROM metrics")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    asked = _asked(spark, d)
    return x.retrieval_metrics(_ranked(spark, d, asked=asked), asked)


_COSINE = "list_dot_product(a::DOUBLE[], b::DOUBLE[]) / (sqrt(list_dot_product(a::DOUBLE[], a::DOUBLE[])) * sqrt(list_dot_product(b::DOUBLE[], b::DOUBLE[])))"
_VECTORS = f"""met AS (SELECT q.vec_id AS query_id, q.label, v.vec_id AS node_seq, q.embedding AS a, v.embedding AS b FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 50 = 0),
scored AS (SELECT query_id, label, node_seq, a, b, round({_COSINE}, 6) + 0.0 AS score FROM met),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_seq)::INTEGER AS rank FROM scored)"""


def _vector_ranked(spark: SparkSession, d: str, k: int) -> DataFrame:
    """Questions are the vectors whose id divides by 50; the scope is a label."""
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("query_vector"))
    return r.by_vector(asked, rows.select("label", F.col("vec_id").alias("node_seq"), F.col("embedding").alias("vector")), k, scope="label")


@query(f"WITH {_VECTORS} SELECT query_id, label, rank, node_seq, score FROM ranked WHERE rank <= 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _vector_ranked(spark, d, 10)


@query(f"""WITH {_VECTORS}, again AS (SELECT query_id, label, node_seq, rank AS first_rank, round(list_dot_product(list_transform(a, lambda v: abs(v))::DOUBLE[], list_transform(b, lambda v: abs(v))::DOUBLE[]), 6) + 0.0 AS score FROM ranked WHERE rank <= 40),
two AS (SELECT query_id, label, node_seq, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank)::INTEGER AS rank FROM again)
SELECT * FROM two WHERE rank <= 10""")
def vector_rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    """40 by cosine, then 10 by another score of the pair."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id"), F.transform("embedding", F.abs).alias("e"))
    some = _vector_ranked(spark, d, 40)
    a, b = rows.select(F.col("vec_id").alias("query_id"), F.col("e").alias("a")), rows.select(F.col("vec_id").alias("node_seq"), F.col("e").alias("b"))
    both = some.join(a, "query_id").join(b, "node_seq")
    return r.reranked(both, F.round(r.dot(F.col("a"), F.col("b")), 6) + 0.0, 10).select("query_id", "label", "node_seq", "score", "rank")


_HASHED = "list_transform(range(64), lambda i: len(list_filter({}, lambda h: h = i))::DOUBLE)"
_HASHES = "list_transform({}, lambda w: ('0x' || substr(md5(w), 1, 6))::BIGINT % 64)"


@query(rf"""WITH {BM25},
few20 AS (SELECT query_id, document_id, r.node_id, r.node_seq, {_HASHES.format(TOKENS.format("content"))} AS hb, {_HASHES.format(TOKENS.format("query_text"))} AS ha FROM ranked r JOIN asked USING (query_id, document_id) JOIN nodes USING (document_id, node_seq) WHERE r.rank <= 20),
vec AS (SELECT query_id, document_id, node_id, node_seq, {_HASHED.format("ha")} AS a, {_HASHED.format("hb")} AS b FROM few20),
s AS (SELECT query_id, document_id, node_id, node_seq, round(coalesce(CASE WHEN list_sum(a) > 0 AND list_sum(b) > 0 THEN {_COSINE} END, 0), 6) + 0.0 AS score FROM vec),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_seq)::INTEGER AS rank FROM s)
SELECT query_id, document_id, rank, node_id, node_seq, score FROM o WHERE rank <= 5""")
def hybrid_bm25_then_vector(spark: SparkSession, d: str) -> DataFrame:
    return r.hybrid(_asked(spark, d), _nodes(spark, d), 5, 20)


@query(f"""WITH {BM25}, top AS (SELECT * FROM ranked WHERE rank <= 5)
SELECT query_id, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS context, sum(len(regexp_split_to_array(content, '\\s+')))::BIGINT AS context_tokens FROM top JOIN nodes USING (node_id) GROUP BY ALL""")
def context_mass(spark: SparkSession, d: str) -> DataFrame:
    return n.hydrated(_ranked(spark, d, 5), _nodes(spark, d))


@query(f"""WITH {NODES} SELECT document_id, list(node_id ORDER BY node_seq) AS retrieved_node_ids, sum(len(regexp_split_to_array(content, '\\s+')))::INTEGER AS context_tokens FROM nodes GROUP BY ALL""")
def full_context(spark: SparkSession, d: str) -> DataFrame:
    return n.whole_documents(_nodes(spark, d))


_ANSWERS = rf"""{BM25},
first AS (SELECT query_id, node_id, array_to_string(regexp_split_to_array(content, '\s+')[:40], ' ') || ' [[node:' || node_id || ']]' AS pipeline_output FROM ranked JOIN nodes USING (node_id) WHERE rank = 1),
answers AS (SELECT query_id, query_text, gt_citations, item_id, coalesce(pipeline_output, '') AS pipeline_output, regexp_extract_all(coalesce(pipeline_output, ''), '\[\[node:([\w\-]+)\]\]', 1) AS cited FROM asked LEFT JOIN first USING (query_id))"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    asked, nodes = _asked(spark, d), _nodes(spark, d)
    contexts = r.bm25(asked, nodes, 1).join(nodes.select("node_id", "content"), "node_id")
    return x.extractive_answers(contexts, asked).join(asked.select("query_id", "query_text", "gt_citations"), "query_id")


@query(rf"""WITH {_ANSWERS} SELECT query_id, pipeline_output, cited AS cited_node_ids, (len(list_filter(cited, lambda c: NOT list_contains(gt_citations, c))) = 0)::INTEGER AS citation_match FROM answers""")
def citation_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = _answers(spark, d)
    return rows.select("query_id", "pipeline_output", "cited_node_ids", m.citation_match(F.col("cited_node_ids"), F.col("gt_citations")).alias("citation_match"))


_PAIRS = f"""pairs AS (SELECT conv_id, turn, text AS q, lead(text) OVER w AS a, lead(role) OVER w AS next, role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
tok AS (SELECT conv_id, turn, {TOKENS.format("a")} AS a, {TOKENS.format("q")} AS b FROM pairs WHERE role = 'user' AND next = 'assistant'),
f1 AS (SELECT conv_id, turn, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE
 2.0 * coalesce(list_sum(list_transform(list_intersect(a, b), lambda w: least(len(list_filter(a, lambda v: v = w)), len(list_filter(b, lambda v: v = w))))), 0) / (len(a) + len(b)) END AS f FROM tok)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("q"), F.lead("text").over(order).alias("a"), F.lead("role").over(order).alias("next"))
    return rows.where("role = 'user' AND next = 'assistant'")


@query(f"WITH {_PAIRS} SELECT conv_id, turn, round(f, 6)::DOUBLE AS token_f1 FROM f1")
def token_f1(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("conv_id", "turn", F.round(t.token_f1(F.col("a"), F.col("q")), 6).alias("token_f1"))


@query(f"WITH {_PAIRS} SELECT conv_id, turn, round(1 + 9 * f)::INTEGER AS judge_score FROM f1")
def stand_in_judge(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("conv_id", "turn", x.stand_in_judge(F.col("a"), F.col("q")).alias("judge_score"))


@query("""WITH v AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS v FROM orders)
SELECT o_orderkey, 'Q' || (1 + o_orderkey % 4) AS quadrant, CASE WHEN o_orderkey % 4 IN (0, 2) THEN
 (CASE WHEN v = 0 THEN v + o_orderkey % 3 * (v // 120) = 0 ELSE abs(v + o_orderkey % 3 * (v // 120) - v) <= 0.01::DECIMAL(10, 6) * v END)::INTEGER END AS exact_match FROM v""")
def exact_match_numeric(spark: SparkSession, d: str) -> DataFrame:
    """An amount in dollars against the same amount in thousands, a little off for two orders of three."""
    rows = table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("v"))
    off = F.col("v") + F.col("o_orderkey") % 3 * F.floor(F.col("v") / 120)
    said = F.concat(F.lit("It was $"), F.format_number((off / 1000).cast("decimal(20,3)"), 3), F.lit(" thousand [[node:x]]."))
    truth, quadrant = F.concat(F.lit("$"), F.format_number("v", 0)), F.concat(F.lit("Q"), (1 + F.col("o_orderkey") % 4).cast("string"))
    return rows.select("o_orderkey", quadrant.alias("quadrant"), t.exact_match(said, truth, quadrant).alias("exact_match"))


_CELLS = "cells AS (SELECT 'PQ' AS source_set, item_id::VARCHAR AS query_id, p AS pipeline, k AS k_value FROM benchmark, (VALUES ('P1'), ('P2'), ('P3')) AS ps(p), (VALUES (3), (5), (10)) AS ks(k))"
_DONE = "(query_id::BIGINT * 7 + k_value) % 3 = 0 AND pipeline <> 'P3'"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return x.matrix(table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id")))


@query(f"WITH {_CELLS} SELECT * FROM cells")
def matrix_900(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d)


@query(f"WITH {_CELLS}, done AS (SELECT * FROM cells WHERE {_DONE}) SELECT cells.* FROM cells ANTI JOIN done USING (source_set, query_id, pipeline, k_value)")
def resume_remaining(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    return x.remaining(cells, cells.where(_DONE))


@query(f"WITH {_CELLS} SELECT source_set, count(*) AS expected, count(*) FILTER ({_DONE}) AS present FROM cells GROUP BY ALL")
def matrix_completeness(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    return x.completeness(cells, cells.where(_DONE))


@query(rf"""WITH {ASKED}, cited AS (SELECT query_id, unnest(list_append(gt_citations, document_id || '_n9999')) AS node_id FROM asked)
SELECT DISTINCT query_id, node_id FROM cited WHERE node_id NOT IN (SELECT node_id FROM nodes)""")
def soft_fk_violations(spark: SparkSession, d: str) -> DataFrame:
    asked = _asked(spark, d)
    rows = asked.withColumn("ids", F.array_append("gt_citations", F.concat(F.col("document_id").cast("string"), F.lit("_n9999"))))
    return x.missing_ids(rows, "ids", _nodes(spark, d))


@query("SELECT o_custkey AS query_id, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderstatus) > 1")
def disjointness_violations(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose orders are in more than one status: the check that question sets are disjoint, over a large table."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), "o_orderstatus")
    return x.shared({s: rows.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P")})


@query("""SELECT rule, n FROM (SELECT count(*) FILTER (NOT l_quantity BETWEEN 1 AND 50) AS quantity, count(*) FILTER (NOT l_discount BETWEEN 0 AND 0.05) AS discount, count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS flag FROM lineitem)
UNPIVOT (n FOR rule IN (quantity, discount, flag))""")
def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    rules = {"quantity": F.col("l_quantity").between(1, 50), "discount": F.col("l_discount").between(0, 0.05), "flag": F.col("l_returnflag").isin("A", "N")}
    return x.violations(table(spark, d, "lineitem"), rules)


@query("""WITH p AS (SELECT item_id, 'Q' || (1 + item_id % 4) AS quadrant, row_number() OVER (PARTITION BY item_id % 4 ORDER BY md5(item_id::VARCHAR || ':1'), item_id) AS place FROM benchmark)
SELECT item_id, quadrant, CASE WHEN place <= 25 THEN 'PQ' WHEN place <= 30 THEN 'GQ' WHEN place <= 35 THEN 'JEQ' END AS split FROM p""")
def split_25_5_5(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("Q"), (1 + F.col("item_id") % 4).cast("string")).alias("quadrant"))
    return x.split(rows, {"PQ": 25, "GQ": 5, "JEQ": 5}, key="item_id")


@query(rf"""WITH {ASKED} SELECT query_id, item_id % 3 <> 0 AND item_id % 2 = 0 AS accepted FROM asked""")
def cross_check(spark: SparkSession, d: str) -> DataFrame:
    """A critic that cites another node for each third item and gives another value for odd ones."""
    asked = _asked(spark, d).withColumn("item", F.split("query_id", "_")[1].cast("long"))
    a = asked.select("query_id", F.col("gt_citations").alias("citations"), F.format_string("$%d million", F.col("item") + 100).alias("answer"))
    b = asked.select("query_id", F.when(F.col("item") % 3 != 0, F.col("gt_citations")).otherwise(F.array(F.lit("x"))).alias("citations"), F.format_string("%d,000,000", F.col("item") + 100 + F.col("item") % 2 * 50).alias("answer"))
    return x.cross_checked(a, b)


@query("""WITH g AS (SELECT p_partkey, p_name, p_type, p_size, 'Q' || (1 + p_partkey % 4) AS quadrant, row_number() OVER (PARTITION BY p_partkey % 4 ORDER BY p_partkey) AS place FROM part)
SELECT quadrant, 'Score the answer.' || chr(10) || chr(10) || string_agg('Q: ' || p_name || chr(10) || 'A: ' || p_type || chr(10) || 'Score: ' || p_size, chr(10) || chr(10) ORDER BY p_partkey) AS prefix FROM g WHERE place <= 5 GROUP BY ALL""")
def fewshot_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The prefix has the first five exemplars of a quadrant, of all there are."""
    golden = table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("Q"), (1 + F.col("p_partkey") % 4).cast("string")).alias("quadrant"), F.col("p_name").alias("query_text"), F.col("p_type").alias("ground_truth_answer"), F.col("p_size").alias("human_score"))
    return x.prompt_prefixes(x.first_each(golden, 5), "Score the answer.")


@query("""SELECT count(*) AS n, round(avg((abs(quality - toxic) <= 0)::INTEGER), 6) AS agreement, round(avg((abs(quality - toxic) <= 0)::INTEGER), 6) > 0.8 AS passed FROM labels""")
def judge_agreement(spark: SparkSession, d: str) -> DataFrame:
    return x.gate(table(spark, d, "labels").select(F.col("quality").alias("human_score"), F.col("toxic").alias("judge_score")))


_RESULTS = rf"""{METRICS}, results AS (SELECT metrics.*, 'Q' || (1 + item_id % 4) AS quadrant, 'P2' AS pipeline, 10 + k_value AS output_tokens, round(precision_at_k / 2, 6) AS token_f1 FROM metrics)"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    """P2's cells with their scores; quadrants and answers' sizes are stand-ins."""
    asked = _asked(spark, d)
    rows = x.retrieval_metrics(_ranked(spark, d, asked=asked), asked)
    item = F.split("query_id", "_")[1].cast("long")
    rows = rows.withColumns({"source_set": F.lit("PQ"), "pipeline": F.lit("P2"), "output_tokens": 10 + F.col("k_value"), "token_f1": F.round(F.col("precision_at_k") / 2, 6), "q": F.concat(F.lit("Q"), (1 + item % 4).cast("string"))})
    pq = rows.select("query_id", F.col("q").alias("quadrant")).distinct()
    return x.with_quadrant(rows.drop("q"), pq, pq.limit(0))


_MEANS = "count(*) AS n, round(avg(precision_at_k), 6) AS mean_precision_at_k, round(avg(recall_at_k), 6) AS mean_recall_at_k, round(avg(evidence_hit), 6) AS mean_evidence_hit"


@query(f"WITH {_RESULTS} SELECT pipeline, k_value, quadrant, {_MEANS}, round(avg(token_f1), 6) AS mean_token_f1, sum(output_tokens)::BIGINT AS output_tokens FROM results GROUP BY pipeline, k_value, quadrant")
def tri_pillar_by_quadrant(spark: SparkSession, d: str) -> DataFrame:
    return x.summary(_results(spark, d), "pipeline", "k_value", "quadrant")


@query(f"WITH {_RESULTS} SELECT pipeline, k_value, quadrant, {_MEANS} FROM results GROUP BY CUBE (pipeline, k_value, quadrant)")
def tri_pillar_cube(spark: SparkSession, d: str) -> DataFrame:
    return x.summary_cube(_results(spark, d), "pipeline", "k_value", "quadrant")


@query(rf"""WITH RECURSIVE {NODES}, tree AS (
  SELECT document_id, 0 AS level, (node_seq - 1)::BIGINT AS pos, count(*) OVER (PARTITION BY document_id) AS width FROM nodes
  UNION ALL SELECT DISTINCT document_id, level + 1, pos // 10, ((width + 9) // 10)::BIGINT FROM tree WHERE width > 1
) SELECT document_id, level, pos, CASE WHEN width > 1 THEN pos // 10 END AS parent FROM tree""")
def tree_levels(spark: SparkSession, d: str) -> DataFrame:
    return r.tree_levels(_nodes(spark, d))


def _tree_sql(where: str = "") -> str:
    """Words of every node of the trees: leaves, then as many levels of parents as any document of the tables needs."""
    levels = "".join(f""",
t{k} AS (SELECT document_id, {k} AS level, pos // 10 AS pos, flatten(list(words[:5] ORDER BY pos)) AS words FROM t{k - 1} WHERE document_id IN (SELECT document_id FROM t{k - 1} WHERE pos > 0) GROUP BY document_id, pos // 10)""" for k in range(1, _LEVELS + 1))
    return f"""t0 AS (SELECT document_id, 0 AS level, (node_seq - 1)::BIGINT AS pos, {TOKENS.format("content")} AS words FROM nodes {where}){levels},
tree AS ({" UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(_LEVELS + 1))}),
tops AS (SELECT document_id, max(level) AS level FROM tree GROUP BY document_id)"""


def _descend_sql() -> str:
    """From the roots down: two children are held at each level, all leaves met at the end."""
    out = ""
    for k in range(_LEVELS, 0, -1):
        above = f" UNION ALL SELECT query_id, document_id, q, pos FROM b{k + 1}" if k < _LEVELS else ""
        out += f""",
h{k} AS (SELECT query_id, document_id, q, 0 AS pos FROM wanted JOIN tops USING (document_id) WHERE level = {k}{above}),
m{k} AS (SELECT query_id, document_id, q, t.pos, len(list_intersect(q, t.words))::DOUBLE AS score FROM h{k} JOIN t{k - 1} t USING (document_id) WHERE t.pos // 10 = h{k}.pos),
b{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS place FROM m{k}) WHERE place <= 2)"""
    return f"""wanted AS (SELECT query_id, document_id, list_distinct({TOKENS.format("query_text")}) AS q FROM asked){out},
leaves AS (SELECT query_id, document_id, (pos + 1)::INTEGER AS node_seq, score FROM m1 UNION ALL
  SELECT query_id, document_id, 1, len(list_intersect(q, words))::DOUBLE FROM wanted JOIN tops USING (document_id) JOIN t0 USING (document_id) WHERE tops.level = 0),
by_tree AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_seq)::INTEGER AS rank FROM leaves)"""



@query(f"WITH {ASKED}, {_tree_sql('WHERE document_id IN (SELECT document_id FROM asked)')}, {_descend_sql()} SELECT query_id, document_id, rank, node_seq, score FROM by_tree WHERE rank <= 10")
def tree_topk(spark: SparkSession, d: str) -> DataFrame:
    return r.by_tree(_asked(spark, d), _nodes(spark, d), 10)


_CALL = "'call ' || event_id || CASE WHEN event_id % 5 = 0 THEN ' -- of ' || user_id ELSE '' END"
_STATUS = "['success', 'partial', 'failure'][1 + user_id % 3]"


@query(f"""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || lpad((millisecond(ts) % 1000)::VARCHAR, 3, '0') AS timestamp, 'INFO' AS level, event_type AS operation, 'user (' || user_id || ')' AS tool, {_CALL} AS summary, {_STATUS} AS status,
 CASE WHEN event_id % 3 = 0 THEN 'b' || user_id END AS branch, CASE WHEN event_id % 4 = 0 THEN ['a.py', 'c/' || user_id] ELSE [] END AS files, event_type || ': ' || event_id AS details, event_id::VARCHAR AS event, NULL::VARCHAR AS fragment FROM events""")
def log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Events written as log entries, in files, and read back."""
    folder = scratch(spark, "log")
    logs.append(_entries(spark, d), folder)
    back = logs.parsed(logs.read(spark, folder))
    return back.select("timestamp", "level", "operation", "tool", "summary", "status", "branch", "files", "details", F.col("extra")["event"].alias("event"), "fragment")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    event, user = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    summary = F.concat(F.lit("call "), event, F.when(F.col("event_id") % 5 == 0, F.concat(F.lit(" -- of "), user)).otherwise(""))
    return table(spark, d, "events").select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS").alias("timestamp"), F.lit("INFO").alias("level"), F.col("event_type").alias("operation"), F.concat(F.lit("user ("), user, F.lit(")")).alias("tool"),
        summary.alias("summary"), F.get(F.array(*map(F.lit, ("success", "partial", "failure"))), (F.col("user_id") % 3).cast("int")).alias("status"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("b"), user)).alias("branch"), F.lit("").alias("task"),
        F.when(F.col("event_id") % 4 == 0, F.array(F.lit("a.py"), F.concat(F.lit("c/"), user))).otherwise(F.array().cast("array<string>")).alias("files"),
        F.concat("event_type", F.lit(": "), event).alias("details"), F.create_map(F.lit("event"), event).alias("extra"),
    )


@query(None)
def html_to_nodes(spark: SparkSession, d: str) -> DataFrame:
    return n.from_markdown(store.parsed_pages(table(spark, d, "pages")))


@query(f"""WITH e AS (SELECT {_STATUS} AS status, strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || lpad((millisecond(ts) % 1000)::VARCHAR, 3, '0') AS moment, {_CALL} AS summary FROM events)
SELECT status, count(*) AS n, max_by(summary, (moment, summary)) AS latest FROM e GROUP BY status""")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return logs.activity(_entries(spark, d))


@query("SELECT event_id, user_id, coalesce(ts::DATE <> lag(ts::DATE) OVER (PARTITION BY user_id ORDER BY ts, event_id), true) AS new_day FROM events")
def day_divider(spark: SparkSession, d: str) -> DataFrame:
    return x.day_dividers(table(spark, d, "events"), "ts", "user_id", "event_id").select("event_id", "user_id", "new_day")


@query("""WITH e AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day, event_type FROM events),
first AS (SELECT day || '-' || event_type || '-' || user_id || '.html' AS file, min_by(event_id, event_id) AS event_id, any_value(day) AS day FROM e WHERE event_id % 2 = 0 GROUP BY 1),
lone AS (SELECT DISTINCT day || '-' || event_type || '-' || user_id || '.html' AS file, day FROM e WHERE file NOT IN (SELECT file FROM first))
SELECT day AS date, file, 'R & D <' || event_id || '>' AS title, 'about ' || event_id || '; "it"' AS description FROM first UNION ALL SELECT day, file, 'Report ' || file, '' FROM lone""")
def report_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Events as rows of a day's index page, some escaped twice, and as report files; then the manifest read from both."""
    rows = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    file = F.concat_ws("-", "day", "event_type", F.concat(F.col("user_id").cast("string"), F.lit(".html")))
    event = F.col("event_id").cast("string")
    title = F.concat(F.lit("R & D <"), event, F.lit(">"))
    title = F.when(F.col("event_id") % 4 == 0, reports.escaped(reports.escaped(title))).otherwise(reports.escaped(title))
    row = F.concat(F.lit('<td class="timestamp">12:00</td>\n<td><a href="reports/'), file, F.lit('">'), title, F.lit('</a></td> <td class="description"> about '), event, F.lit("; &quot;it&quot; </td>"))
    in_index = rows.where("event_id % 2 = 0").select("day", F.floor(F.col("event_id") / 1_000).alias("part"), "event_id", row.alias("row")).groupBy("day", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "row"))), lambda e: e.row), "<tr>").alias("value"))
    # a page has 500 events at most, and a day as many pages as it takes, in the order of events
    pages = in_index.select((F.datediff(F.to_date("day"), F.lit("2000-01-01").cast("date")) * F.lit(10**12) + F.col("part")).alias("page"), "value")
    files = rows.select(file.alias("file")).distinct().select("file", F.concat(F.lit("<h1>Report\n "), F.col("file"), F.lit("</h1>")).alias("value"))
    return reports.seeded(pages, files)


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS p FROM events) WHERE p > 100")
def newest_n_dropped(spark: SparkSession, d: str) -> DataFrame:
    return x.without_newest(table(spark, d, "events").select("event_id", "ts"), 100, "ts", "event_id").select("event_id")


@query("SELECT c_custkey AS key, c_name AS value FROM customer UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)")
def additive_merge(spark: SparkSession, d: str) -> DataFrame:
    """Customers are there; parts come in under the keys that no customer has."""
    existing = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    return x.merged_by_key(existing, table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value")))


@query("""SELECT key, min_by(name, (part, pos)) AS name FROM (SELECT o_custkey AS key, o_orderpriority AS name, 0 AS part, o_orderkey AS pos FROM orders UNION ALL SELECT c_custkey, c_name, 1, c_custkey FROM customer) GROUP BY ALL""")
def seeded_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The priority of a customer's first order, or the name of one without orders."""
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("pos"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_custkey").alias("pos"))
    return x.first_by_key([a, b], "key").drop("pos")


@query(f"WITH {NODES}, c AS (SELECT document_id, count(*) AS n_nodes FROM nodes GROUP BY ALL) SELECT document_id::VARCHAR AS document_id, n_nodes, document_id % 3 = 0 AS skipped FROM c")
def ingestion(spark: SparkSession, d: str) -> DataFrame:
    """A run over a third of the documents, then one over all, which skips those."""
    docs, root = table(spark, d, "documents"), scratch(spark, "store")
    build = lambda rows: n.from_lines(rows).withColumns({"parent_item_header": F.lit(None).cast("string"), "source_page_num": F.lit(None).cast("int")})
    runs.ingest(spark, docs.where("doc_id % 3 = 0"), build, root, "doc_id")
    return runs.ingest(spark, docs, build, root, "doc_id")


@query(rf"""WITH {NODES}, {_tree_sql()}, spent AS (
  SELECT document_id, coalesce(sum(len(words)) FILTER (tree.level < tops.level), 0)::BIGINT AS input_tokens, coalesce(sum(len(words)) FILTER (tree.level > 0), 0)::BIGINT AS output_tokens FROM tree JOIN tops USING (document_id) GROUP BY document_id)
SELECT document_id::VARCHAR AS document_id, 1::BIGINT AS builds, (document_id % 2 = 0)::BIGINT AS skips, true AS timed, input_tokens, output_tokens FROM spent""")
def tree_build_costs(spark: SparkSession, d: str) -> DataFrame:
    """Trees of half of the documents, then of all, with the costs of both runs from their log."""
    root = scratch(spark, "trees")
    nodes = _nodes(spark, d).withColumn("document_id", F.col("document_id").cast("string"))
    documents = nodes.select("document_id").distinct()
    for run, some in enumerate((documents.where("CAST(document_id AS long) % 2 = 0"), documents), 1):
        store.log_costs(runs.build_trees(spark, some, nodes, root, run), f"{root}/costs")
    out = x.costs_by_document(store.costs(spark, f"{root}/costs"))
    return out.select("document_id", "builds", "skips", (F.col("wall_clock_sec") > 0).alias("timed"), "input_tokens", "output_tokens")


@query("SELECT ts::DATE AS day, event_type AS role, count(*) AS n, sum(user_id)::BIGINT AS input_tokens, sum(event_id % 100)::BIGINT AS output_tokens, round(avg(value), 6) AS mean_latency_sec FROM events GROUP BY ALL")
def usage_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Calls by day and role: tokens sent and received, and how long they took."""
    calls = table(spark, d, "events").select("ts", F.col("event_type").alias("role"), F.col("user_id").alias("input_tokens"), (F.col("event_id") % 100).alias("output_tokens"), F.col("value").alias("latency_sec"))
    return x.usage_by_day(calls)


@query("SELECT 'Q' || (1 + doc_id % 4) AS quadrant, count(*) AS tried, count(*) FILTER (quality = 1) AS kept, round(avg((quality = 1)::INTEGER), 6) AS share FROM labels GROUP BY ALL")
def generation_yield(spark: SparkSession, d: str) -> DataFrame:
    return x.yields(table(spark, d, "labels").select(F.concat(F.lit("Q"), (1 + F.col("doc_id") % 4).cast("string")).alias("quadrant"), (F.col("quality") == 1).alias("accepted")))


@query(f"""WITH {NODES}, s AS (SELECT * FROM nodes ORDER BY md5(node_id || ':7'), node_id LIMIT 20)
SELECT '# Parsing Validation Audit' || chr(10) || chr(10) || 'Sampled ' || count(*) || ' node(s) for manual review.' || chr(10) || chr(10) || string_agg('## ' || node_id || ' (text)' || chr(10) || '- Document: ' || document_id || chr(10) || '- Section: (none)' || chr(10) || '- Token count: ' || len(regexp_split_to_array(content, '\\s+')) || chr(10) || chr(10) || '```' || chr(10) || content || chr(10) || '```' || chr(10), chr(10) ORDER BY node_id) AS value FROM s""")
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    return store.audit_report(x.audit_sample(_nodes(spark, d).withColumn("parent_item_header", F.lit(None).cast("string")), 20))


_PLAIN = r"trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}\s]', '', 'g'), '\s+', ' ', 'g'))"
_NEAR = rf"""hashed AS (SELECT query_id, document_id, query_text, content, node_id, node_seq, {_HASHES.format(TOKENS.format("content"))} AS hb, {_HASHES.format(TOKENS.format("query_text"))} AS ha FROM asked JOIN nodes USING (document_id)),
vectors AS (SELECT *, {_HASHED.format("ha")} AS a, {_HASHED.format("hb")} AS b FROM hashed),
scores AS (SELECT *, round(coalesce(CASE WHEN list_sum(a) > 0 AND list_sum(b) > 0 THEN {_COSINE} END, 0), 6) + 0.0 AS score FROM vectors),
near AS (SELECT query_id, document_id, query_text, content, node_id, node_seq, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_seq)::INTEGER AS rank FROM scores)"""


@query(rf"""WITH {ASKED}, {_NEAR} SELECT query_id, document_id, rank, node_seq, score FROM near WHERE rank <= 10""")
def tree_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """P3 as it is meant: the ten nearest nodes by vectors, found from the root of a tree of summaries down, the same as by comparing all."""
    asked, nodes = _asked(spark, d), _nodes(spark, d)
    some = nodes.join(asked.select("document_id").distinct(), "document_id", "left_semi")
    vectors = cut(some.select("document_id", "node_seq", r.hashed_vector(F.col("content")).alias("vector")))
    wanted = asked.select("query_id", "document_id", r.hashed_vector(F.col("query_text")).alias("query_vector"))
    return indexes.by_vector_tree(wanted, indexes.vector_tree(vectors), vectors, 10)


@query(f"WITH {_VECTORS} SELECT query_id, label, rank, node_seq, score FROM ranked WHERE rank <= 10")
def stored_vectors_topk(spark: SparkSession, d: str) -> DataFrame:
    """The rows of vector_topk, from lists of vectors that are written first; lists too far off are not searched."""
    rows, root = table(spark, d, "embeddings"), scratch(spark, "vectors")
    indexes.write_lists(rows.select("label", F.col("vec_id").alias("node_seq"), F.col("embedding").alias("vector")), root, scope="label")
    return indexes.in_lists(rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("query_vector")), root, 10, scope="label")


@query(f"WITH {BM25} SELECT query_id, document_id, rank, node_id, node_seq, score FROM ranked WHERE rank <= 10")
def stored_postings_topk(spark: SparkSession, d: str) -> DataFrame:
    """The rows of bm25_topk_k10, from postings of all documents that are written first; blocks that cannot hold one of the ten are not scored."""
    root = scratch(spark, "postings")
    indexes.write_postings(_nodes(spark, d), root)
    return indexes.in_postings(_asked(spark, d), root, 10)


_JEQ = "item_id % 5 = 0"
_QUOTED = r"array_to_string(regexp_split_to_array(context, '\s+')[:40], ' ')"
_RUN_CELLS = rf"""{BM25}, {_NEAR},
first AS (SELECT *, list_distinct({TOKENS.format("query_text")}) AS q, {TOKENS.format("content")} AS c FROM near WHERE rank <= {runs.FIRST}),
again AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN len(q) = 0 THEN 0.0 ELSE round(len(list_intersect(q, c)) / len(q), 6) END DESC, rank) AS rank FROM first),
lists AS (
  SELECT query_id, 'P1' AS pipeline, node_id, rank FROM again
  UNION ALL SELECT query_id, 'P2', node_id, rank FROM ranked
  UNION ALL SELECT query_id, 'P3', node_id, rank FROM near),
cells AS (
  SELECT 'PQ' AS source_set, query_id, item_id, p AS pipeline, k AS k_value FROM asked, (VALUES ('P1'), ('P2'), ('P3')) AS ps(p), (VALUES (3), (5), (10)) AS ks(k)
  UNION ALL SELECT 'JEQ', query_id, item_id, p, 5 FROM asked, (VALUES ('P1'), ('P2'), ('P3')) AS ps(p) WHERE {_JEQ}),
got AS (SELECT source_set, query_id, pipeline, k_value, list(node_id ORDER BY rank) AS ids, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS context
  FROM cells JOIN lists USING (query_id, pipeline) JOIN nodes USING (node_id) WHERE rank <= k_value AND NOT (source_set = 'PQ' AND pipeline = 'P1' AND k_value = 3) GROUP BY ALL),
said AS (SELECT got.*, gt_citations, query_text, item_id, array_to_string(regexp_split_to_array(context, '\s+')[:40], ' ') || ' [[node:' || ids[1] || ']]' AS output FROM got JOIN asked USING (query_id)),
tokens AS (SELECT *, {TOKENS.format(_QUOTED)} AS a, {TOKENS.format("query_text")} AS b FROM said),
graded AS (SELECT *, len(list_intersect(ids, gt_citations)) AS h, 2.0 * coalesce(list_sum(list_transform(list_intersect(a, b), lambda w: least(len(list_filter(a, lambda v: v = w)), len(list_filter(b, lambda v: v = w))))), 0) / (len(a) + len(b)) AS f FROM tokens)"""


@query(rf"""WITH {_RUN_CELLS}
SELECT source_set, query_id, pipeline, k_value, ids AS retrieved_node_ids, output AS pipeline_output, [ids[1]] AS cited_node_ids, round(h / k_value, 6) AS precision_at_k, round(h / len(gt_citations), 6) AS recall_at_k,
 (h > 0)::INTEGER AS evidence_hit, list_contains(gt_citations, ids[1])::INTEGER AS citation_match, round(f, 6)::DOUBLE AS token_f1, CASE WHEN item_id % 2 = 0 THEN ({_PLAIN.format(_QUOTED)} = {_PLAIN.format("query_text")})::INTEGER END AS exact_match, round(1 + 9 * f)::INTEGER AS judge_score,
 (len(regexp_split_to_array(query_text, '\s+')) + len(regexp_split_to_array(context, '\s+')))::INTEGER AS input_tokens, len(regexp_split_to_array(output, '\s+'))::INTEGER AS output_tokens FROM graded""")
def benchmark_cells(spark: SparkSession, d: str) -> DataFrame:
    """All cells of both question sets but those that an earlier run finished: three pipelines, retrieved, answered, cited and scored."""
    cells, asked, nodes = _cell_setup(spark, d)
    done = cells.where("source_set = 'PQ' AND pipeline = 'P1' AND k_value = 3")
    return runs.run_cells(cells, asked, nodes, done).drop("result_id", "human_score", "latency_sec")


def _cell_setup(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    asked = _asked(spark, d)
    item = F.split("query_id", "_")[1].cast("long")
    asked = asked.withColumns({"ground_truth_answer": F.col("query_text"), "quadrant": F.concat(F.lit("Q"), (1 + item % 4).cast("string"))})
    cells = x.matrix(asked).unionByName(x.matrix(asked.where(item % 5 == 0), "JEQ", ks=(5,)))
    return cells, asked, _nodes(spark, d)


@query(rf"""WITH {_RUN_CELLS}, q AS (SELECT *, 'Q' || (1 + item_id % 4) AS quadrant FROM graded)
SELECT source_set, pipeline, k_value, quadrant, count(*) AS n, round(avg(round(h / k_value, 6)), 6) AS mean_precision_at_k, round(avg(round(h / len(gt_citations), 6)), 6) AS mean_recall_at_k, round(avg((h > 0)::INTEGER), 6) AS mean_evidence_hit,
 round(avg(round(f, 6)), 6)::DOUBLE AS mean_token_f1, sum(len(regexp_split_to_array(output, '\s+')))::BIGINT AS output_tokens FROM q GROUP BY ALL""")
def benchmark_summary(spark: SparkSession, d: str) -> DataFrame:
    """The cells written to the store's results table, then read, given their quadrant by question set, and summed up."""
    cells, asked, nodes = _cell_setup(spark, d)
    root = scratch(spark, "store")
    store.create(spark, root)
    done = cells.where("source_set = 'PQ' AND pipeline = 'P1' AND k_value = 3")
    store.append(cut(runs.run_cells(cells, asked, nodes, done)), root, "results")
    quadrants = lambda some: cells.where(F.col("source_set") == some).select("query_id").distinct().join(asked.select("query_id", "quadrant"), "query_id")
    return x.summary(x.with_quadrant(store.read(spark, root, "results"), quadrants("PQ"), quadrants("JEQ")), "source_set", "pipeline", "k_value", "quadrant")


@query("SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def daily_usage(spark: SparkSession, d: str) -> DataFrame:
    return usage.daily(table(spark, d, "events"))


@query("SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def daily_usage_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same totals from a file stream read to its end."""
    return usage.drained(usage.daily(usage.stream(spark, d, "events.parquet")), ("day", "event_type"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, ts FROM events), chain AS (
  SELECT user_id, min(ts) AS t FROM e GROUP BY user_id UNION ALL SELECT c.user_id, min(e.ts) FROM chain c JOIN e ON e.user_id = c.user_id AND e.ts >= c.t + INTERVAL 48 HOUR GROUP BY c.user_id, c.t),
first AS (SELECT e.user_id, min(event_id) AS event_id FROM e JOIN chain c ON e.user_id = c.user_id AND e.ts = c.t GROUP BY e.user_id, e.ts)
SELECT event_id, user_id, event_id IN (SELECT event_id FROM first) AS parse FROM e""")
def fresh_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events as file events of a user's file, in four files by time, streamed: which find the last parse too old. State for 48 hours a file."""
    root, rows = scratch(spark, "fresh"), cut(table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")))
    lo, hi = (t_.timestamp() for t_ in rows.agg(F.min("ts"), F.max("ts")).first())
    at = F.least(F.lit(3), F.floor((F.unix_micros("ts") / 1e6 - lo) / max(1e-6, hi - lo) * 4))
    for k in range(4):  # one write after the other, as a stream takes files in their order of time
        rows.where(at == k).coalesce(1).write.mode("append").parquet(f"{root}/in")
    events = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    return resumable.collected(resumable.parses(events, "user_id", "event_id"), root).select("event_id", "user_id", "parse")


@query(rf"""WITH {_RUN_CELLS} SELECT source_set, query_id, pipeline, k_value, ids AS retrieved_node_ids, round(h / k_value, 6) AS precision_at_k, round(f, 6)::DOUBLE AS token_f1 FROM graded WHERE pipeline = 'P2'""")
def resumed_cells_stream(spark: SparkSession, d: str) -> DataFrame:
    """P2's cells as a stream of two files whose run dies after it has added the first batch; the next run goes on from there, and a third finds nothing to do."""
    cells, asked, nodes = _cell_setup(spark, d)
    cells, root = cells.where("pipeline = 'P2'"), scratch(spark, "resumed")
    for k in range(2):
        cells.where(F.pmod(F.xxhash64("query_id"), F.lit(2)) == k).coalesce(1).write.mode("append").parquet(f"{root}/cells")
    compute = lambda todo: runs.run_cells(todo, asked, nodes, todo.limit(0))

    def dying(todo: DataFrame) -> DataFrame:
        if store.read(spark, root, "results").limit(1).count():
            raise RuntimeError("dies in its second batch")
        return compute(todo)

    with contextlib.suppress(StreamingQueryException):
        resumable.run_stream(resumable.cell_stream(spark, f"{root}/cells"), root, dying, f"{root}/state")
    for _ in range(2):
        resumable.run_stream(resumable.cell_stream(spark, f"{root}/cells"), root, compute, f"{root}/state")
    return store.read(spark, root, "results").select(*x.CELL, "retrieved_node_ids", "precision_at_k", "token_f1")


_BUCKETS = f"""s AS (SELECT ts::DATE AS day, event_type AS role, CASE WHEN value > 0 THEN ceil(ln(value) / {math.log(latency.growth())})::INTEGER END AS bucket FROM events WHERE value IS NOT NULL),
r AS (SELECT 'all' AS span, role, bucket FROM s UNION ALL SELECT 'second week', role, bucket FROM s WHERE day BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'),
m AS (SELECT span, role, bucket, count(*) AS n FROM r GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY span, role) AS total, sum(n) OVER (PARTITION BY span, role ORDER BY bucket NULLS FIRST) AS upto, coalesce(round(2 * pow({latency.growth()}, bucket) / ({latency.growth()} + 1), 6), 0.0) AS v FROM m)"""


@query(f"""WITH {_BUCKETS} SELECT span, role, max(total)::BIGINT AS n, {", ".join(f"min(v) FILTER (upto >= ceil(total * {q}))::DOUBLE AS q{q * 100:g}" for q in (0.5, 0.9, 0.99))} FROM c GROUP BY span, role""")
def latency_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Latency quantiles by role, of all days and of one week, from sketches stored by day in two batches: each within one per cent of the exact one."""
    path, calls = scratch(spark, "latency"), table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("role"), F.col("value").alias("latency_sec"))
    for k in range(2):
        latency.keep(calls.where(F.col("event_id") % 2 == k), path, f"half-{k}")
    spans = {"all": latency.kept(spark, path), "second week": latency.kept(spark, path, "2024-01-08", "2024-01-14")}
    return reduce(DataFrame.unionByName, (latency.quantiles(rows).select(F.lit(span).alias("span"), "*") for span, rows in spans.items()))


@query("""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || lpad((millisecond(ts) % 1000)::VARCHAR, 3, '0') AS timestamp, event_type AS operation, 'user (' || user_id || ')' AS tool, event_type || ': ' || event_id AS details, event_id::VARCHAR AS event FROM events WHERE ts >= TIMESTAMP '2024-01-20'""")
def log_source_since(spark: SparkSession, d: str) -> DataFrame:
    """Events written as log entries through the data source for logs, and read back by ranges of bytes from a day on."""
    landed.register(spark)
    folder = scratch(spark, "logs")
    entries = _entries(spark, d)
    logs.rendered(entries).select(F.lit(None).cast("string").alias("timestamp"), "value").write.format("operation_log").mode("append").save(folder)
    blocks = spark.read.format("operation_log").option("size", 256 << 10).option("since", "2024-01-20").load(folder)
    return logs.parsed(blocks.select("value")).select("timestamp", "operation", "tool", "details", F.col("extra")["event"].alias("event"))


_BUDGET = 120


@query(rf"""WITH RECURSIVE {NODES}, t AS (SELECT document_id, node_seq, len(regexp_split_to_array(content, '\s+')) AS n FROM nodes),
p AS (SELECT document_id, node_seq, n AS used, 0 AS chunk FROM t WHERE node_seq = 1 UNION ALL
  SELECT t.document_id, t.node_seq, CASE WHEN used > 0 AND used + n > {_BUDGET} THEN n ELSE used + n END, chunk + CASE WHEN used > 0 AND used + n > {_BUDGET} THEN 1 ELSE 0 END FROM p JOIN t ON t.document_id = p.document_id AND t.node_seq = p.node_seq + 1)
SELECT document_id, node_seq, chunk::INTEGER AS chunk FROM p""")
def packed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Nodes packed into chunks of 120 tokens, greedily."""
    return _packed(spark, d).select("document_id", "node_seq", "chunk")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return generation.packed(_nodes(spark, d).withColumn("parent_item_header", F.lit(None).cast("string")), _BUDGET)


@query(None)
def generated_sets(spark: SparkSession, d: str) -> DataFrame:
    """Three disjoint question sets over the chunks of all documents, 25, 5 and 5 questions for each quadrant, in rounds of proposals and blind criticism."""
    return generation.generated(generation.chunks(_packed(spark, d)), _nodes(spark, d))[0].select("set", "query_id", "chunk_id", "document_id", "quadrant", "query_text", "answer", "citations")


@query(None)
def generation_rounds(spark: SparkSession, d: str) -> DataFrame:
    """What each round of that generation tried and kept."""
    return generation.generated(generation.chunks(_packed(spark, d)), _nodes(spark, d))[1]


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Top three nodes for each question, beside the scores of the list they are in."""
    asked = _asked(spark, d)
    ranked = _ranked(spark, d, asked=asked)
    return ranked.where("rank <= 3").join(x.retrieval_metrics(ranked, asked, (3,)), "query_id")
