"""The experiment around retrieval: cells, resuming, checks, answers, judging, splits and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks import schemas
from lodeworks.functions import metrics as m
from lodeworks.functions import text as t
from lodeworks.runtime import few, unused

CELL = ["source_set", "query_id", "pipeline", "k_value"]


def matrix(queries: DataFrame, source_set: str = "PQ", pipelines=schemas.PIPELINES, ks=schemas.K_VALUES) -> DataFrame:
    """One row for each question, pipeline and K: literal lists exploded within each row."""
    rows = queries.select("query_id", F.explode(F.array(*map(F.lit, pipelines))).alias("pipeline"))
    return rows.select(F.lit(source_set).alias("source_set"), "query_id", "pipeline", F.explode(F.array(*map(F.lit, ks))).alias("k_value"))


def remaining(cells: DataFrame, done: DataFrame) -> DataFrame:
    """Cells that no finished row has."""
    return cells.join(done.select(CELL).distinct(), CELL, "left_anti")


def missing_ids(rows: DataFrame, ids: str, nodes: DataFrame) -> DataFrame:
    """query_id, node_id of ids that are no node."""
    return rows.select("query_id", F.explode(ids).alias("node_id")).distinct().join(nodes.select("node_id"), "node_id", "left_anti").select("query_id", "node_id")


def shared(sets: dict[str, DataFrame], key: str = "query_id") -> DataFrame:
    """key, n of keys that more than one set has."""
    rows = reduce(DataFrame.unionByName, (d.select(key, F.lit(name).alias("set")) for name, d in sets.items()))
    return rows.groupBy(key).agg(F.count_distinct("set").alias("n")).where("n > 1")


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n: how many rows break each rule; a null outcome breaks none. One pass."""
    counts = rows.agg(*(F.count_if(~rule).alias(name) for name, rule in rules.items()))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in rules))))


def result_rules() -> dict[str, Column]:
    return {
        "source_set": F.col("source_set").isin(*schemas.SOURCE_SETS), "pipeline": F.col("pipeline").isin(*schemas.PIPELINES), "k_value": F.col("k_value").isin(*schemas.K_VALUES),
        "precision": F.col("precision_at_k").between(0, 1), "recall": F.col("recall_at_k").between(0, 1),
        "judge_score": F.col("judge_score").between(1, 10), "human_score": F.col("human_score").between(1, 10),
    }


def retrieval_metrics(ranked: DataFrame, asked: DataFrame, ks=schemas.K_VALUES) -> DataFrame:
    """query_id, k_value and scores, for every question and K. ranked: query_id, rank, node_id, up to the largest K."""
    lists = ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_id"))), lambda x: x.node_id).alias("retrieved"))
    rows = asked.select("query_id", "gt_citations").join(lists, "query_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<string>")))
    rows = rows.withColumn("k_value", F.explode(F.array(*map(F.lit, ks))))
    got, truth, k = F.col("retrieved"), F.col("gt_citations"), F.col("k_value")
    return rows.select(
        "query_id", "k_value", F.round(m.precision_at_k(got, truth, k), 6).alias("precision_at_k"), F.round(m.recall_at_k(got, truth, k), 6).alias("recall_at_k"), m.evidence_hit(got, truth, k).alias("evidence_hit")
    )


def extractive_answers(contexts: DataFrame, asked: DataFrame, most: int = 40) -> DataFrame:
    """A deterministic stand-in for an answerer: it sees a question and its own nodes, and quotes the first node's first words with its id."""
    rows = asked.select("query_id", "query_text").join(contexts.where("rank = 1").select("query_id", "node_id", "content"), "query_id", "left")
    text = F.array_join(F.slice(F.split("content", t.GAPS), 1, most), " ")
    answer = F.coalesce(F.concat(text, F.lit(" [[node:"), F.col("node_id"), F.lit("]]")), F.lit(""))
    return rows.select("query_id", answer.alias("pipeline_output"), t.citations(answer).alias("cited_node_ids"), F.size(F.split("query_text", t.GAPS)).alias("input_tokens"), t.token_count(answer).alias("output_tokens"))


def stand_in_judge(output: Column, truth: Column) -> Column:
    """1 to 10 from token F1."""
    return F.round(1 + 9 * t.token_f1(output, truth)).cast("int")


def split(rows: DataFrame, sizes: dict[str, int], by: str = "quadrant", key: str = "query_id", seed: str = "1") -> DataFrame:
    """rows with `split`: within each group, in an order that a hash gives, the first rows to the first name, and so on; null beyond."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), F.col(key)))
    name, upto, (at,) = F.lit(None).cast("string"), sum(sizes.values()), unused(rows, "place")
    for split_name, n in reversed(sizes.items()):
        name, upto = F.when(F.col(at) <= upto, split_name).otherwise(name), upto - n
    return rows.withColumn(at, place).withColumn("split", name).drop(at)


def audit_sample(rows: DataFrame, n: int, key: str = "node_id", seed: str = "7") -> DataFrame:
    """n rows without replacement, the same ones each time; all rows if there are no more."""
    (order,) = unused(rows, "order")
    return rows.withColumn(order, F.md5(F.concat(F.col(key), F.lit(f":{seed}")).cast("binary"))).orderBy(order, key).limit(n).drop(order)


def throttled(rows: DataFrame, on: bool, order: str, n: int = 3) -> DataFrame:
    return rows.orderBy(order).limit(n) if on else rows


def cross_checked(generated: DataFrame, critic: DataFrame) -> DataFrame:
    """query_id, accepted: the critic cites a node that the generator cites and gives the same value."""
    a, b = generated.alias("a"), critic.alias("b")
    same = F.arrays_overlap("a.citations", "b.citations") & (t.exact_match(F.col("b.answer"), F.col("a.answer")) == 1)
    return a.join(b, "query_id", "left").select("query_id", F.coalesce(same, F.lit(False)).alias("accepted"))


def first_each(rows: DataFrame, n: int, by: str = "quadrant", key: str = "query_id") -> DataFrame:
    """The first n rows of each group, by key."""
    (at,) = unused(rows, "place")
    return rows.withColumn(at, F.row_number().over(Window.partitionBy(by).orderBy(key))).where(F.col(at) <= n).drop(at)


def prompts(prefixes: DataFrame, cells: DataFrame) -> DataFrame:
    """cells (quadrant, query_text, pipeline_output, ...) with prompt: the prefix of their quadrant, then the question and its output."""
    return cells.join(few(prefixes, 1_000), "quadrant").withColumn("prompt", F.concat("prefix", F.lit("\n\nQ: "), "query_text", F.lit("\nA: "), "pipeline_output", F.lit("\nScore:"))).drop("prefix")


def costs_by_document(costs: DataFrame) -> DataFrame:
    """document_id, builds, skips, wall_clock_sec, input_tokens, output_tokens: what building the trees took; skipped builds took nothing."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return costs.groupBy("document_id").agg(F.count_if(~F.col("skipped")).alias("builds"), F.count_if("skipped").alias("skips"), total("wall_clock_sec"), total("input_tokens"), total("output_tokens"))


def usage_by_day(calls: DataFrame) -> DataFrame:
    """day, role, n, input_tokens, output_tokens, mean_latency_sec of calls (ts, role, input_tokens, output_tokens, latency_sec)."""
    by = calls.groupBy(F.to_date("ts").alias("day"), "role")
    return by.agg(F.count("*").alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.avg("latency_sec"), 6).alias("mean_latency_sec"))


def yields(attempts: DataFrame) -> DataFrame:
    """quadrant, tried, kept, share: how many generated questions were accepted."""
    return attempts.groupBy("quadrant").agg(F.count("*").alias("tried"), F.count_if("accepted").alias("kept"), F.round(F.avg(F.col("accepted").cast("int")), 6).alias("share"))


def prompt_prefixes(golden: DataFrame, rubric: str, each: int = 5) -> DataFrame:
    """quadrant, prefix: the rubric and a quadrant's exemplars by id; a quadrant with another number of them fails."""
    line = F.concat(F.lit("Q: "), F.col("query_text"), F.lit("\nA: "), F.col("ground_truth_answer"), F.lit("\nScore: "), F.col("human_score").cast("string"))
    rows = golden.groupBy("quadrant").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("query_id", line.alias("line")))).alias("x"))
    checked = F.when(F.col("n") == each, F.array_join("x.line", "\n\n")).otherwise(F.raise_error(F.concat(F.lit("exemplars in "), F.col("quadrant"), F.lit(": "), F.col("n").cast("string"))))
    return rows.select("quadrant", F.concat(F.lit(rubric + "\n\n"), checked).alias("prefix"))


def gate(scored: DataFrame, tolerance: int = 0, least: float = 0.8) -> DataFrame:
    """n, agreement, passed: strictly above least."""
    return scored.agg(F.count("*").alias("n"), F.round(m.agreement(F.col("human_score"), F.col("judge_score"), tolerance), 6).alias("agreement")).withColumn("passed", F.col("agreement") > least)


def with_quadrant(results: DataFrame, pq: DataFrame, jeq: DataFrame) -> DataFrame:
    """results with the quadrant of their question, looked up in the set they come from."""
    both = pq.select(F.lit("PQ").alias("source_set"), "query_id", "quadrant").unionByName(jeq.select(F.lit("JEQ").alias("source_set"), "query_id", "quadrant"))
    return results.join(both, ["source_set", "query_id"])


def summary(results: DataFrame, *by: str) -> DataFrame:
    """Counts and means of the three groups of scores."""
    mean = lambda c, n=6: F.round(F.avg(c), n).alias(f"mean_{c}")
    return results.groupBy(*by).agg(F.count("*").alias("n"), mean("precision_at_k"), mean("recall_at_k"), mean("evidence_hit"), mean("token_f1"), F.sum("output_tokens").alias("output_tokens"))


def summary_cube(results: DataFrame, *by: str) -> DataFrame:
    mean = lambda c: F.round(F.avg(c), 6).alias(f"mean_{c}")
    return results.cube(*by).agg(F.count("*").alias("n"), mean("precision_at_k"), mean("recall_at_k"), mean("evidence_hit"))


def completeness(cells: DataFrame, results: DataFrame) -> DataFrame:
    """source_set, expected, present."""
    found = cells.join(results.select(*CELL, F.lit(1).alias("__there")).distinct(), CELL, "left")
    return found.groupBy("source_set").agg(F.count("*").alias("expected"), F.count("__there").alias("present"))


def families_differ(models: dict[str, str], *pairs: tuple[str, str]) -> None:
    """Fails if two roles that must differ have models of one family (the name before "/" or "-")."""
    family = lambda name: name.replace("/", "-").split("-")[0]
    for a, b in pairs:
        if family(models[a]) == family(models[b]):
            raise ValueError(f"{a} and {b} have models of one family: {models[a]}, {models[b]}")


def merged_by_key(existing: DataFrame, defaults: DataFrame, key: str = "key") -> DataFrame:
    """What exists, and the defaults whose key does not; nothing is changed or removed."""
    return existing.unionByName(defaults.join(existing.select(key), key, "left_anti"))


def first_by_key(parts: list[DataFrame], key: str) -> DataFrame:
    """The union of parts with one row for each key, from the first part that has it (then its smallest `pos`). Combined before the shuffle."""
    part, one = unused(parts[0], "part", "row")
    rows = reduce(DataFrame.unionByName, (p.withColumn(part, F.lit(i)) for i, p in enumerate(parts)))
    row = F.struct(*(c for c in parts[0].columns if c != key))
    return rows.groupBy(key).agg(F.min_by(row, F.struct(part, "pos")).alias(one)).select(key, f"{one}.*")


def without_newest(rows: DataFrame, n: int, date: str, tie: str) -> DataFrame:
    """All but the n newest rows; among equal dates the smaller tie is newer, and tie is unique. Only those n are found and removed, so nothing is ranked in one task."""
    d, t = unused(rows, "d", "t")
    newest = rows.orderBy(F.col(date).desc_nulls_last(), F.col(tie)).limit(max(0, n)).select(F.col(date).alias(d), F.col(tie).alias(t))
    return rows.join(newest, F.col(date).eqNullSafe(F.col(d)) & F.col(tie).eqNullSafe(F.col(t)), "left_anti")


def day_dividers(rows: DataFrame, ts: str, group: str, tie: str) -> DataFrame:
    """rows with new_day: the date differs from that of the group's row before, by ts, then by tie."""
    day = F.to_date(ts)
    before = F.lag(day).over(Window.partitionBy(group).orderBy(ts, tie))
    return rows.withColumn("new_day", F.coalesce(day != before, F.lit(True)))
