"""From raw documents to token ids: five stages, each over all that the one before it kept.

Defined results. Null and empty texts fail the quality rules, so later stages meet texts with words only. A null lang or source
counts as "". Rows without a doc_id are judged like others, but stay in the near-duplicate stage, as the one that stays could not be named.
Repeated rows and rows of one doc_id: of equal texts one stays. Ties: the smallest doc_id stays, then the text that is least by hash. Very long texts are
used whole. An empty table gives empty stages. Columns besides those of documents go through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import decontaminate, near_dup, nbest, quality_rules, secret_scan
from lodeworks.runtime import cut, table

#: Shingles of five words. Three bits are the most that two segments are sure to find; texts that are LEAST per cent alike
#: and further apart are found by bands of their shingle sets, and verified.
SHINGLE, BITS, LEAST = 5, 3, 80
#: Bytes of stretches a worker remembers, until its task ends: less than where encoding is all that it does, as Spark's workers go from stage to stage.
MEMORY = 64 << 20


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dup.one_of_each(docs, SHINGLE, BITS, least=LEAST)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the benchmark's passages cut out."""
    return _measured(decontaminate.remove(docs, table(spark, sf_dir, "benchmark")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in place of each secret."""
    return _measured(secret_scan.redact(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's best segmentation and the scores of its best ones."""
    out = nbest.segmented(docs.select("doc_id", "lang", "source", "text"), nbest.model_path(), drop_text=True, memory=MEMORY, keep=False)
    n = (F.octet_length("best_ids") / 4).cast("long")
    return out.select("doc_id", "lang", "source", n.alias("n_ids"), F.sha2("best_ids", 256).alias("ids_sha256"), "scores", "round_trip")


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("benchmark passages", benchmark_passages), ("secrets", secrets), ("encoding", encoded)]

#: Fingerprints, components and n-best paths are not in SQL's reach; tests/llm/test_pipeline.py holds the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else cut(docs), sf_dir)
    return docs
