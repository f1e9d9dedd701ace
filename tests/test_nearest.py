import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeworks.jobs import queries
from lodeworks.operators import indexes as ix
from lodeworks.operators import nearest as near
from lodeworks.operators import retrieval as r

K = 3


@pytest.fixture(scope="module")
def odd(spark):
    """Equal vectors, more than a batch has; multiples of one; vectors of nought, null, with a null, of other sizes, and what is no number."""
    rng = np.random.default_rng(5)
    some = [[1.0, 2.0, 3.0]] * 60 + [[float(x) for x in (1 + i / 7) * np.array([0.3, -1.1, 2.0])] for i in range(60)] + [list(map(float, x)) for x in rng.normal(size=(60, 3))]
    some += [[0.0] * 3, None, [1.0, None, 2.0], [1.0, 2.0], [5.0], [], [float("nan"), 0.0, 1.0], [1e200, 1e200, 0.0], [-0.0, 0.0, -0.0]] * 2
    rows = [(s, (i * 37) % 1_000, v) for s in ("a", "b") for i, v in enumerate(some)] + [(None, 1, [1.0, 2.0, 3.0])]
    return spark.createDataFrame(rows, "document_id string, node_seq int, vector array<double>")


@pytest.fixture(scope="module")
def asked(odd):
    some = odd.where("node_seq % 5 = 0 OR vector IS NULL OR size(vector) <> 3 OR exists(vector, x -> x IS NULL OR x IN (0D, double('NaN'), 1e200D))")
    return some.select(F.concat_ws("-", "document_id", "node_seq").alias("query_id"), "document_id", F.col("vector").alias("query_vector"))


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("batch", ["10000", "11"])
def test_matrices_give_what_pairs_give(spark, asked, odd, batch, monkeypatch):
    monkeypatch.setattr(near, "_PAIRS", 50)
    monkeypatch.setattr(near, "_QUESTIONS", 9)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = rows(r.by_vector(asked, odd, K, blocks=2))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert got == rows(r.by_vector(asked, odd, K, score=lambda a, b: r.cosine(a, b)))


def test_few_pairs_leave_their_task(spark, odd):
    """Of 300 vectors in one block, a question gets k rows: no row for each pair."""
    vectors = spark.range(300).select(F.lit("d").alias("document_id"), F.col("id").cast("int").alias("node_seq"), F.array(F.sin("id"), F.cos("id")).alias("vector"))
    wanted = vectors.where("node_seq < 20").select(F.col("node_seq").alias("query_id"), "document_id", F.col("vector").alias("query_vector"))
    assert near.nearest(wanted, vectors, K, ("document_id",)).count() == 20 * K
    assert near.nearest(wanted, vectors, None, ("document_id",)).count() == 20 * 300
    text = r.by_vector(wanted, vectors, K)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "Join" not in text


def test_lists_are_searched_by_matrices(spark, odd, tmp_path):
    vectors = odd.where("document_id IS NOT NULL AND size(vector) = 3 AND NOT exists(vector, x -> x IS NULL OR x IN (double('NaN'), 1e200D))")
    wanted = vectors.where("node_seq % 5 = 0").select(F.concat_ws("-", "document_id", "node_seq").alias("query_id"), "document_id", F.col("vector").alias("query_vector"))
    ix.write_lists(vectors, str(tmp_path / "lists"), lists=5)
    got = ix.in_lists(wanted, str(tmp_path / "lists"), K)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == rows(r.by_vector(wanted, vectors, K, score=lambda a, b: r.cosine(a, b)))


def test_halves_are_rounded_away_from_nought():
    x = np.array([0.0000005, -0.0000005, 0.1234565, 0.5, -0.9999996, 1.0, 0.1234564999])
    assert near.rounded(x).tolist() == [0.000001, -0.000001, 0.123457, 0.5, -1.0, 1.0, 0.123456]
    assert near.matrix(pa.array([[1.0, 2.0], None, [3.0], [4.0, None]]), 2).tolist() == [[1.0, 2.0], [0.0, 0.0], [0.0, 0.0], [0.0, 0.0]]


def test_a_pair_is_scored_again_only_if_it_is_among_the_first(spark, tmp_path):
    """The rows that are ranked again come out of the matrices: no join of questions and vectors by their scope."""
    spark.range(200).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.sin(F.col("id") * i).cast("float")).alias("embedding"), (F.col("id") % 2).cast("int").alias("label")).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.vector_rerank_topk(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not [line for line in plan.splitlines() if "Join" in line and "label" in line]
    assert got.count() == 4 * 10
