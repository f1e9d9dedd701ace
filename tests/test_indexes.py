import random
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from lodeworks.operators import indexes as ix
from lodeworks.operators import retrieval as r
from lodeworks.runtime import ensure_checkpoint_dir
from lodeworks.sources import store


@pytest.fixture(scope="module")
def vectors(spark):
    """Two documents whose nodes are near each other in runs of ten, one with few nodes, one with vectors of nought, and equal ones."""
    rng, rows = random.Random(4), []
    for d, n in (("a", 1_200), ("b", 137), ("few", 4), ("one", 1)):
        centre = [0.0] * 6
        for i in range(n):
            if i % 10 == 0:
                centre = [rng.gauss(0, 1) for _ in range(6)]
            rows.append((d, i + 1, [x + rng.gauss(0, 0.05) for x in centre]))
    rows += [("nought", i + 1, [0.0] * 6 if i % 3 else [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(25)]
    return spark.createDataFrame(rows, "document_id string, node_seq int, vector array<double>")


@pytest.fixture(scope="module")
def asked(spark, vectors):
    rows = [(f"{v.document_id}{v.node_seq}", v.document_id, [x + 0.01 for x in v.vector]) for v in vectors.where("node_seq % 97 = 1").collect()]
    rows += [("none", "a", [0.0] * 6), ("minus", "nought", [-1.0] + [0.0] * 5), ("elsewhere", "unknown", [1.0] * 6)]
    return spark.createDataFrame(rows, "query_id string, document_id string, query_vector array<double>")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("k", [1, 10])
def test_a_tree_gives_the_exact_ranking(asked, vectors, k):
    tree = ix.vector_tree(vectors)
    assert rows(ix.by_vector_tree(asked, tree, vectors, k)) == rows(r.by_vector(asked, vectors, k))


def test_every_leaf_is_within_its_parents_radius_and_a_search_visits_few(spark, asked, vectors):
    tree = ix.vector_tree(vectors)
    top = {(x.document_id, x.level): x.n for x in tree.groupBy("document_id", "level").agg(F.sum("n").alias("n")).collect()}
    assert top["a", 3] == top["a", 2] == top["a", 1] == top["a", 0] == 1_200 and ("a", 5) not in top and top["one", 0] == 1 and ("one", 1) not in top
    leaves, parents = tree.where("level = 0").alias("l"), tree.where("level > 0").alias("p")
    inside = F.floor(F.col("l.pos") / F.pow(F.lit(r.FANOUT), F.col("p.level"))) == F.col("p.pos")
    assert leaves.join(parents, (F.col("l.document_id") == F.col("p.document_id")) & inside).where(ix.distance(F.col("l.centre"), F.col("p.centre")) > F.col("p.radius") + 1e-9).count() == 0
    some = asked.where("document_id = 'a' AND query_id <> 'none'")
    visited = ix.tree_leaves(some, tree, 5).count()
    assert visited < 0.2 * 1_200 * some.count()


@pytest.mark.parametrize("k", [1, 10])
def test_lists_give_the_exact_ranking_from_some_folders(spark, asked, vectors, tmp_path, k):
    root = str(tmp_path / "lists")
    ix.write_lists(vectors, root, lists=12)
    assert rows(ix.in_lists(asked, root, k)) == rows(r.by_vector(asked, vectors, k))
    stored = store.published(spark, root, "vectors")
    one = asked.where("query_id = 'a98'")
    pairs = spark.createDataFrame([("a98", 3)], "query_id string, list int")
    plan = ix._in_lists(one, pairs, stored, "document_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan and "(list" in plan.split("PartitionFilters:")[1].split("]")[0]
    got = ix.in_lists(one, root, k)
    assert rows(got) == rows(r.by_vector(one, vectors, k))
    scans = str(got._jdf.queryExecution().optimizedPlan().toString())
    assert "list" in scans


def test_lists_of_an_empty_table(spark, asked, vectors, tmp_path):
    root = str(tmp_path / "none")
    ix.write_lists(vectors.limit(0), root)
    assert ix.in_lists(asked, root, 3).count() == 0


@pytest.fixture(scope="module")
def nodes(spark):
    rng = random.Random(9)
    pool = [f"{a}{b}x" for a in "abcdefghij" for b in "klmnop"]
    rows = [(d, f"{d}_n{i:04d}", i, " ".join(rng.choices(pool, k=rng.randint(0, 30)) + ["rare", "seldom"] * (i % 97 == 5))) for d, n in (("long", 1_500), ("short", 7), ("one", 1)) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "document_id string, node_id string, node_seq int, content string")


@pytest.fixture(scope="module")
def wanted(spark):
    rows = [("q1", "long", "rare seldom akx"), ("q2", "long", "akx akx bkx clx"), ("q3", "short", "akx bkx"), ("q4", "one", "nothing here"), ("q5", "long", "unknown words"), ("q6", "long", ""), ("q7", "gone", "akx")]
    return spark.createDataFrame(rows, "query_id string, document_id string, query_text string")


@pytest.mark.parametrize("k", [1, 10])
@pytest.mark.parametrize("smoothed", [False, True])
def test_postings_give_the_exact_ranking(wanted, nodes, tmp_path, k, smoothed):
    root = str(tmp_path / "postings")
    ix.write_postings(nodes, root, block=16, parts=4, smoothed=smoothed)
    assert rows(ix.in_postings(wanted, root, k)) == rows(r.bm25(wanted, nodes, k, smoothed))


def test_postings_are_counted_where_a_document_is(spark, wanted, nodes, tmp_path):
    """Texts are shuffled once, and nothing else of all the documents is written but the index; batches may end within a document."""
    ensure_checkpoint_dir(spark)
    kept = Path(urlparse(spark.sparkContext._jsc.sc().getCheckpointDir().get()).path)
    there, batch = set(kept.iterdir()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        ix.write_postings(nodes, str(tmp_path / "postings"), block=16)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert set(kept.iterdir()) == there
    assert str(ix.stored_postings(nodes, 16, F.lit(0))._jdf.queryExecution().executedPlan().toString()).count("Exchange ") == 1
    assert rows(ix.in_postings(wanted, str(tmp_path / "postings"), 10)) == rows(r.bm25(wanted, nodes, 10))


def test_postings_of_no_nodes(wanted, nodes, tmp_path):
    ix.write_postings(nodes.limit(0), str(tmp_path / "none"))
    assert ix.in_postings(wanted, str(tmp_path / "none"), 3).count() == 0


def test_blocks_below_the_running_threshold_are_skipped(wanted, nodes, tmp_path):
    root = str(tmp_path / "postings")
    ix.write_postings(nodes, root, block=16)
    q = wanted.where("query_id = 'q1'")
    bounds, terms, postings, stored = ix.block_bounds(q, root)
    first = ix.chosen_blocks(bounds, 5)
    later = ix.later_blocks(bounds, first, ix._blocks_scored(first, terms, postings, stored), 5)
    assert first.count() + later.count() < 0.5 * bounds.count() == 0.5 * 94
    assert "list" not in postings.select("document_id", "block", "term", "most")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_a_version_is_seen_whole_or_not_at_all(spark, vectors, tmp_path):
    root = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        store.published(spark, root, "vectors")
    ix.write_lists(vectors, root, lists=3)
    with pytest.raises(KeyboardInterrupt), store.publishing(spark, root) as aside:  # dies half-way
        vectors.limit(2).write.parquet(f"{aside}/vectors")
        raise KeyboardInterrupt
    left = [p.name for p in (tmp_path / "index").iterdir() if p.name.startswith(store.ASIDE)]
    assert len(left) == 1 and store.published(spark, root, "vectors").count() == vectors.count()
    with store.publishing(spark, root) as aside:
        vectors.limit(5).write.parquet(f"{aside}/vectors")
        assert left[0] not in [p.name for p in (tmp_path / "index").iterdir()]  # the leftover is gone first
        assert store.published(spark, root, "vectors").count() == vectors.count()
    assert store.published(spark, root, "vectors").count() == 5


def test_a_batch_is_added_once_and_whole(spark, tmp_path):
    path, two = str(tmp_path / "t"), spark.range(2).selectExpr("id", "CAST(id AS string) AS s")
    assert store.added(spark, path, "id long, s string").count() == 0
    two.write.parquet(f"{path}/{store.ASIDE}b1")  # what a writer that died has left
    assert store.added(spark, path, "id long, s string").count() == 0
    assert store.add(two, path, "b1", ("s",)) and not store.add(two, path, "b1") and store.add(two.limit(1), path, "b2", ("s",))
    got = store.added(spark, path, "id long, s string")
    assert got.columns == ["id", "s"] and sorted(map(tuple, got.collect())) == [(0, "0"), (0, "0"), (1, "1")]
