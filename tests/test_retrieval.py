import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodeworks.operators import experiment as x
from lodeworks.operators import indexes
from lodeworks.operators import retrieval as r

TEXTS = {"d": ["red fox runs", "blue fox sleeps", "red red wine", "green tea", "the fox the fox"], "e": ["only one line"]}


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(d, f"{d}_n{i:04d}", i, text) for d, texts in TEXTS.items() for i, text in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "document_id string, node_id string, node_seq int, content string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([("q1", "d", "red fox fox"), ("q2", "e", "line nothing")], "query_id string, document_id string, query_text string")


def plain_bm25(texts, question):
    docs = [t.split() for t in texts]
    df = Counter(w for d in docs for w in set(d))
    idf = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    avg = sum(map(len, docs)) / len(docs)
    score = lambda d: sum((idf[w] if idf.get(w, 0) >= 0 else floor) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in question.split() if w in d)
    return [round(score(d), 6) for d in docs]


def test_bm25_against_plain_python(spark, nodes, asked):
    got = r.bm25(asked, nodes, 10).collect()
    for q, d, text in (("q1", "d", "red fox fox"), ("q2", "e", "line nothing")):
        scores = plain_bm25(TEXTS[d], text)
        order = sorted(range(len(scores)), key=lambda i: (-scores[i], i))
        mine = sorted((g for g in got if g.query_id == q), key=lambda g: g["rank"])
        assert [g.node_seq for g in mine] == [i + 1 for i in order]
        assert [g.score for g in mine] == pytest.approx([scores[i] for i in order], abs=2e-6)


def test_lists_stay_in_their_document(nodes, asked):
    assert {(g.query_id, g.document_id) for g in r.bm25(asked, nodes, 10).collect()} == {("q1", "d"), ("q2", "e")}


def test_smaller_k_is_a_prefix(nodes, asked):
    ten = {(g.query_id, g["rank"]): g.node_id for g in r.bm25(asked, nodes, 10).collect()}
    assert all(ten[g.query_id, g["rank"]] == g.node_id for g in r.bm25(asked, nodes, 3).collect())


def test_metrics_agree_with_each_other(spark, nodes, asked):
    truth = asked.withColumn("gt_citations", F.when(F.col("query_id") == "q1", F.array(F.lit("d_n0003"))).otherwise(F.array(F.lit("e_n0001"))))
    rows = x.retrieval_metrics(r.bm25(asked, nodes, 10), truth).collect()
    assert len(rows) == 6
    for row in rows:
        assert 0 <= row.precision_at_k <= 1 and (row.evidence_hit == 1) == (row.recall_at_k > 0)


def test_ground_truth_finds_long_and_short_items(spark, nodes):
    items = spark.createDataFrame([(1, "red fox"), (2, "xred"), (3, ""), (4, None)], "item_id long, text string")
    assert [(g.query_id, g.node_id) for g in r.ground_truth(nodes, items).collect()] == [(1, "d_n0001")]


def test_ground_truth_of_many_items_without_spaces(spark):
    texts = [f"\u9805\u76ee{i:04d}\u865f\U00020000\u6587\u672c\u6c92\u6709\u7a7a\u683c" * (1 + i % 9) for i in range(1200)] + ["", "x", "ab x\U00020000y"]
    heads = [text[: 3 + i % 90] for i, text in enumerate(texts[:1200])] + ["x", "\U00020000", "b x", "\u865f\U00020000", "nowhere", "y" * 80]
    rows = spark.createDataFrame([("z", f"z_n{i:04d}", i, text) for i, text in enumerate(texts)], "document_id string, node_id string, node_seq int, content string")
    items = spark.createDataFrame(list(enumerate(heads)), "item_id long, text string")
    wanted = {(q, i) for q, head in enumerate(heads) for i, text in enumerate(texts) if head in text}
    assert {q for q, _ in wanted} >= set(range(1200))
    got = [(g.query_id, g.node_seq) for g in r.ground_truth(rows, items).select("query_id", "node_seq").collect()]
    assert len(got) == len(wanted) and set(got) == wanted


def test_items_that_differ_after_their_beginning_are_told_apart(spark):
    long = "word " * 30
    contents = [f"x {long}one end", f"{long}two", "begin here of it", "the middle line", "end of it and more", "begin here of it", "another middle", "end of it", "tail begin", "end it"]
    nodes = spark.createDataFrame([("d", f"d_n{i:04d}", i, c) for i, c in enumerate(contents, 1)] + [("e", "e_n0001", 1, "end of it")], "document_id string, node_id string, node_seq int, content string")
    items = [(1, f"{long}one"), (2, f"{long}two"), (3, f"{long}three"), (4, "here of it\n\n the middle line\t\nend of it"), (5, "begin\nend"), (6, "here of it\nthe middle"), (7, " \n "), (8, None), (3_000_000_000, "another middle")]
    got = r.ground_truth(nodes, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((g.query_id, g.node_seq) for g in got.collect()) == [(1, 1), (2, 2), (4, 3), (4, 4), (4, 5), (5, 9), (5, 10), (6, 3), (6, 4), (3_000_000_000, 7)]
    assert "V_3000000000_d" in {q.query_id for q in r.questions(got).collect()}
    assert r.ground_truth(nodes, spark.createDataFrame([(7, "")], "item_id long, text string")).count() == 0


def test_a_passage_deep_in_a_node_is_found_through_the_tree(spark):
    rows = [("D", i + 1, " ".join(f"w{chr(97 + i % 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)) + (" needle" if i == 17 else "")) for i in range(25)]
    nodes = spark.createDataFrame(rows, "document_id string, node_seq int, content string")
    asked = spark.createDataFrame([("q", "D", "needle " + rows[17][2][2_500:2_700])], "query_id string, document_id string, query_text string")
    vectors = nodes.select("document_id", "node_seq", r.hashed_vector(F.col("content"), 512).alias("vector"))
    wanted = asked.select("query_id", "document_id", r.hashed_vector(F.col("query_text"), 512).alias("query_vector"))
    assert indexes.by_vector_tree(wanted, indexes.vector_tree(vectors), vectors, 1).first().node_seq == 18


def test_a_text_is_hashed_once(spark):
    text = "Red fox, red wine; 4.2% of the fox"
    got = spark.createDataFrame([(text,), ("",)], "content string").select(r.hashed_vector(F.col("content"), 16).alias("v"))
    assert got._jdf.queryExecution().executedPlan().toString().count("filter(") == 0
    words = [int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % 16 for w in ("red", "fox", "red", "wine", "4.2%", "of", "the", "fox")]
    assert [x.v for x in got.collect()] == [[float(words.count(i)) for i in range(16)], [0.0] * 16]


def test_a_hybrid_ranks_the_first_of_bm25_by_vectors(nodes, asked):
    plan = r.hybrid(asked, nodes, 2, 4)._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in plan  # hashed before the join, not for each use of a vector
    texts = {(f"{d}_n{i:04d}", q): (d, i, c, w) for d, ts in TEXTS.items() for i, c in enumerate(ts, 1) for q, e, w in (("q1", "d", "red fox fox"), ("q2", "e", "line nothing")) if e == d}
    h = lambda s: Counter(int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % 64 for w in s.split())
    near = lambda a, b: round(sum(a[x] * b[x] for x in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())), 6)
    first = {(g.query_id, g.node_id) for g in r.bm25(asked, nodes, 4).collect()}
    best = {q: sorted((-near(h(w), h(c)), i, n) for (n, q2), (d, i, c, w) in texts.items() if q2 == q and (q, n) in first)[:2] for q in ("q1", "q2")}
    got = {q: [(-g.score, g.node_seq, g.node_id) for g in sorted(r.hybrid(asked, nodes, 2, 4).where(F.col("query_id") == q).collect(), key=lambda g: g["rank"])] for q in best}
    assert {q: [x[1:] for x in v] for q, v in got.items()} == {q: [x[1:] for x in v] for q, v in best.items()}


def test_tree_has_one_root(spark):
    rows = spark.createDataFrame([("t", i + 1) for i in range(101)] + [("u", 1)], "document_id string, node_seq int")
    widths = {(g.document_id, g.level): g["count"] for g in r.tree_levels(rows).groupBy("document_id", "level").count().collect()}
    assert widths == {("t", 0): 101, ("t", 1): 11, ("t", 2): 2, ("t", 3): 1, ("u", 0): 1}


def test_no_questions_no_rows(spark, nodes, asked):
    assert r.bm25(asked.limit(0), nodes, 3).count() == 0


def test_a_parents_words_come_from_all_of_its_children(spark):
    rows = [("D", i + 1, f"word{chr(97 + i)} " + " ".join(chr(97 + i) + chr(97 + k) + "z" for k in range(26))) for i in range(25)]
    nodes = spark.createDataFrame(rows, "document_id string, node_seq int, content string")
    tree = {(y.level, y.pos): y.words for y in r.tree_texts(nodes, each=3).collect()}
    assert sorted(tree) == [(0, i) for i in range(25)] + [(1, 0), (1, 1), (1, 2), (2, 0)]
    assert all(len(tree[0, i]) == 27 for i in range(25))
    assert tree[1, 1] == [w for i in range(10, 20) for w in tree[0, i][:3]] and tree[2, 0] == [w for p in range(3) for w in tree[1, p][:3]]
    asked = spark.createDataFrame([("q", "where is wordr or wordd", "D"), ("none", "zzz", "D")], "query_id string, query_text string, document_id string")
    got = r.by_tree(asked, nodes, 3, each=3).collect()
    assert [y.node_seq for y in sorted(got, key=lambda y: y.rank) if y.query_id == "q"][:2] == [4, 18]
    assert [y.node_seq for y in sorted(got, key=lambda y: y.rank) if y.query_id == "none"] == [1, 2, 3]


def test_blocks_do_not_change_the_nearest(spark):
    rng = random.Random(2)
    vectors = spark.createDataFrame([("D", i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)], "document_id string, node_seq int, vector array<double>")
    asked = vectors.where("node_seq < 5").select(F.concat(F.lit("q"), "node_seq").alias("query_id"), "document_id", F.col("vector").alias("query_vector"))
    a, b = (sorted(map(tuple, r.by_vector(asked, vectors, 7, blocks=k).collect())) for k in (1, 9))
    assert a == b and len(a) == 35
