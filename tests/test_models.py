import pytest
from pyspark.sql import functions as F

from lodeworks.functions import models as mo
from lodeworks.functions.models import Model
from lodeworks.jobs import runs
from lodeworks.operators import experiment as x
from lodeworks.operators import nodes as n
from lodeworks.operators import retrieval as r


def counted(folder, name, run):
    """A loader that leaves a file each time it loads."""

    def load():
        import uuid
        from pathlib import Path

        (Path(folder) / f"{name}-{uuid.uuid4().hex}").touch()
        return run

    return load


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    model = Model(f"twice-{tmp_path}", counted(str(tmp_path), "m", lambda v: [2 * a for a in v]), "long")
    rows = spark.range(0, 4_000, 1, 16)
    assert mo.with_model(rows, "y", model, F.col("id")).where("y <> 2 * id").count() == 0
    assert mo.with_model(rows, "y", model, F.col("id")).count() == 4_000
    assert 1 <= len(list(tmp_path.iterdir())) <= 8  # 32 tasks on four workers, some of which may be new
    pair = Model("pair", lambda: lambda a, b: [f"{p}{q}" for p, q in zip(a, b, strict=True)], "string")
    assert mo.with_model(rows.limit(3), "y", pair, F.col("id"), F.col("id") + 1).orderBy("id").collect()[2].y == "23"
    short = Model("short", lambda: lambda a: a[1:], "long")
    with pytest.raises(Exception, match="short gave"):
        mo.with_model(rows, "y", short, F.col("id")).collect()


def test_calls_are_tried_again_with_longer_waits():
    waits, calls = [], []

    def call(a):
        calls.append(a)
        if len(calls) < 4:
            raise TimeoutError
        return a + 1

    assert mo.patient(call, attempts=6, first_wait=1, most_wait=3, again=TimeoutError, sleep=waits.append)(1) == 2
    assert len(waits) == 3 and 0.5 <= waits[0] <= 1 <= waits[1] <= 2 and 1.5 <= waits[2] <= 3
    with pytest.raises(ZeroDivisionError):
        mo.patient(lambda: 1 / 0, again=TimeoutError, sleep=waits.append)()
    with pytest.raises(ZeroDivisionError):
        mo.patient(lambda: 1 / 0, attempts=2, sleep=waits.append)()
    assert len(waits) == 4


def test_few_calls_at_once_in_order():
    import threading
    import time

    now, most, lock = 0, 0, threading.Lock()

    def call(a, b):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        time.sleep(0.01)
        with lock:
            now -= 1
        return a * b

    assert mo.together(call, 3)(list(range(20)), [2] * 20) == [2 * i for i in range(20)] and 1 < most <= 3


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.createDataFrame([(1, "\n".join(f"line{i} word{i % 3} thing" for i in range(30))), (2, "one two\nthree four")], "doc_id long, text string")
    asked = spark.createDataFrame([("q", "word1 line4", "line4", "Q1", 1, ["1_n0005"]), ("p", "three", "three", "Q2", 2, ["2_n0002"])], "query_id string, query_text string, ground_truth_answer string, quadrant string, document_id long, gt_citations array<string>")
    return n.from_lines(docs), asked


def test_cells_with_other_models(spark, small):
    nodes, asked = small
    embed = Model("length", lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], "array<double>")
    rerank = Model("last", lambda: lambda q, c: [float(c_.split()[0][4:]) if c_.startswith("line") else 0.0 for c_ in c], "double")
    judge = Model("five", lambda: lambda said, truth: [5 for _ in said], "int")
    cells = x.matrix(asked, pipelines=("P1", "P3"), ks=(3,))
    got = {(g.query_id, g.pipeline): g for g in runs.run_cells(cells, asked, nodes, cells.limit(0), judge=judge, embed=embed, rerank=rerank).collect()}
    assert len(got) == 4 and {g.judge_score for g in got.values()} == {5}
    near = r.by_vector(asked.where("query_id = 'q'").selectExpr("query_id", "document_id", "array(double(length(query_text)), 1D) AS query_vector"), nodes.selectExpr("document_id", "node_seq", "array(double(length(content)), 1D) AS vector"), 20)
    first = [g.node_seq for g in near.orderBy("rank").collect()]
    best = sorted(first, key=lambda i: (-float(i - 1), first.index(i)))[:3]
    assert got["q", "P1"].retrieved_node_ids == [f"1_n{i:04d}" for i in best]
    assert got["q", "P3"].retrieved_node_ids == [f"1_n{i:04d}" for i in first[:3]]


def test_an_answerer_sees_no_truth(spark, small):
    nodes, asked = small
    with pytest.raises(ValueError, match="sees"):
        runs.answered(asked.selectExpr("query_id AS result_id", "query_text", "'' AS context", "'' AS first_node", "gt_citations"))


def test_nothing_left_means_no_retrieval(spark, small, monkeypatch):
    nodes, asked = small
    cells = x.matrix(asked)
    monkeypatch.setattr(runs, "ranked", lambda *a, **b: pytest.fail("ranked"))
    assert runs.run_cells(cells, asked, nodes, cells).count() == 0


def test_only_what_is_left_is_ranked(spark, small, monkeypatch):
    nodes, asked = small
    cells, seen = x.matrix(asked), {}
    true = runs.ranked

    def ranked(need, *rest):
        seen.update({p: sorted(row.query_id for row in q.collect()) for p, q in need.items()})
        return true(need, *rest)

    monkeypatch.setattr(runs, "ranked", ranked)
    out = runs.run_cells(cells, asked, nodes, cells.where("NOT (query_id = 'p' AND pipeline = 'P2' AND k_value = 5)"))
    assert [(g.query_id, g.pipeline, g.k_value) for g in out.collect()] == [("p", "P2", 5)] and seen == {"P2": ["p"]}


def test_the_gate_from_cells_to_agreement(spark, small):
    nodes, asked = small
    cells = x.matrix(asked, "JEQ", ks=(5,))
    results = runs.run_cells(cells, asked, nodes, cells.limit(0))
    golden = spark.createDataFrame([(f"g{q}{i}", f"Q{q}", f"question {i}", f"answer {i}", i + 1) for q in range(1, 5) for i in range(5)], "query_id string, quadrant string, query_text string, ground_truth_answer string, human_score int")
    human = cells.select(*x.CELL, F.when(F.col("pipeline") == "P1", 9).otherwise(7).alias("human_score"))
    seven = Model("seven", lambda: lambda prompts: [7 if p.startswith("Rubric") and p.count("Score:") == 6 else 1 for p in prompts], "int")
    scored, gate = runs.judged_gate(results, asked, golden, human, "Rubric", seven)
    assert scored.count() == 6 and tuple(gate.first()) == (6, round(4 / 6, 6), False)
    assert tuple(runs.judged_gate(results, asked, golden, human, "Rubric", seven, tolerance=2)[1].first()) == (6, 1.0, True)
    assert runs.judged_gate(results, asked, golden, human.limit(0), "Rubric", seven, tolerance=9)[1].first().agreement == 0
