import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeworks.llm import nbest as n

TOOL = n.Segmenter.of(n.model_path(), 4)
P = TOOL.pieces


def every_path(s):
    out = []

    def go(i, score, ids):
        if i == len(s):
            out.append((score, ids))
            return
        for j, edge, more in P.edges(s, i):
            go(j, score + edge, ids + more)

    go(0, 0, ())
    return sorted(out, key=lambda x: (-x[0], x[1]))


@settings(max_examples=80, deadline=None)
@given(st.text("aethn s.é漢\n", max_size=9))
def test_search_against_every_path(text):
    s = n.SPACE + text.replace(" ", n.SPACE)
    paths = every_path(s)
    mine = n.n_best(s, P, 4)
    assert [x[0] for x in mine] == [x[0] for x in paths[:4]] and len(set(mine)) == len(mine) and set(mine) <= set(paths)
    score, ids, loss = n.best_two(s, P)
    assert score == paths[0][0] and (score, ids) in paths and (loss == paths[0][0] - paths[1][0] if len(paths) > 1 else loss == np.inf)
    found, same = TOOL.paths(text)
    if text:
        assert [x[0] for x in found] == [x[0] for x in paths[:4]] and same
        by_ids = {ids: score for score, ids in paths}
        assert len({x[1] for x in found}) == len(found)
        assert all(by_ids[tuple(np.frombuffer(x, "<u4").tolist())] == s for s, x in found)


@pytest.mark.parametrize("text", ["Hello  world", " lead", "trail  ", "a\n\n b", "漢字 é́ \U0001f600", "x" * 50_000, "\x00\x7f", " " * 4_000, "the cat sat. " * 500])
def test_exact_round_trip(text):
    found, same = TOOL.paths(text)
    assert same and all(TOOL.decode(ids) == text for _, ids in found)


def test_least_departures():
    loss = np.array([5.0, 1.0, np.inf, 1.0, 1.0, 7.0])
    assert n.least(loss, 2) == [1, 3] and n.least(loss[:3], 5) == [0, 1]


def test_table(spark):
    docs = spark.createDataFrame([(1, "the cat", 5), (1, "the cat", 5), (2, None, 6), (None, "", 7)], "doc_id long, text string, score int")
    out = n.segmented(docs, n.model_path()).orderBy("doc_id", "text").collect()
    assert [r.scores for r in out][:2] == [[0], [0]] or out[0].scores == [0]
    assert all(r.round_trip for r in out) and len(out) == 4
    assert n.segmented(docs.limit(0), n.model_path()).count() == 0
    with pytest.raises(ValueError):
        n.segmented(docs.withColumnRenamed("score", "Scores"), n.model_path())


def test_a_long_stretch_is_bounded_and_the_same(monkeypatch):
    import random
    import tracemalloc

    rng = random.Random(4)
    s = n.SPACE + "".join(rng.choice("aethns\u00e9\u6f22") for _ in range(3_000))
    plain = n.n_best(s, P, 4)
    two = n.best_two(s, P)
    monkeypatch.setattr(n, "MANY", 100)  # arrays, and a search that is bounded first
    assert n.n_best(s, P, 4) == plain and n.best_two(s, P) == two
    monkeypatch.undo()
    long = n.SPACE + "".join(rng.choice("aethns") for _ in range(150_000))
    tracemalloc.start()
    assert len(n.n_best(long, P, 4)) == 4
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()


def test_nothing_is_remembered_after_a_task(spark):
    """Spark's workers go on to other stages, whose memory comes on top."""
    docs = spark.createDataFrame([(i, f"words of text {i}") for i in range(40)], "doc_id long, text string").repartition(4)
    probe = "held long"

    def held(batches):
        for batch in batches:
            found = max((t.held for t in n.Segmenter._one.values() if t.memory == 1_234_567), default=0)
            yield n.pa.RecordBatch.from_arrays([n.pa.array([found] * batch.num_rows, n.pa.int64())], names=["held"])

    one = n.segmented(docs, n.model_path(), memory=1_234_567, keep=False).select("doc_id", "best_ids").collect()
    assert max(r.held for r in docs.mapInArrow(held, probe).collect()) == 0
    two = n.segmented(docs, n.model_path(), memory=1_234_567).select("doc_id", "best_ids").collect()
    assert max(r.held for r in docs.mapInArrow(held, probe).collect()) > 0
    assert sorted(one) == sorted(two)
