import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lodeworks import schemas
from lodeworks.operators import experiment as x
from lodeworks.operators import latency as la
from lodeworks.sources import store
from lodeworks.streaming import resumable as re_
from lodeworks.streaming import usage


def results(todo):
    """Rows of the results table for some cells, without retrieval."""
    rows = todo.withColumns({"result_id": F.md5(F.concat_ws(":", *x.CELL)), "retrieved_node_ids": F.array().cast("array<string>"), "cited_node_ids": F.array().cast("array<string>")})
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schemas.RESULTS))


@pytest.fixture
def files(spark, tmp_path):
    cells = x.matrix(spark.createDataFrame([(q,) for q in "abcdefgh"], "query_id string"))
    for part in ("ab", "cd", "ef", "gha"):  # a's cells come twice
        cells.where(F.col("query_id").isin(*part)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/cells")
    return str(tmp_path)


def keys(spark, root):
    return sorted((r.query_id, r.pipeline, r.k_value) for r in store.read(spark, root, "results").collect())


@pytest.mark.parametrize("after", [False, True])
def test_a_run_that_stops_around_its_commit_goes_on(spark, files, monkeypatch, after):
    """It dies in the second batch: half-way through the write, or after it is published and before the stream has noted the batch."""
    true, calls = store.add, []

    def add(rows, path, name=None, by=()):
        calls.append(name)
        if len(calls) == 2:
            if after:
                true(rows, path, name, by)
            else:
                rows.limit(3).write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{store.ASIDE}{name}")
            raise RuntimeError("stopped")
        return true(rows, path, name, by)

    stream = lambda: re_.cell_stream(spark, f"{files}/cells")
    monkeypatch.setattr(store, "add", add)
    with pytest.raises(StreamingQueryException):
        re_.run_stream(stream(), files, results, f"{files}/state")
    assert len(keys(spark, files)) == (36 if after else 18)
    computed = []
    re_.run_stream(stream(), files, lambda todo: computed.append(todo.count()) or results(todo), f"{files}/state")
    every = sorted((q, p, k) for q in "abcdefgh" for p in schemas.PIPELINES for k in schemas.K_VALUES)
    assert keys(spark, files) == every and sum(computed) == (36 if after else 54)
    assert re_.run_stream(stream(), files, results, f"{files}/state") == 0
    re_.run_stream(stream(), files, lambda todo: pytest.fail("computed"), f"{files}/other")  # another stream over the same cells finds them done
    assert keys(spark, files) == every


def test_state_of_files_is_kept_for_two_days(spark, tmp_path):
    rng, rows = random.Random(1), []
    for i in range(400):
        rows.append((i, f"f{rng.randrange(6)}", int(rng.random() * 14 * 86_400)))
    rows += [(400, "f0", 0), (401, "f0", 0), (402, "f1", 48 * 3_600), (403, "edge", 0), (404, "edge", 48 * 3_600 - 1), (405, "edge", 48 * 3_600)]
    rows.sort(key=lambda r: r[2])
    for k in range(0, len(rows), 100):
        part = spark.createDataFrame(rows[k : k + 100], "event int, file string, s int").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema("event int, file string, s int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {r.event: r.parse for r in re_.collected(re_.parses(events, "file", "event"), str(tmp_path)).collect()}
    last, wanted = {}, {}
    for event, file, s in sorted(rows, key=lambda r: (r[2], r[0])):
        wanted[event] = file not in last or s - last[file] >= 48 * 3_600
        if wanted[event]:
            last[file] = s
    assert got == wanted
    # the batch form says the same of the last parses, at the time of the last event
    now = max(r[2] for r in rows)
    have = spark.createDataFrame(list(last.items()), "document_id string, s int").withColumn("modified", F.timestamp_seconds(F.col("s") + 1_700_000_000))
    assert {r.document_id for r in store.fresh(have, F.timestamp_seconds(F.lit(now + 1_700_000_000))).collect()} == {f for f, s in last.items() if now - s < 48 * 3_600}


def test_totals_of_a_stream_in_several_batches(spark, tmp_path):
    rows = [(f"2025-01-0{1 + i // 40} 0{i % 10}:00:00", "ab"[i % 2], float(i)) for i in range(160)]
    for k in range(4):
        spark.createDataFrame(rows[40 * k : 40 * k + 45], "ts string, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table = spark.read.parquet(f"{tmp_path}/in")
    out = usage.drained(usage.daily(usage.stream(spark, f"{tmp_path}/in", "*.parquet")), ("day", "event_type"), str(tmp_path))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, usage.daily(table).collect()))
    assert len([p for p in (tmp_path / "rows").iterdir() if p.name.startswith("batch=")]) >= 4


def test_quantiles_are_within_their_error_over_any_range(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"2025-03-{1 + i % 9:02d} 10:00:00", "ab"[i % 2], rng.lognormvariate(0, 2) if i % 50 else 0.0) for i in range(6_000)] + [("2025-03-01 00:00:00", "a", None)]
    calls = spark.createDataFrame(rows, "ts string, role string, latency_sec double")
    path = str(tmp_path / "s")
    for k in range(3):
        assert la.keep(calls.where(F.expr(f"pmod(hash(ts, latency_sec), 3) = {k}")), path, str(k))
    assert not la.keep(calls, path, "2")
    for first, last in ((None, None), ("2025-03-03", "2025-03-05"), ("2025-03-09", None)):
        for r in la.quantiles(la.kept(spark, path, first, last)).collect():
            exact = sorted(v for d, role, v in rows if role == r.role and v is not None and (first or "") <= d[:10] <= (last or "9"))
            assert r.n == len(exact)
            for share, got in ((0.5, r.q50), (0.9, r.q90), (0.99, r.q99)):
                true = exact[max(0, -(-int(share * 100) * len(exact) // 100) - 1)]
                assert abs(got - true) <= la.ERROR * true + 1e-6
    assert la.quantiles(la.kept(spark, path, "2030-01-01")).count() == 0
