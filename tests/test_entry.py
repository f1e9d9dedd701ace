"""The contract with the driver: names, SQL twins over the smallest tables, and independence from the llm folder."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from lodeworks.jobs import queries as jobs

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")
#: Queries cheap enough for every run of the tests; the driver compares all of them.
SOME = ["nodes_from_lines", "bm25_stats", "nodes_from_markdown", "retrieval_metrics", "tree_topk", "log_round_trip", "ingestion", "tree_build_costs", "benchmark_cells", "audit_report", "report_manifest", "token_f1", "exact_match_numeric", "resume_remaining", "split_25_5_5", "tree_levels", "day_divider", "daily_usage_stream", "tree_vector_topk", "stored_vectors_topk", "stored_postings_topk", "fresh_stream", "resumed_cells_stream", "latency_quantiles", "log_source_since", "packed_chunks"]


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list) else str(v) if not isinstance(v, (int, str, bool, type(None))) else v


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", SOME)
def test_same_rows_as_sql(spark, name):
    df = jobs.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    con = duckdb.connect()
    for f in DATA.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    cur = con.execute(jobs.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cur.fetchall()), key=repr)


def test_import_without_llm(tmp_path):
    for f in ("__spark_entry__.py",):
        (tmp_path / f).write_text((ROOT / f).read_text())
    code = "import sys; sys.path.insert(0, '.'); import shutil; shutil.copytree(sys.argv[1], 'lodeworks', ignore=shutil.ignore_patterns('llm')); import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); assert 'pipeline' not in e.queries(); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code, str(ROOT / "lodeworks")], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) == len(jobs.QUERIES)
