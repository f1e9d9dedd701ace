import pytest
from pyspark.sql import functions as F

from lodeworks.llm import line_dedup as o

LONG = "A line that three documents share, and more"


def plain(rows, least_docs=3, least_chars=20):
    """id and text to (kept, lines, dropped) of each row, by a dictionary."""
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(o.BLANK))
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= least_chars:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < least_docs or i == max(held[key(x)])]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, o.deduplicated(df, **more).select("doc_id", "kept", "n_lines", "n_dropped").collect()), key=repr)


def test_lines_of_three_documents_stay_in_the_last(spark):
    rows = [
        (1, f"one\n{LONG}\n  {LONG.upper()}\t\ntwo"), (5, f"\n{LONG}\n"), (9, f"{LONG}\r\nnine\n\x0b{LONG}"), (2, "one\ntwo"), (3, None), (4, ""), (6, "\n\n\n"),
        (7, "É" * 20 + "\nonly two documents have this one"), (8, "é" * 20 + "\nonly two documents have this one"), (10, " " + LONG), (11, "nineteen characters"), (12, "nineteen characters"), (13, "nineteen characters "),
    ]
    got = run(spark, rows)
    assert got == plain(rows)
    assert (1, "one\ntwo", 4, 2) in got and (5, "\n", 3, 1) in got and (9, f"{LONG}\r\nnine\n\x0b{LONG}", 3, 0) in got and (10, " " + LONG, 1, 0) in got


def test_repeated_rows_null_ids_and_rows_of_one_id(spark):
    rows = [(1, LONG)] * 4 + [(None, LONG), (None, f"x\n{LONG}"), (None, f"x\n{LONG}"), (2, LONG), (2, f"b\n{LONG}"), (None, None)]
    assert run(spark, rows) == plain(rows)  # two documents only: nothing goes
    rows += [(3, LONG + "\n" + LONG)]
    got = run(spark, rows)
    assert got == plain(rows) and (None, "x", 2, 1) in got and (3, LONG + "\n" + LONG, 2, 0) in got


def test_long_texts_and_other_limits(spark):
    many = "\n".join(f"line number {i % 500} of a long document" for i in range(30_000))
    rows = [(1, many), (2, many), (3, many + "\nend"), (4, "line number 7 of a long document")]
    assert run(spark, rows, least_docs=2, least_chars=5) == plain(rows, 2, 5)
    assert run(spark, rows, least_docs=5) == plain(rows, 5)


def test_empty_table_and_clashing_names(spark):
    assert run(spark, []) == []
    rows = [(i, LONG, i, "h", 1.5, [i]) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int, _row string, last double, gone array<int>").withColumn("_gone", F.lit("x"))
    out = o.deduplicated(df)
    assert out.columns == [*df.columns, "kept", "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.id, r.gone, r._gone, r.kept) for r in out.collect()) == [(0, 0, [0], "x", ""), (1, 1, [1], "x", ""), (2, 2, [2], "x", LONG)]
    with pytest.raises(ValueError, match="kept"):
        o.deduplicated(df.withColumn("kept", F.lit(1)))


def test_one_shuffle_of_the_texts_and_no_python(spark):
    plan = o.op12_line_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
