import pytest
from pyspark.sql import functions as F

from lodeworks import schemas
from lodeworks.functions import metrics as m
from lodeworks.functions.models import Model
from lodeworks.jobs import runs
from lodeworks.operators import experiment as x
from lodeworks.operators import logs
from lodeworks.operators import nodes as n
from lodeworks.operators import reports
from lodeworks.sources import store
from lodeworks.streaming import usage


@pytest.fixture(scope="module")
def cells(spark):
    return x.matrix(spark.createDataFrame([("a",), ("b",)], "query_id string"))


def result(query, pipeline="P1", k=3):
    row = dict.fromkeys(schemas.RESULTS.names)
    return row | {"result_id": f"{query}{pipeline}{k}", "source_set": "PQ", "query_id": query, "pipeline": pipeline, "k_value": k, "retrieved_node_ids": []}


def test_matrix_and_resume(spark, cells):
    assert cells.count() == 18
    done = cells.where("query_id = 'a' AND pipeline = 'P1'")
    assert x.remaining(cells, done).count() == 15
    assert x.remaining(cells, cells).count() == 0
    other = done.withColumn("source_set", F.lit("JEQ"))
    assert x.remaining(cells, other).count() == 18


def test_store_rejects_a_key_that_is_there(spark, tmp_path):
    root = str(tmp_path)
    store.create(spark, root)
    store.create(spark, root)
    rows = lambda *names: spark.createDataFrame([result(n) for n in names], schemas.RESULTS)
    store.append(rows("a", "b"), root, "results")
    with pytest.raises(ValueError):
        store.append(rows("b"), root, "results")
    with pytest.raises(ValueError):
        store.append(rows("c", "c"), root, "results")
    results = store.read(spark, root, "results")
    assert results.count() == 2
    assert {r.query_id for r in store.completed(results, "PQ").collect()} == {"a", "b"}
    scored = store.with_scores(results, spark.createDataFrame([("PQ", "a", "P1", 3, 7, None)], "source_set string, query_id string, pipeline string, k_value int, human_score int, judge_score int"))
    assert {r.query_id: r.human_score for r in scored.collect()} == {"a": 7, "b": None}


def test_id_lists_at_the_file_boundary(spark):
    row = spark.createDataFrame([('["a","b"]',), ("",), (None,), ("bad",)], "s string").select(store.from_json(F.col("s")).alias("x")).collect()
    assert [r.x for r in row] == [["a", "b"], [], [], []]


def test_first_annual_filing_of_the_year(spark):
    recent = spark.createDataFrame(
        [("0000320193", ["8-K", "10-K/A", "10-K", "10-K"], ["2025-01-01", "2025-02-01", "2025-09-27", "2025-12-01"], ["1", "2", "00-3-4", "5"], ["a", "b", "c.htm", "d"])],
        "cik string, form array<string>, reportDate array<string>, accessionNumber array<string>, primaryDocument array<string>",
    )
    lookup = spark.createDataFrame([(0, 320193, "aapl"), (1, 7, "AAPL")], "pos int, cik_str long, ticker string")
    wanted = spark.createDataFrame([("AAPL_2025", "AAPL", 2025), ("AAPL_2019", "AAPL", 2019), ("NONE_2025", "NONE", 2025)], schemas.MANIFEST)
    found = {r.document_id: r.url for r in store.first_filing(store.with_cik(wanted, lookup), store.filings(recent)).collect()}
    assert found == {"AAPL_2025": "https://www.sec.gov/Archives/edgar/data/320193/0034/c.htm", "AAPL_2019": None, "NONE_2025": None}
    with pytest.raises(Exception, match="no filing"):
        store.required(spark.createDataFrame([("x", None)], "id string, url string"), "url", "no filing").collect()


def test_parsed_files_are_fresh_for_two_days(spark):
    rows = spark.createDataFrame([("a", "2025-01-03 00:00:00"), ("b", "2025-01-01 00:00:00")], "document_id string, m string").withColumn("modified", F.to_timestamp("m"))
    assert [r.document_id for r in store.fresh(rows, F.lit("2025-01-03 01:00:00").cast("timestamp")).collect()] == ["a"]


def test_pages_join_in_order(spark):
    rows = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one")], "document_id string, page int, text string")
    assert store.joined_pages(rows).first().markdown == "one\n\ntwo"


def test_html_to_markdown():
    html = "<title>T</title><script>x<p></script><h2>Item 1A. R</h2><p>a <b>b</b> &amp; c<table><tr><th>h</th><td>1</td></tr><tr></tr><tr><td>2</td><td></td></tr></table>end"
    assert store.to_markdown(html).split("\n\n") == ["T", "## Item 1A. R", "a b & c", "| h | 1 |\n| 2 |  |", "end"]
    assert store.to_markdown(None) == ""


def test_split_is_disjoint_and_full(spark):
    rows = spark.range(140).select(F.col("id").alias("query_id"), F.concat(F.lit("Q"), (1 + F.col("id") % 4).cast("string")).alias("quadrant"))
    sizes = {(r.quadrant, r.split): r["count"] for r in x.split(rows, {"PQ": 25, "GQ": 5, "JEQ": 5}).groupBy("quadrant", "split").count().collect()}
    assert sizes == {(q, s): n for q in schemas.QUADRANTS for s, n in (("PQ", 25), ("GQ", 5), ("JEQ", 5))}


def test_gate_is_strict(spark):
    rows = spark.createDataFrame([(i, i if i < 9 else 1) for i in range(1, 11)], "human_score int, judge_score int")
    assert x.gate(rows, least=0.8).first().passed is False
    assert x.gate(rows, tolerance=8, least=0.8).first().passed is True


def test_merge_keeps_what_exists(spark):
    a, b = spark.createDataFrame([("k", "old")], "key string, v string"), spark.createDataFrame([("k", "new"), ("l", "new")], "key string, v string")
    assert {r.key: r.v for r in x.merged_by_key(a, b).collect()} == {"k": "old", "l": "new"}


def test_newest_rows_go(spark):
    rows = spark.createDataFrame([("2025-01-02", 0), ("2025-01-02", 1), ("2025-01-01", 2)], "date string, idx int")
    assert [r.idx for r in x.without_newest(rows, 1, "date", "idx").orderBy("idx").collect()] == [1, 2]
    assert x.without_newest(rows, 9, "date", "idx").count() == 0 and x.without_newest(rows, -1, "date", "idx").count() == 3


def test_model_families():
    x.families_differ({"a": "one/x", "b": "two-y"}, ("a", "b"))
    with pytest.raises(ValueError):
        x.families_differ({"a": "one/x", "b": "one-y"}, ("a", "b"))


ENTRY = """2026-07-22 08:35:29,659 INFO [wiki-update] (Tool Code (graph + wiki:all update)) Refreshed the graph -- and 3 pages -- success
branch:  phase2-parsing
task:    Phase 2 sync
files:   out/, wiki/start.md, A.md
note: k: v
note: again
details: before: after
no colon here"""


def test_logs_of_the_true_shape(spark, tmp_path):
    blocks = [ENTRY, "garbage\nmore\n2025-01-02 03:04:05,678 WARNING [] (open bracket did x -- done", "only garbage", "\n", "2025-01-02 03:04:05,6789 ERROR [a] no tool"]
    (tmp_path / "log.txt").write_text(logs.SEPARATOR.join(blocks) + logs.SEPARATOR)
    rows = logs.parsed(logs.read(spark, str(tmp_path / "log.txt")))
    got = logs.newest_first(rows).collect()
    assert [r.timestamp for r in got] == ["2026-07-22 08:35:29,659", "2025-01-02 03:04:05,6789", "2025-01-02 03:04:05,678", None, None]
    a, c, b = got[:3]
    assert a.asDict(True) == {
        "timestamp": "2026-07-22 08:35:29,659", "level": "INFO", "operation": "wiki-update", "tool": "Tool Code (graph + wiki:all update)", "summary": "Refreshed the graph -- and 3 pages", "status": "success",
        "branch": "phase2-parsing", "task": "Phase 2 sync", "files": ["out/", "wiki/start.md", "A.md"], "details": "before: after", "extra": {"note": "again"}, "fragment": None,
    }
    assert (b.level, b.operation, b.tool, b.summary, b.status, b.files, b.extra) == ("WARNING", "", "", "(open bracket did x -- done", None, [], {})
    assert (c.tool, c.summary, c.status) == ("", "no tool", None)
    assert sorted(r.fragment for r in got[3:]) == ["garbage\nmore", "only garbage"]
    assert sorted(len(r.why) for r in logs.invalid(rows.where("fragment IS NULL")).collect()) == [2, 3]
    assert {r.status: (r.n, r.latest) for r in logs.activity(rows.where("fragment IS NULL")).collect()}["success"] == (1, a.summary)
    whole = rows.where("status = 'success'")
    logs.append(whole, str(tmp_path / "again"))
    logs.append(whole, str(tmp_path / "again"))
    assert logs.parsed(logs.read(spark, str(tmp_path / "again"))).collect() == [a, a]
    with pytest.raises(ValueError):
        logs.append(whole.withColumn("status", F.lit("ok")), str(tmp_path / "again"))


def test_inline_tags_and_tables():
    page = "<p>was $<ix:nonFraction>394.3</ix:nonFraction>B, <b>up</b>ward <i>4</i>%</p><div>a<br>b</div>"
    assert store.to_markdown(page) == "was $394.3B, upward 4%\n\na\n\nb"
    assert store.to_markdown("<p>about $\n <ix:a>\n 3,253\n </ix:a>\n . Then <ix:b>5</ix:b> million</p>") == "about $3,253. Then 5 million"
    table = "<table><tr><td colspan=3><div>Interest</div><div>Rate</div></td><td colspan='3' /><td colspan=2>2025</td></tr><tr><td colspan=3>Debt</td><td colspan=3></td><td>$</td><td>1<b>29</b></td></tr></table>"
    assert store.to_markdown(table) == "| Interest Rate | 2025 |  |\n| Debt | $ | 129 |"
    assert store.to_markdown(None) == "" and store.to_markdown("<table><tr><td>open<tr><td>end") == "| open |\n| end |"


def lines(spark):
    return spark.createDataFrame([(1, "alpha beta\ngamma delta\nred green"), (2, "one two three"), (3, "")], "doc_id long, text string")


def build(rows):
    return n.from_lines(rows).withColumns({"parent_item_header": F.lit(None).cast("string"), "source_page_num": F.lit(None).cast("int")})


def test_ingestion_skips_what_is_there(spark, tmp_path):
    docs = lines(spark)
    first = runs.ingest(spark, docs.where("doc_id = 1"), build, str(tmp_path), "doc_id").collect()
    assert [tuple(r) for r in first] == [("1", 3, False)]
    again = {tuple(r) for r in runs.ingest(spark, docs, build, str(tmp_path), "doc_id").collect()}
    assert again == {("1", 3, True), ("2", 1, False)}
    assert store.read(spark, str(tmp_path), "nodes").count() == 4


def test_trees_are_built_once_replaced_by_a_newer_run_and_never_empty(spark, tmp_path):
    root = str(tmp_path)
    nodes = n.from_lines(lines(spark)).withColumn("document_id", F.col("document_id").cast("string"))
    some = nodes.select("document_id").distinct()
    costs = {r.document_id: (r.skipped, r.input_tokens, r.output_tokens) for r in runs.build_trees(spark, some, nodes, root, 1).collect()}
    assert costs == {"1": (False, 6, 6), "2": (False, 0, 0)}
    store.log_costs(runs.build_trees(spark, some, nodes, root, 2), f"{root}/costs")
    assert {r.document_id: (r.builds, r.skips, r.input_tokens) for r in x.costs_by_document(store.costs(spark, f"{root}/costs")).collect()} == {"1": (0, 1, 0), "2": (0, 1, 0)}
    before = store.trees(spark, root).count()
    with pytest.raises(ValueError, match="no nodes"):
        runs.build_trees(spark, some.union(spark.createDataFrame([("9",)], "document_id string")), nodes, root, 3)
    assert store.trees(spark, root).count() == before == 5
    store.save_trees(store.trees(spark, root).where("document_id = '2'").withColumn("run", F.lit(7)), root)
    assert {(r.document_id, r.run) for r in store.trees(spark, root).collect()} == {("1", 1), ("2", 7)}


def test_cells_with_another_answerer_and_judge(spark):
    nodes = n.from_lines(lines(spark))
    asked = spark.createDataFrame([("q", "gamma red", "red", "Q1", 1, ["1_n0003"])], "query_id string, query_text string, ground_truth_answer string, quadrant string, document_id long, gt_citations array<string>")
    cells = x.matrix(asked, pipelines=("P2",), ks=(3,))
    say = Model("say", lambda: lambda questions, contexts: [f"red [[node:1_n0003]] {len(c)}" for q, c in zip(questions, contexts, strict=True)], "string")
    (row,) = runs.run_cells(cells, asked, nodes, cells.limit(0), say, Model("nine", lambda: lambda said, truth: [9] * len(said), "int")).collect()
    assert (row.precision_at_k, row.recall_at_k, row.evidence_hit, row.citation_match, row.judge_score, row.exact_match) == (round(1 / 3, 6), 1.0, 1, 1, 9, 0)
    assert row.cited_node_ids == ["1_n0003"] and row.pipeline_output.endswith(str(len("alpha beta\n\ngamma delta\n\nred green"))) and row.latency_sec >= 0 and row.output_tokens == 3
    assert sorted(row.retrieved_node_ids) == ["1_n0001", "1_n0002", "1_n0003"]
    assert runs.run_cells(cells, asked, nodes, cells).count() == 0


def test_prompts_yields_and_daily_usage(spark):
    golden = spark.createDataFrame([(i, "Q1", f"q{i}", f"a{i}", i) for i in range(9)], "query_id int, quadrant string, query_text string, ground_truth_answer string, human_score int")
    prefix = x.prompt_prefixes(x.first_each(golden, 5), "Rubric")
    cells = spark.createDataFrame([("Q1", "why", "so")], "quadrant string, query_text string, pipeline_output string")
    prompt = x.prompts(prefix, cells).first().prompt
    assert prompt.startswith("Rubric\n\nQ: q0") and prompt.count("Score:") == 6 and prompt.endswith("Q: why\nA: so\nScore:")
    tried = spark.createDataFrame([("Q1", True), ("Q1", False), ("Q2", True)], "quadrant string, accepted boolean")
    assert {tuple(r) for r in x.yields(tried).collect()} == {("Q1", 2, 1, 0.5), ("Q2", 1, 1, 1.0)}


def test_manifest_lists_and_rules(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"document_id": "A_2025", "ticker": "A", "fiscal_year": 2025},\n {"document_id": "B_2025", "ticker": "B", "fiscal_year": 2025}]')
    wanted = store.manifest(spark, str(tmp_path / "m.json"))
    assert [r.fiscal_year for r in wanted.collect()] == [2025, 2025] and store.duplicated(wanted, "document_id").count() == 0
    assert [r.document_id for r in store.to_fetch(wanted, wanted.where("ticker = 'A'")).collect()] == ["B_2025"]
    assert spark.range(1).select(store.from_json(store.as_json(F.array(F.lit("a"), F.lit("b"))))).first()[0] == ["a", "b"]
    rows = spark.createDataFrame([("PQ", "P1", 3, 0.5, 0.5, 11, None), ("XX", "P9", 4, 1.5, 0.5, 1, 1)], "source_set string, pipeline string, k_value int, precision_at_k double, recall_at_k double, judge_score int, human_score int")
    assert {r.rule: r.n for r in x.violations(rows, x.result_rules()).collect()} == {"source_set": 1, "pipeline": 1, "k_value": 1, "precision": 1, "recall": 0, "judge_score": 1, "human_score": 0}


def test_later_rows_of_a_key_are_dropped(spark, tmp_path):
    spark.createDataFrame([(1, "2025-01-01 00:00:00"), (1, "2025-01-01 01:00:00"), (2, "2025-01-01 02:00:00")], "k int, ts string").coalesce(1).write.parquet(f"{tmp_path}/in")
    out = usage.first_only(usage.stream(spark, f"{tmp_path}/in", "*.parquet"), "k")
    run = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]


def test_manifest_of_reports(spark):
    row = '<td class="timestamp">{}</td>\n <td><a href="{}">{}</a></td><td class="description">{}</td>'
    first = row.format("2025-01-01", "reports/2025-02-03-b.html", "B &amp;amp;lt;x&gt;", " d ") + row.format("2025-05-05", "undated.html", "U", "") + row.format("x", "index.html", "skip", "")
    second = row.format("2024-01-01", "2025-02-03-b.html", "later", "later") + row.format("", "2025-02-03-a.html", "A", "a\nb")
    pages = spark.createDataFrame([(0, first), (1, second)], "page int, value string")
    files = spark.createDataFrame([("2025-02-03-z.html", "<h1>Zed\n  z</h1>"), ("2026-01-01-y.html", "none"), ("index.html", "<h1>no</h1>"), ("2025-02-03-b.html", "<h1>B</h1>"), ("notes.html", "")], "file string, value string")
    got = [tuple(r) for r in reports.seeded(pages, files).collect()]
    assert got == [
        ("2026-01-01", "2026-01-01-y.html", "2026-01-01-y", ""), ("2025-05-05", "undated.html", "U", ""), ("2025-02-03", "2025-02-03-b.html", "B <x>", "d"),
        ("2025-02-03", "2025-02-03-a.html", "A", "a\nb"), ("2025-02-03", "2025-02-03-z.html", "Zed z", ""),
    ]
    fields = spark.createDataFrame([("level", True, ["INFO"]), ("note", False, None)], "key string, required boolean, enum array<string>")
    assert reports.log_rules(fields) == (["level"], {"level": ["INFO"]})
    old, new = spark.createDataFrame([("a", "x", 1)], "key string, value string, added_in int"), spark.createDataFrame([("a", "y"), ("b", "z")], "key string, value string")
    assert sorted(map(tuple, reports.reconciled(old, new, 2).collect())) == [("a", "x", 1), ("b", "z", 2)]


def test_landed_and_parsed_files(spark, tmp_path):
    (tmp_path / "A_2025.html").write_text("<p>x")
    (tmp_path / "B_2025.html").write_bytes(b"\xff")
    got = {r.document_id: bytes(r.content) for r in store.landed(spark, str(tmp_path)).collect()}
    assert got == {"A_2025": b"<p>x", "B_2025": b"\xff"}
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "A_2025.md").write_text("one\n\ntwo")
    assert [tuple(r) for r in store.parsed(spark, str(tmp_path / "md")).collect()] == [("A_2025", "one\n\ntwo")]


def test_a_right_answer_with_a_wrong_citation(spark):
    rows = spark.createDataFrame([(1, 0), (1, 1), (0, 0)], "e int, c int")
    assert [r.x for r in rows.select(m.coincidental(F.col("e"), F.col("c")).alias("x")).collect()] == [True, False, False]


def test_analysis_tables(spark, tmp_path):
    rows = spark.createDataFrame([("P1", 3, q, 0.5, 1.0, 1, 0.25, 7) for q in schemas.QUADRANTS], "pipeline string, k_value int, quadrant string, precision_at_k double, recall_at_k double, evidence_hit int, token_f1 double, output_tokens int")
    runs.write_tables(rows, str(tmp_path / "tables"))
    version = tmp_path / "tables" / "version-00000001"
    read = lambda name: spark.read.option("header", True).csv(str(version / name)).collect()
    (row,) = read("by_pipeline")
    assert (row.pipeline, row.n, row.mean_precision_at_k, row.output_tokens) == ("P1", "4", "0.5", "28") and len(read("by_quadrant")) == 4 and len(read("cube")) == 1 + 1 + 1 + 4 + 1 + 4 + 4 + 4
