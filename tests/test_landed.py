import json

import pytest
from pyspark.sql import functions as F

from lodeworks.operators import logs
from lodeworks.sources import landed, store


@pytest.fixture(scope="module")
def session(spark):
    landed.register(spark)
    return spark


def test_lookup_and_filings(session, tmp_path):
    (tmp_path / "tickers.json").write_text(json.dumps({"1": {"cik_str": 7, "ticker": "B", "title": "Bee"}, "0": {"cik_str": 320193, "ticker": "A"}}))
    rows = session.read.format("landed_lookup").load(str(tmp_path / "tickers.json"))
    assert sorted(map(tuple, rows.collect())) == [(0, 320193, "A", None), (1, 7, "B", "Bee")] and [r.cik_str for r in session.read.format("landed_lookup").option("tickers", "B, C").load(str(tmp_path / "tickers.json")).collect()] == [7]
    assert sorted(r.pos for r in rows.where("ticker = 'A'").union(rows.where("ticker = 'B'")).collect()) == [0, 1]
    folder = tmp_path / "lists"
    folder.mkdir()
    for cik, year in ((320193, 2025), (7, 2024)):
        recent = {"form": ["8-K", "10-K"], "reportDate": [f"{year}-01-01", f"{year}-09-01"], "accessionNumber": ["1-2", "3-4"], "primaryDocument": ["a.htm", "b.htm"]}
        (folder / f"CIK{cik:010d}.json").write_text(json.dumps({"filings": {"recent": recent}}))
    (folder / "CIK0000000009.json").write_text("not read unless it is asked for")
    listed = session.read.format("landed_filings").load(str(folder))
    some = session.read.format("landed_filings").option("ciks", "0000320193,0000000007").load(str(folder))
    assert some.count() == 4  # the third file was never opened
    wanted = session.createDataFrame([("A_2025", "a", 2025), ("B_2025", "b", 2025)], "document_id string, ticker string, fiscal_year int")
    found = {r.document_id: r.url for r in store.first_filing(store.with_cik(wanted, rows), some).collect()}
    assert found["A_2025"].endswith("320193/34/b.htm") and found["B_2025"] is None
    with pytest.raises(Exception, match="JSON|Expecting"):
        listed.collect()


@pytest.mark.parametrize("size", [7, 90, 333, 1 << 20])
def test_logs_by_ranges_of_bytes(session, tmp_path, size):
    blocks = ["garbage", "2025-01-02 03:04:05,678 INFO [a] (t) é one -- success\nnote: x", "", "lost\n2025-01-03 00:00:00,000 INFO [b] (t) two -- failure", "2025-01-04 00:00:00,000 INFO [c] (t) " + "long " * 100 + "-- partial"]
    (tmp_path / "x.log").write_text(logs.SEPARATOR.join(blocks) + logs.SEPARATOR)
    (tmp_path / "y.log").write_text(blocks[1])
    (tmp_path / "_hidden.log").write_text(blocks[1])
    rows = session.read.format("operation_log").option("size", size).load(str(tmp_path))
    plain = session.read.option("lineSep", logs.SEPARATOR).text(str(tmp_path)).where("trim(BOTH '\n' FROM value) <> ''")
    assert sorted(r.value for r in rows.collect()) == sorted(r.value for r in plain.collect()) and rows.count() == 5
    since = session.read.format("operation_log").option("size", size).option("since", "2025-01-03").load(str(tmp_path))
    assert sorted(r.timestamp for r in since.collect()) == ["2025-01-03 00:00:00,000", "2025-01-04 00:00:00,000"]


def test_logs_are_written_whole_or_not_at_all(session, tmp_path):
    path, rows = str(tmp_path / "log"), session.range(0, 40, 1, 4).selectExpr("CAST(NULL AS string) AS timestamp", "concat('2025-01-01 00:00:00,000 INFO [a] (t) ', id, ' -- success') AS value")
    for n in (40, 80):
        rows.write.format("operation_log").mode("append").save(path)
        assert session.read.format("operation_log").load(path).count() == n == logs.parsed(logs.read(session, path)).count()
    bad = rows.withColumn("value", F.when(F.col("value").contains("39"), F.raise_error(F.lit("dies"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="dies"):
        bad.write.format("operation_log").mode("append").save(path)
    assert session.read.format("operation_log").load(path).count() == 80
