import pytest
from pyspark.sql import functions as F

from lodeworks.functions import text as t
from lodeworks.operators import nodes as n

MARKDOWN = "before\n\n# Item 1A. Risk Factors\n\nFirst  block here\n\n| a | b |\n| - | - |\n| 1 | 2 |\n\nCaption\n| x |\n| y |\n\n## Item 7. Talk\n\none | pipe\n\n  \n\nlast"


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([("D_2025", MARKDOWN), ("E_2025", ""), ("F_2025", None)], "document_id string, markdown string")
    return [r.asDict() for r in n.from_markdown(df).orderBy("document_id", "node_seq").collect()]


def test_nodes_are_numbered_without_gaps(rows):
    assert [r["node_id"] for r in rows] == [f"D_2025_n{i:04d}" for i in range(1, 7)]


def test_sections_reach_the_nodes_after_them(rows):
    assert [r["parent_item_header"] for r in rows] == [None, *["Item 1A. Risk Factors"] * 3, *["Item 7. Talk"] * 2]


def test_tables_stay_whole_also_below_a_caption(rows):
    assert [r["node_type"] for r in rows] == ["text", "text", "table", "table", "text", "text"]
    assert rows[2]["content"].count("\n") == 2


def test_tokens_are_parted_by_white_space(rows):
    assert [r["token_count"] for r in rows][:2] == [1, 3]


@pytest.mark.parametrize(
    "block, title",
    [
        ("# Item 1A. Risk Factors", "Item 1A. Risk Factors"), ("### item 7 talk ", "item 7 talk"), ("# Item 12", "Item 12"), ("# Item 1", None),
        ("#### Item 3. X", None), ("# Item 2. Y\nbody", None), ("Item 2. Y", None),
    ],
)
def test_headings(spark, block, title):
    assert spark.range(1).select(t.section(F.lit(block))).first()[0] == title


def test_lines_as_nodes(spark):
    df = spark.createDataFrame([(1, "a b\n\n  c \n"), (2, None), (3, "")], "doc_id long, text string")
    got = [(r.document_id, r.node_seq, r.content, r.token_count) for r in n.from_lines(df).orderBy("document_id", "node_seq").collect()]
    assert got == [(1, 1, "a b", 2), (1, 2, "c", 1)]


def test_ten_thousandth_node_widens(spark):
    assert spark.range(1).select(t.node_id(F.lit("D"), F.lit(12345))).first()[0] == "D_n12345"


def test_text_nodes_have_no_token_count(spark, rows):
    df = spark.createDataFrame([("D", "# Item 1A. X\n\na b")], "document_id string, markdown string")
    row = n.as_text_nodes(n.from_markdown(df)).first()
    assert row.asDict(True) == {"id_": "D_n0001", "text": "a b", "metadata": {"document_id": "D", "parent_item_header": "Item 1A. X", "node_type": "text", "source_page_num": None}}
