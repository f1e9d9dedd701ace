from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodeworks.functions import metrics as m
from lodeworks.functions import text as t


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def ids(*names):
    return F.array(*map(F.lit, names)).cast("array<string>")


def test_tokens(spark):
    assert one(spark, t.tokens(F.lit("Sales: $394.3B, or 394,328 | 4.2% Été"))) == ["sales", "$394.3", "b", "or", "394,328", "4.2%", "été"]


def test_citations_keep_their_first_order(spark):
    text = "a [[node:B_1-x]] [[node:A]][[node:B_1-x]] [[node:]] [[node:bad!]]"
    assert one(spark, t.citations(F.lit(text))) == ["B_1-x", "A"]
    assert one(spark, t.citations(F.lit(""))) == []


@pytest.mark.parametrize(
    "text, value",
    [("$394.3B", "394300000000"), ("394,300 million", "394300000000"), ("£1.5k", "1500"), ("(267)", "267"), ("4.2%", "4.2"), ("abc", None), ("12 apples", None), ("", None), (None, None)],
)
def test_amounts(spark, text, value):
    got = one(spark, t.amount(F.lit(text).cast("string")))
    assert got == (None if value is None else Decimal(value))


@pytest.mark.parametrize(
    "said, truth, quadrant, match",
    [
        ("Net sales were $394.3B [[node:x]].", "394,300 million", "Q1", 1), ("About 100.9", "100", "Q1", 1), ("About 101.1", "100", "Q1", 0), ("zero 0", "0", "Q3", 1),
        ("0.1", "0", "Q3", 0), ("The  Answer!", "the answer", "Q1", 1), ("no", "yes", "Q3", 0), ("yes", "yes", "Q2", None), ("5", "5", "Q4", None),
    ],
)
def test_exact_match(spark, said, truth, quadrant, match):
    assert one(spark, t.exact_match(F.lit(said), F.lit(truth), F.lit(quadrant))) == match


@pytest.mark.parametrize("a, b, f", [("a b", "a b", 1.0), ("a", "b", 0.0), ("a a b", "a b b", 2 / 3), ("", "", 1.0), ("", "a", 0.0), ("[[node:x]]", "", 1.0)])
def test_token_f1(spark, a, b, f):
    assert one(spark, t.token_f1(F.lit(a), F.lit(b))) == pytest.approx(f)


def test_precision_divides_by_k_even_if_fewer_came(spark):
    assert one(spark, m.precision_at_k(ids("a", "b"), ids("a"), 5)) == pytest.approx(0.2)


def test_repeated_ids_count_once(spark):
    assert one(spark, m.precision_at_k(ids("a", "a", "b"), ids("a"), 3)) == pytest.approx(1 / 3)
    assert one(spark, m.recall_at_k(ids("a", "a"), ids("a", "c", "a"), 3)) == pytest.approx(0.5)


def test_nothing_to_find(spark):
    assert one(spark, m.recall_at_k(ids("a"), ids(), 3)) is None
    assert one(spark, m.evidence_hit(ids("a"), ids(), 3)) == 0


def test_citation_match(spark):
    assert one(spark, m.citation_match(ids(), ids("a"))) == 1
    assert one(spark, m.citation_match(ids("a", "z"), ids("a"))) == 0
    assert one(spark, m.citation_match(F.lit(None).cast("array<string>"), ids("a"))) is None
