"""Column expressions over text: blocks, tokens, citations, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns that define nodes, tokens and citations.
EDGES = r"(?U)^\s+|\s+\z"
GAPS = r"(?U)\s+"
SECTION = r"(?i)\A#{1,3}\s*(Item\s+\d+[A-Za-z]?\.?\s*[^\n]+?)\s*\z"
TOKEN = r"[$£€]?\d+(?:,\d{3})*(?:\.\d+)?%?|\p{L}+"
CITATION = r"\[\[node:([\w\-]+)\]\]"
AMOUNT = r"(?i)^\s*\(?\s*[$£€]?\s*(-?\d+(?:,\d{3})*(?:\.\d+)?)\s*(thousand|million|billion|trillion|k|m|b|t)?\s*%?\s*\)?\s*$"
#: What a unit multiplies by.
UNITS = {"k": 10**3, "thousand": 10**3, "m": 10**6, "million": 10**6, "b": 10**9, "billion": 10**9, "t": 10**12, "trillion": 10**12}


def bound(value: Column, body) -> Column:
    """body(value), with value worked out once however often body uses it, in lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at either end, non-breaking spaces among it."""
    return F.regexp_replace(c, EDGES, "")


def token_count(c: Column) -> Column:
    stripped = strip(c)
    return F.when(stripped == "", 0).otherwise(F.size(F.split(stripped, GAPS)))


def tokens(c: Column) -> Column:
    """Numbers with their signs, and words, lower-cased; the same for nodes and questions."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def section(c: Column) -> Column:
    """The title if the whole block is a section heading, else null."""
    return F.nullif(strip(F.regexp_extract(c, SECTION, 1)), F.lit(""))


def is_table(c: Column) -> Column:
    """Two or more lines that begin with a pipe."""
    return F.size(F.filter(F.split(c, r"\r\n|\n|\r"), lambda line: strip(line).startswith("|"))) >= 2


def node_id(document_id: Column, seq: Column) -> Column:
    return F.format_string("%s_n%04d", document_id.cast("string"), seq.cast("int"))


def citations(c: Column) -> Column:
    """Ids cited in a text, each once, in the order of their first mention."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(CITATION), F.lit(1)))


def without_citations(c: Column) -> Column:
    return F.regexp_replace(c, CITATION, "")


def plain(c: Column) -> Column:
    """Lower-cased, punctuation removed, single spaces: what remains of a text when numbers don't decide."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", ""), GAPS, " "))


def amount(c: Column) -> Column:
    """A text that is one number, with its unit, as a decimal; else null. Brackets don't change the sign."""
    digits = F.regexp_replace(F.nullif(F.regexp_extract(c, AMOUNT, 1), F.lit("")), ",", "")
    unit = F.lower(F.regexp_extract(c, AMOUNT, 2))
    times = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv)), unit), F.lit(1)).cast("decimal(38,6)")
    return (digits.try_cast("decimal(24,6)") * times).cast("decimal(38,6)")


def close(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Equal up to a share of b; where b is 0, equal."""
    return F.when(b == 0, a == b).otherwise(F.abs(a - b) <= F.abs(b) * F.lit(tolerance).cast("decimal(10,6)"))


def exact_match(output: Column, truth: Column, quadrant: Column | None = None, numeric: str = "any", tolerance: float = 0.01) -> Column:
    """Whether output states truth: within tolerance if truth is a number ("any" token of output, or the "whole" of it), else as plain text. Null in Q2 and Q4."""
    said, wanted = without_citations(output), amount(truth)
    if numeric == "any":
        numbers = F.regexp_extract_all(said, F.lit(r"[$£€]?-?\d+(?:,\d{3})*(?:\.\d+)?\s*(?:(?:thousand|million|billion|trillion|[kKmMbBtT])\b)?%?"), F.lit(0))
        number = F.exists(numbers, lambda x: F.coalesce(close(amount(x), wanted, tolerance), F.lit(False)))
    else:
        number = F.coalesce(close(amount(said), wanted, tolerance), F.lit(False))
    same = F.when(wanted.isNotNull(), number).otherwise(plain(said) == plain(truth)).cast("int")
    return same if quadrant is None else F.when(quadrant.isin("Q1", "Q3"), same)


def token_f1(output: Column, truth: Column) -> Column:
    """F1 of the two token multisets; both empty: 1, one empty: 0."""
    a, b = tokens(without_citations(output)), tokens(truth)
    count = lambda of, x: F.size(F.filter(of, lambda y: y == x))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))
