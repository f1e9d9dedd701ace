"""Column expressions that several of these operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeworks.runtime import unused  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Fixed value: the six ASCII white-space characters that end a word.
SPACE = r"[\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, UPPER.lower())


def words(c: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; null: none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), SPACE, -1), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body uses it, inside the body's own lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
