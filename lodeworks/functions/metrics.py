"""Scores of a ranked list, and of what was cited, against the ids that hold the answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hits(retrieved: Column, truth: Column, k: Column | int) -> Column:
    return F.size(F.array_intersect(F.slice(retrieved, 1, k), truth))


def precision_at_k(retrieved: Column, truth: Column, k: Column | int) -> Column:
    """Distinct hits over k, also where fewer than k were retrieved."""
    return hits(retrieved, truth, k) / (k if isinstance(k, Column) else F.lit(k))


def recall_at_k(retrieved: Column, truth: Column, k: Column | int) -> Column:
    """Null where there is nothing to find."""
    n = F.size(F.array_distinct(truth))
    return F.when(n > 0, hits(retrieved, truth, k) / n)


def evidence_hit(retrieved: Column, truth: Column, k: Column | int) -> Column:
    return F.arrays_overlap(F.slice(retrieved, 1, k), truth).cast("int")


def citation_match(cited: Column, truth: Column) -> Column:
    """Whether all that is cited is in truth: true where nothing is, null where cited is null."""
    return F.when(cited.isNotNull(), (F.size(F.array_except(cited, truth)) == 0).cast("int"))


def coincidental(exact: Column, match: Column) -> Column:
    """Right answer, wrong citation."""
    return (exact == 1) & (match == 0)


def agreement(human: Column, judge: Column, tolerance: int = 0) -> Column:
    """Share of rows whose scores are within tolerance."""
    return F.avg((F.abs(human - judge) <= tolerance).cast("double"))
