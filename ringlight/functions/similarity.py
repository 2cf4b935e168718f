"""Indel similarity: 100 * 2 * LCS / (len a + len b), with the longest common subsequence folded over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_length(a: Column, b: Column) -> Column:
    """One row of the dynamic program for each character of a; each row is an array with one place for each prefix of b."""
    chars = F.split(b, "")
    start = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def step(row: Column, ch: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            same = F.element_at(chars, j) == ch
            return F.concat(acc, F.array(F.when(same, F.element_at(row, j) + 1).otherwise(F.greatest(F.element_at(acc, j), F.element_at(row, j + 1)))))

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), cell)

    folded = F.element_at(F.aggregate(F.split(a, ""), start, step), -1)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(folded)


def could_reach(a: Column, b: Column, least: float) -> Column:
    """Whether the lengths alone allow a ratio of ``least``; a cheap filter before the fold."""
    return F.lit(200.0) * F.least(F.length(a), F.length(b)) >= F.lit(least) * (F.length(a) + F.length(b))


def indel_ratio(a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(F.lit(200.0) * lcs_length(a, b) / total)
