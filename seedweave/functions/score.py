"""Score formulas as column expressions.

``m`` is the length of a kept segment, ``S`` the sum of m(m+1)/2 and ``C`` the
sum of m over the kept segments of one read against one reference.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scores are compared and grouped at the precision in which they are printed.
SCORE_DIGITS = 6


def triangle(m: Column) -> Column:
    """m(m+1)/2 in BIGINT; one of the factors is even, so nothing is lost."""
    m = m.cast("bigint")
    return F.shiftright(m * (m + F.lit(1)), 1)


def coverage_pct(covered: Column, query_len: Column) -> Column:
    return F.lit(100.0) * covered / query_len


def raw_score(sum_sq: Column, considered: Column, pct: Column) -> Column:
    return sum_sq.cast("double") / considered.cast("double") / F.lit(100.0) * pct


def relative_score(raw: Column, query_len: Column, ref_len: Column) -> Column:
    """1.0 for a read that matches its reference over its full length."""
    shorter = F.least(query_len, ref_len).cast("double")
    return F.log(raw + F.lit(1.0)) / F.log((shorter + F.lit(1.0)) / F.lit(2.0) + F.lit(1.0))


def printed(score: Column) -> Column:
    return F.round(score, SCORE_DIGITS)
