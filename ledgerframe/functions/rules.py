"""Rules as data: lists of (code, condition) become array columns, verdicts become CASE columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def fired(*rules: tuple[str, Column]) -> Column:
    """The codes whose condition holds, in the order given; a null condition doesn't fire."""
    return F.filter(F.array(*(F.when(cond, F.lit(code)) for code, cond in rules)), lambda c: c.isNotNull())


def verdict(*cases: tuple[Column, str], otherwise: str) -> Column:
    """The first verdict whose condition holds."""
    out = reduce(lambda acc, case: acc.when(case[0], case[1]), cases[1:], F.when(*cases[0]))
    return out.otherwise(otherwise)


def some(codes: Column) -> Column:
    return F.size(codes) > 0
