"""Arithmetic between results: division and remainder by zero follow IEEE 754 instead of failing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    """a / b; x / 0 is an infinity of x's sign, 0 / 0 is NaN."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, by_zero).otherwise(a / F.nullif(b, F.lit(0.0)))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of a; NaN if b is zero."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a % F.nullif(b, F.lit(0.0)))


OPERATORS = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": divide,
    "%": modulo,
    "^": lambda a, b: F.pow(a, b),
}


def combine(op: str, a: Column, b: Column) -> Column:
    """a op b for one of + - * / % ^; comparison and set operators are not supported."""
    if op not in OPERATORS:
        raise ValueError(f"operator {op!r} is not supported")
    return OPERATORS[op](a, b)
