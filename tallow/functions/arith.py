"""Integer helpers as SQL expression strings and plain functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div_down(a: int, b: int) -> int:
    return a // b


def div_up(a: int, b: int) -> int:
    return -(-a // b)


def round_down(a: int, b: int) -> int:
    return a - a % b


def round_up(a: int, b: int) -> int:
    return div_up(a, b) * b


def is_power_of_two(a: int) -> bool:
    return a > 0 and a & (a - 1) == 0


def div_up_col(a: str, b: int) -> Column:
    return F.expr(f"({a} + {b - 1}) div {b}")


def round_up_col(a: str, b: int) -> Column:
    return F.expr(f"(({a} + {b - 1}) div {b}) * {b}")


def round_down_col(a: str, b: int) -> Column:
    return F.expr(f"{a} - pmod({a}, {b})")


def truncated_ratio(num: str, den: str, digits: int = 3) -> Column:
    """num / den cut, not rounded, to so many decimals; null where den is 0."""
    scale = 10**digits
    return F.expr(f"CAST(({num} * {scale}) div nullif({den}, 0) AS DOUBLE) / {scale}")
