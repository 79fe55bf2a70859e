"""Numeric helpers shared by all operators.

``rnd`` rounds half-up through an exact decimal: the double is first fixed to
10 decimals, then rounded. That makes the result independent of the last-bit
noise that floating sums pick up from partition order, and it is the same
rule the SQL oracle applies (``sql_rnd``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rnd(x, digits: int) -> Column:
    return F.round(_c(x).cast("decimal(38,10)"), digits).cast("double")


def sql_rnd(expr: str, digits: int) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def safe_div(a, b) -> Column:
    """a / b, NULL when b is 0 or NULL (ANSI-safe)."""
    return F.try_divide(_c(a), _c(b))
