"""Calendar projections (PRJ-02..09): pure column expressions, no shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rnd


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_date(text, fmt: str = "yyyy-MM-dd") -> Column:
    return F.try_to_date(_c(text), fmt)


def day_of_week(d) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(_c(d))


def is_weekend(d) -> Column:
    return (F.weekday(_c(d)) >= 5).cast("int")


def day_name(d) -> Column:
    return F.date_format(_c(d), "EEEE")


def year_progress(d) -> Column:
    """day-of-year / 365 (a leap year's Dec 31 gives > 1, as in the reference)."""
    return F.dayofyear(_c(d)) / F.lit(365.0)


def calendar_features(df: DataFrame, date_col: str = "traffic_date") -> DataFrame:
    d = F.col(date_col)
    return df.select(
        "*", F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"),
        F.quarter(d).alias("quarter"), F.dayofyear(d).alias("day_of_year"),
        day_of_week(d).alias("day_of_week"), F.weekofyear(d).alias("week_of_year"))


def cyclical(x, period: int) -> tuple[Column, Column]:
    a = F.lit(2 * math.pi) * _c(x) / F.lit(float(period))
    return F.sin(a), F.cos(a)


def cyclical_encoding(df: DataFrame, date_col: str = "traffic_date", digits: int | None = None) -> DataFrame:
    d = F.col(date_col)
    out = []
    for name, x, p in (("month", F.month(d), 12), ("dow", day_of_week(d), 7), ("quarter", F.quarter(d), 4)):
        s, c = cyclical(x, p)
        if digits is not None:
            s, c = rnd(s, digits), rnd(c, digits)
        out += [s.alias(f"{name}_sin"), c.alias(f"{name}_cos")]
    return df.select("*", *out)


def days_since_start(df: DataFrame, date_col: str = "traffic_date") -> DataFrame:
    """PRJ-07: days since the global first date, via a 1-row broadcast (no global window)."""
    first = df.agg(F.min(date_col).alias("_first"))
    return df.crossJoin(F.broadcast(first)) \
        .withColumn("days_since_start", F.datediff(F.col(date_col), F.col("_first"))).drop("_first")
