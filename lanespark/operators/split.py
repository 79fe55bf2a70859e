"""Train/test split, scaling, folds and row blocks — all distributed.

Random splits use a deterministic hash order instead of ``rand()`` (same
sizes as the reference's 70/30 split, reproducible on any cluster layout).
Row positions come from ``global_row_number`` (range partitioning + prefix
offsets), never from a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import global_row_number


# Two Lehmer multipliers modulo the Mersenne prime 2^31 - 1.
_M31, _A, _B = 2147483647, 48271, 69621


def arith_hash(key: Column, seed: int) -> Column:
    """Portable 62-bit hash of a non-negative integer key (same value in any SQL engine).

    The two halves come from different multipliers; keys that differ below 2^31 never share a value.
    """
    m = F.lit(_M31)
    low, high = F.pmod(key, m), F.floor(key / m).cast("long")
    a = F.pmod(low * F.lit(_A) + F.lit(seed * 7919), m)
    b = F.pmod(F.pmod(low + F.pmod(high, m) * F.lit(16807), m) * F.lit(_B) + F.lit(seed * 31), m)
    return a * F.lit(1 << 31) + b


def sql_arith_hash(key: str, seed: int) -> str:
    """The same hash as SQL text (``//`` is integer division)."""
    low, high = f"(({key}) % {_M31})", f"((({key}) // {_M31}) % {_M31})"
    return (f"((({low} * {_A} + {seed * 7919}) % {_M31}) * {1 << 31}"
            f" + ((({low} + {high} * 16807) % {_M31}) * {_B} + {seed * 31}) % {_M31})")


def daily_key(date: str = "traffic_date", road: str = "road_name") -> Column:
    """Integer key of a (date, road) row: day number and the road's number."""
    return F.unix_date(date).cast("long") * 100 + F.regexp_extract(road, r"(\d+)$", 1).try_cast("long")


SQL_DAILY_KEY = ("(traffic_date - DATE '1970-01-01') * 100"
                 " + TRY_CAST(regexp_extract(road_name, '([0-9]+)$', 1) AS BIGINT)")


def train_test_split(df: DataFrame, order: list, test_fraction: float = 0.3, name: str = "is_test") -> DataFrame:
    """FP-02: the first ceil(n * test_fraction) rows of ``order`` are the test set."""
    j = global_row_number(df, order, "_rn", total="_n")
    return j.withColumn(name, F.col("_rn") <= F.ceil(F.col("_n") * F.lit(test_fraction))) \
        .withColumnRenamed("_rn", "row_id").drop("_n")


def fit_scaler(train: DataFrame, cols: list[str]) -> DataFrame:
    """FP-03 fit: mean and *population* std per column on the training rows (one row)."""
    return train.agg(*[e for c in cols for e in (F.avg(c).alias(f"{c}__mu"), F.stddev_pop(c).alias(f"{c}__sd"))])


def apply_scaler(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    """FP-03 transform: (x - mu) / sd, sd = 0 -> 1 (stats is a 1-row frame: broadcast)."""
    j = df.crossJoin(F.broadcast(stats))
    out = []
    for c in cols:
        sd = F.when(F.col(f"{c}__sd") == 0, F.lit(1.0)).otherwise(F.col(f"{c}__sd"))
        out.append(((F.col(c) - F.col(f"{c}__mu")) / sd).alias(c))
    keep = [c for c in df.columns if c not in cols]
    return j.select(*keep, *out)


def contiguous_folds(rn: Column, n: Column, k: int = 5) -> Column:
    """WN-15: fold 1..k over row order, the first n % k folds one row larger (= ntile(k))."""
    q = F.floor(n / k)
    r = n % k
    big = r * (q + 1)
    return F.when(rn <= big, F.floor((rn - 1) / (q + 1)) + 1) \
        .otherwise(r + F.floor((rn - 1 - big) / q) + 1).cast("int")


def row_blocks(df: DataFrame, order: list, ws: int, min_blocks: int = 2) -> DataFrame:
    """WN-13: consecutive blocks of ``ws`` rows; the tail is dropped; empty if < min_blocks blocks."""
    j = global_row_number(df, order, "_rn", total="_n")
    nb = F.floor(F.col("_n") / ws)
    return j.where((nb >= min_blocks) & (F.col("_rn") <= nb * ws)) \
        .withColumn("block", (F.floor((F.col("_rn") - 1) / ws) + 1).cast("int")).drop("_n")
