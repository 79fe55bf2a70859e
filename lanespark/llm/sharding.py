"""Sharding by a two-pass external shuffle, in DataFrame expressions only.

Pass one scatters the rows uniformly by a seeded hash into buckets that fit in
memory; their number follows the bytes. Pass two gathers each bucket, applies a
Fisher-Yates shuffle to it and writes it. The shuffled buckets, one after the
other, are a random permutation of all rows, and the shards are equal slices of
it, so their row counts are at most one apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanespark.session import cut_lineage


def external_shuffle(rows: DataFrame, n_shards: int = 24, seed: int = 7, bucket_bytes: int = 8 << 20,
                     text_col: str = "text") -> DataFrame:
    """``rows`` with ``size`` (UTF-8 bytes of the text plus 8), ``shard`` (0 to n_shards - 1) and ``slot``.

    Slots are gapless from 0 in each shard and give the shuffled order. Law:
    ``rows``, shard sizes at most one row apart. A null text has no bytes.
    All columns of ``rows`` ride along, except those of the three names above,
    which are replaced. The bucket depends on the seed and
    on all columns, so equal rows share a bucket and other rows spread
    whatever key they share; inside a bucket rows are ordered by hash before
    the shuffle, so that a retry gives the same order. No rows give no rows.
    """
    names = [c for c in rows.columns if c not in ("size", "shard", "slot")]
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long") + 8
    mixed = F.xxhash64(F.lit(seed), *names)
    sized = rows.select(F.struct(*names).alias("row"), size.alias("size"), mixed.alias("mixed"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    n_buckets = max(1, -(-total // bucket_bytes))
    scattered = sized.withColumn("bucket", F.pmod(F.xxhash64("mixed"), F.lit(n_buckets)))
    counts = cut_lineage(scattered.groupBy("bucket").agg(F.count("*").alias("n")))  # one row for each bucket
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    n = counts.agg(F.sum("n")).first()[0] or 0
    shuffled = scattered.groupBy("bucket").agg(F.collect_list(F.struct("mixed", "size", "row")).alias("bag")) \
        .select("bucket", F.shuffle(F.array_sort("bag", lambda a, b: F.when(a.mixed < b.mixed, -1)
                                                 .when(a.mixed > b.mixed, 1).otherwise(0)), seed).alias("bag"))
    dealt = shuffled.join(offsets, F.col("bucket") == F.col("b")).select("first", F.posexplode("bag"))
    place = F.col("first") + F.col("pos")
    shard = F.expr(f"(first + pos) * {n_shards} div {max(n, 1)}")
    start = F.expr(f"(((first + pos) * {n_shards} div {max(n, 1)}) * {n} + {n_shards - 1}) div {n_shards}")
    return dealt.select("col.row.*", F.col("col.size").alias("size"), shard.cast("int").alias("shard"),
                        (place - start).alias("slot"))


def write_shards(shards: DataFrame, path: str) -> None:
    """Write the shuffled rows to one folder for each shard, in slot order within each file."""
    shards.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard") \
        .mode("overwrite").parquet(path)
