"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanespark.session import cut_lineage, ensure_checkpoint_dir


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the application's Python workers, once; they may not have it installed.

    A package that is not a plain folder was already handed over as an archive.
    """
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if sc.applicationId in _SHIPPED or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="lanespark-code-")) / "lanespark-code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def drawn(keys: list, rows: int, n: int, seed: int):
    """Condition that holds for about ``rows`` of ``n`` rows (all, if there are no more), by a hash of their keys."""
    share = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return share < min(1.0, rows / max(1, n))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: Spark then knows its size when it plans a join."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` whose key is not in ``ids`` (distinct keys); rows with a null key stay.

    The list is written first, so that Spark plans the join by its size: a
    short one is broadcast and the rows stay where they are, a long one is
    shuffled with them.
    """
    return rows.join(stored(ids.select(key)), key, "left_anti").select(*rows.columns)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph given by long columns ``src`` and ``dst``.

    Returns one row ``(node, component)`` per node that has an edge to another
    node; ``component`` is the smallest node id reachable. Self loops and
    repeated edges are allowed and change nothing; no edges give an empty
    table.

    Every round lets each node point at its smallest neighbour (or itself),
    follows the pointers to their ends by doubling, and contracts the edges to
    those ends, so the number of nodes at least halves. All grouping is by
    partial minimum; the joins run between materialised tables, so a node that
    many others point at is a skewed join that AQE splits. Intermediate tables
    are checkpointed in the shared folder.
    """
    e = cut_lineage(edges.where(F.col("src") != F.col("dst"))
                    .select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    maps = []
    while not is_empty(e):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        p = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")))
        while True:
            nxt = p.select(F.col("u").alias("t"), F.col("p").alias("pp"))
            q = cut_lineage(p.join(nxt, F.col("p") == F.col("t")).select("u", F.col("pp").alias("p"),
                                                                         (F.col("p") != F.col("pp")).alias("moved")))
            p, moved = q.select("u", "p"), q.where("moved")
            if is_empty(moved):
                break
        maps.append(p)
        ends = e
        for side in ("a", "b"):
            m = p.select(F.col("u").alias("t"), F.col("p").alias("e_" + side))
            ends = ends.join(m, F.col(side) == F.col("t")).drop("t")
        e = cut_lineage(ends.where(F.col("e_a") != F.col("e_b"))
                        .select(F.least("e_a", "e_b").alias("a"), F.greatest("e_a", "e_b").alias("b")).distinct())
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[0].select(F.col("u").alias("node"), F.col("p").alias("component"))
    for m in maps[1:]:
        nxt = m.select(F.col("u").alias("t"), F.col("p").alias("pp"))
        out = out.join(nxt, F.col("component") == F.col("t"), "left").select(
            "node", F.coalesce("pp", "component").alias("component"))
    return cut_lineage(out) if len(maps) > 1 else out
