"""Online adaptation from distributed sufficient statistics (ON-01..03, ML-13).

Ridge refits on "training rows + every earlier block" need only the Gram
statistics of each block: G_b = X_b'X_b (with an intercept column), X_b'y,
y'y and n. They are computed in ONE pass: every task folds its rows into
per-block partial Grams (numpy inside the task), and a group-by on the block
adds the partials in a tree of two levels. Cross-validation solves its few
folds on the driver; online adaptation carries a running Gram through ordered
pieces of the rows and solves inside the tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups of the first merge level of partial Grams.
MERGE_FAN_IN = 64


def block_gram_frame(df: DataFrame, block: str, x: str, y: str) -> DataFrame:
    """One row per block: flattened Gram (with intercept column), X'y, y'y, n — computed distributedly."""

    def partial(batches):
        acc: dict[int, list] = {}
        for pdf in batches:
            for b, g in pdf.groupby(block):
                X = np.vstack(g[x].to_numpy())
                X1 = np.hstack([X, np.ones((len(X), 1))])
                yy = g[y].to_numpy(dtype=np.float64)
                part = [X1.T @ X1, X1.T @ yy, float(yy @ yy), float(len(yy))]
                if b in acc:
                    a = acc[b]
                    acc[b] = [a[0] + part[0], a[1] + part[1], a[2] + part[2], a[3] + part[3]]
                else:
                    acc[b] = part
        if acc:
            yield pd.DataFrame({
                block: list(acc.keys()),
                "gram": [v[0].ravel().tolist() for v in acc.values()],
                "xy": [v[1].tolist() for v in acc.values()],
                "yy": [v[2] for v in acc.values()],
                "n": [v[3] for v in acc.values()],
            })

    schema = f"{block} int, gram array<double>, xy array<double>, yy double, n double"
    parts = df.select(block, x, y).mapInPandas(partial, schema).withColumn(
        "part", F.pmod(F.spark_partition_id(), F.lit(MERGE_FAN_IN)))

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({block: [int(pdf[block].iloc[0])],
                             "gram": [np.sum(np.vstack(pdf["gram"].to_numpy()), axis=0).tolist()],
                             "xy": [np.sum(np.vstack(pdf["xy"].to_numpy()), axis=0).tolist()],
                             "yy": [float(pdf["yy"].sum())], "n": [float(pdf["n"].sum())]})

    # a tree of two levels: with T tasks no group holds more than max(T / fan-in, fan-in) partial Grams
    merged = parts.groupBy(block, "part").applyInPandas(combine, schema)
    return merged.groupBy(block).applyInPandas(combine, schema)


def block_grams(df: DataFrame, block: str, x: str, y: str, p: int) -> dict[int, dict]:
    """Per-block sufficient statistics on the driver — for a handful of blocks (CV folds)."""
    q = p + 1
    total = block_gram_frame(df, block, x, y)
    out = {}
    for r in total.collect():  # one row per fold: folds x p^2 doubles
        out[int(r[block])] = dict(G=np.array(r["gram"]).reshape(q, q), xy=np.array(r["xy"]), yy=r["yy"], n=r["n"])
    return out


def solve_ridge(G: np.ndarray, xy: np.ndarray, alpha: float) -> np.ndarray:
    """(G + alpha * I_features) w = X'y with an unpenalised intercept (last entry)."""
    pen = np.eye(G.shape[0]) * alpha
    pen[-1, -1] = 0.0
    return np.linalg.lstsq(G + pen, xy, rcond=None)[0]


def solve_l1(G: np.ndarray, xy: np.ndarray, n: float, alpha: float, l1_ratio: float = 1.0, sweeps: int = 1000,
             tol: float = 1e-9) -> np.ndarray:
    """Lasso / elastic net by coordinate descent on the Gram matrix (last column: intercept, not penalised).

    Minimises ``|y - Xw - b|^2 / 2n + alpha (l1_ratio |w|_1 + (1 - l1_ratio) |w|^2 / 2)``.
    """
    mean, label = G[-1, :-1] / n, xy[-1] / n
    g = G[:-1, :-1] / n - np.outer(mean, mean)
    c = xy[:-1] / n - mean * label
    w = np.zeros(len(c))
    rest = c.copy()                                  # c - g w
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(c)):
            if g[j, j] <= 1e-14:
                continue
            r = rest[j] + g[j, j] * w[j]
            new = np.sign(r) * max(abs(r) - alpha * l1_ratio, 0.0) / (g[j, j] + alpha * (1 - l1_ratio))
            if new != w[j]:
                rest -= g[:, j] * (new - w[j])
                most = max(most, abs(new - w[j]))
                w[j] = new
        if most <= tol * max(1.0, np.abs(w).max(initial=0.0)):
            break
    return np.append(w, label - mean @ w)


def r2_from_stats(s: dict, w: np.ndarray) -> float:
    """R2 of coefficients ``w`` from sufficient statistics.

    Both sums are taken about the label's mean: the last column is the
    intercept, so subtracting the mean from it centres every prediction."""
    n, mean = s["n"], s["xy"][-1] / s["n"]
    v = w.copy()
    v[-1] -= mean
    xy = s["xy"] - mean * s["G"][-1]
    sst = s["yy"] - n * mean * mean
    sse = sst - 2 * v @ xy + v @ s["G"] @ v
    return float(1 - sse / sst) if sst > 0 else float("nan")


def online_adaptation(train: DataFrame, test: DataFrame, order: list, x: str, y: str, p: int,
                      window_sizes: list[int], alpha: float = 0.001, min_blocks: int = 2,
                      piece_rows: int = 20_000) -> DataFrame:
    """ON-01/02: static ridge (training rows only) vs online ridge (training rows + earlier blocks) per block.

    Test rows are numbered once along ``order`` and cut into pieces of about
    ``piece_rows`` rows at which blocks of every window size begin. One pass
    gives each piece's Gram; their running sums (one p x p matrix per piece)
    give the statistics of everything before a piece. A second pass takes each
    piece with its prefix, carries a running Gram through its rows, solves at
    every block's start and scores the block there. The static model is solved
    once. Blocks start at row 1, the tail is dropped, and a window size with
    fewer than ``min_blocks`` blocks has none.
    Returns (window_size, block, static_r2, online_r2).
    """
    from functools import reduce
    from math import gcd, lcm

    from pyspark.sql import Window

    from .ordering import global_row_number

    q, g, span = p + 1, reduce(gcd, window_sizes), lcm(*window_sizes)
    span *= max(1, piece_rows // span)
    num = global_row_number(test.select(*order, x, y), order, "_rn", total="_n") \
        .select("_rn", "_n", x, y, F.floor((F.col("_rn") - 1) / span).cast("int").alias("_piece"))
    base = block_grams(train.select(F.lit(0).alias("_b"), x, y), "_b", x, y, p).get(0)
    schema = "window_size int, block int, static_r2 double, online_r2 double"
    if base is None:
        return num.sparkSession.createDataFrame([], schema)
    g0, xy0 = base["G"], base["xy"]
    w_static = solve_ridge(g0, xy0, alpha)
    long = block_gram_frame(num.select("_piece", x, y), "_piece", x, y) \
        .select("_piece", F.posexplode(F.concat("gram", "xy")).alias("e", "v"))
    before = Window.partitionBy("e").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    prefix = long.withColumn("c", F.coalesce(F.sum("v").over(before), F.lit(0.0))).groupBy("_piece") \
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("e", "c"))), lambda t: t["c"]).alias("_before"))

    def run(key, rows: pd.DataFrame, pre: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(pre):
            rows = rows.sort_values("_rn", ignore_index=True)
            n, first = int(rows["_n"].iloc[0]), int(rows["_rn"].iloc[0]) - 1
            xs = np.hstack([np.vstack(rows[x].to_numpy()), np.ones((len(rows), 1))])
            ys = rows[y].to_numpy(dtype=np.float64)
            flat = np.asarray(pre["_before"].iloc[0], dtype=np.float64)
            gram, xy = g0 + flat[:q * q].reshape(q, q), xy0 + flat[q * q:]
            for a in range(0, len(rows), g):
                w_online = None
                for ws in window_sizes:
                    block = (first + a) // ws + 1
                    if (first + a) % ws or n // ws < min_blocks or block > n // ws:
                        continue
                    if w_online is None:
                        w_online = w_static if first + a == 0 else solve_ridge(gram, xy, alpha)
                    xb, yb = xs[a:a + ws], ys[a:a + ws]
                    sst = ((yb - yb.mean()) ** 2).sum()
                    r2 = [float(1 - ((yb - xb @ w) ** 2).sum() / sst) if sst > 0 else None for w in (w_static, w_online)]
                    out.append((ws, block, *r2))
                gram = gram + xs[a:a + g].T @ xs[a:a + g]
                xy = xy + xs[a:a + g].T @ ys[a:a + g]
        return pd.DataFrame(out, columns=["window_size", "block", "static_r2", "online_r2"])

    return num.groupBy("_piece").cogroup(prefix.groupBy("_piece")).applyInPandas(run, schema)


def ridge_path(stats_by_fold: dict[int, dict], alphas: list[float]) -> list[tuple]:
    """ML-13: train and validation R2 for every (alpha, fold) from per-fold Grams only."""
    folds = sorted(stats_by_fold)
    total_G = sum(stats_by_fold[f]["G"] for f in folds)
    total_xy = sum(stats_by_fold[f]["xy"] for f in folds)
    total_yy = sum(stats_by_fold[f]["yy"] for f in folds)
    total_n = sum(stats_by_fold[f]["n"] for f in folds)
    out = []
    for a in alphas:
        for f in folds:
            v = stats_by_fold[f]
            tr = dict(G=total_G - v["G"], xy=total_xy - v["xy"], yy=total_yy - v["yy"], n=total_n - v["n"])
            w = solve_ridge(tr["G"], tr["xy"], a)
            out.append((float(a), int(f), r2_from_stats(tr, w), r2_from_stats(v, w)))
    return out


# The pandas functions above run in Python workers, which may not have this
# package installed (cluster nodes, or a driver started outside the repo):
# ship them by value instead of by module reference.
def _ship_by_value() -> None:
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
