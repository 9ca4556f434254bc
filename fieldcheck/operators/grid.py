"""Operators on cells: components, regridding, offsets, local maxima."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .windows import neighbours


def components(cells: DataFrame, by: list[str], row: str, col: str) -> DataFrame:
    """``by, row, col, label``: connected components under 4-neighbourhood, labelled by their least cell.

    Cells are first contracted to maximal horizontal runs; runs that touch are edges, far fewer than cells. Alternating star steps (each node links its greater
    neighbours to the least node near it, then its smaller ones) leave stars in a number of rounds that grows with the logarithm of the number of runs, so there is no cap on rounds.
    Every round is written to the shared folder; only a count returns to the driver. A node of very many neighbours is only ever reduced to its least one by partial aggregates.
    """
    x = cells.select(*by, row, col).distinct()
    across = F.col(col) - F.row_number().over(Window.partitionBy(*by, row).orderBy(col))
    x = x.withColumn("_a", across)
    runs = x.groupBy(*by, row, "_a").agg(F.min(col).alias("_c0"), F.max(col).alias("_c1"))
    node = F.struct(F.col(row).cast("long").alias("r"), F.col("_c0").cast("long").alias("c"))
    runs = written(runs.select(*by, row, "_a", "_c0", "_c1", F.struct(*by, node.alias("_n")).alias("node")))
    # Runs of neighbouring rows touch if they share a column: of a run's columns each is the cell of one run below at most.
    at = written(x.join(runs.select(*by, row, "_a", "node"), [*by, row, "_a"]).select(*by, row, col, "node"))
    below = at.select(*by, (F.col(row) - 1).alias(row), col, F.col("node").alias("other"))
    edges = written(at.join(below, [*by, row, col]).select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).where("u <> v").distinct())
    total = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small)
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == total:
            break
        total = now
    label = F.coalesce(F.col("v")["_n"], F.col("node")["_n"])
    return at.join(edges, F.col("node") == F.col("u"), "left").select(*by, row, col, label.alias("label"))


def axis_weights(spark, source_edges: list[float], target_edges: list[float], sine: bool, period: float | None = None) -> DataFrame:
    """``src, dst, w``: overlaps of two axes of declared edges (sine of latitude, or longitude with wraps), one row per overlapping pair."""
    f = (lambda v: float(np.sin(np.radians(v)))) if sine else float
    rows = []
    for i, (a, b) in enumerate(zip(source_edges, source_edges[1:], strict=False)):
        for j, (c, d) in enumerate(zip(target_edges, target_edges[1:], strict=False)):
            for shift in (0.0,) if period is None else (-period, 0.0, period):
                lo, hi = max(f(a + shift), f(c)), min(f(b + shift), f(d))
                if hi > lo:
                    rows.append((i, j, hi - lo))
    return spark.createDataFrame(rows, "src long, dst long, w double")


def regridded(cells: DataFrame, by: list[str], row: str, col: str, value: str, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """``by, row, col, mean, area``: conservative means on the target grid, renormalised over present cells. The axes' weights, a few rows per axis cell, are joined one after the other; all times share them."""
    r, c = rows.select(F.col("src").alias(row), F.col("dst").alias("_r"), F.col("w").alias("_wr")), cols.select(F.col("src").alias(col), F.col("dst").alias("_c"), F.col("w").alias("_wc"))
    j = cells.where(F.col(value).isNotNull()).join(r, row).join(c, col).withColumn("_w", F.col("_wr") * F.col("_wc"))
    g = j.groupBy(*by, F.col("_r").alias("to_row"), F.col("_c").alias("to_col"))
    return g.agg((F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias("mean"), F.sum("_w").alias("area"))


def local_maxima(cells: DataFrame, by: list[str], row: str, col: str, value: str, reach_r: int, reach_c: int, columns: int, apart: int, top: int) -> DataFrame:
    """``by, row, col, value, place``: cells greatest in their window, thinned greedily so that kept ones lie ``apart`` cells apart, the ``top`` first.

    The window maximum is a neighbour aggregate; only local maxima, few per grid, reach the greedy step of their group.
    """
    n = neighbours(cells.where(F.col(value).isNotNull()), row, col, reach_r, reach_c, columns)
    best = n.groupBy(*by, F.col("to_row").alias(row), F.col("to_col").alias(col)).agg(F.max(value).alias("_best"))
    m = cells.join(best, [*by, row, col]).where(F.col(value) >= F.col("_best")).select(*by, row, col, value)

    def thin(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([value, row, col], ascending=[False, True, True])
        kept: list[int] = []
        r, c = g[row].to_numpy(), g[col].to_numpy()
        for i in range(len(g)):
            if all(max(abs(r[i] - r[k]), min(abs(c[i] - c[k]), columns - abs(c[i] - c[k]))) >= apart for k in kept):
                kept.append(i)
                if len(kept) == top:
                    break
        out = g.iloc[kept].copy()
        out["place"] = range(1, len(kept) + 1)
        return out

    kinds = dict(m.dtypes)
    return m.groupBy(*by).applyInPandas(thin, ", ".join(f"{c} {kinds[c]}" for c in m.columns) + ", place int")


def patch_offset(a: np.ndarray, b: np.ndarray, reach: int) -> tuple[float, float, float]:
    """Rows and columns by which ``b`` is shifted against ``a`` (sub-cell by a parabola), and the normalised correlation there."""
    a, b = a - a.mean(), b - b.mean()
    scale = np.sqrt((a * a).sum() * (b * b).sum())
    if scale == 0:
        return 0.0, 0.0, 0.0
    f = np.fft.ifft2(np.conj(np.fft.fft2(a)) * np.fft.fft2(b)).real / scale
    c = np.array([[f[i % f.shape[0], j % f.shape[1]] for j in range(-reach, reach + 1)] for i in range(-reach, reach + 1)])
    i, j = np.unravel_index(int(np.argmax(c)), c.shape)

    def peak(v: np.ndarray, k: int) -> float:
        if 0 < k < len(v) - 1:
            d = v[k - 1] - 2 * v[k] + v[k + 1]
            return k + (0.5 * (v[k - 1] - v[k + 1]) / d if d else 0.0)
        return float(k)

    return peak(c[:, j], i) - reach, peak(c[i], j) - reach, float(c[i, j])


def offset_field(cells: DataFrame, by: list[str], row: str, col: str, before: str, after: str, size: int, reach: int = 3) -> DataFrame:
    """``by, patch_row, patch_col, d_row, d_col, corr``: the offset of each patch of ``size`` cells; a patch is one bounded group. Absent cells count as the patch mean; patches less than half full are left out."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        a, b = np.full((size, size), np.nan), np.full((size, size), np.nan)
        r, c = (g[row] % size).to_numpy(), (g[col] % size).to_numpy()
        a[r, c], b[r, c] = g[before], g[after]
        head = g.iloc[0]
        keys = [head[k] for k in by] + [int(head["patch_row"]), int(head["patch_col"])]
        ok = ~(np.isnan(a) | np.isnan(b))
        cols = [*by, "patch_row", "patch_col", "d_row", "d_col", "corr"]
        if 2 * ok.sum() < size * size:
            return pd.DataFrame(columns=cols)
        d = patch_offset(np.where(ok, a, a[ok].mean()), np.where(ok, b, b[ok].mean()), reach)
        return pd.DataFrame([[*keys, *d]], columns=cols)

    x = cells.withColumn("patch_row", F.floor(F.col(row) / size)).withColumn("patch_col", F.floor(F.col(col) / size))
    kinds = dict(x.dtypes)
    return x.groupBy(*by, "patch_row", "patch_col").applyInPandas(one, "".join(f"{k} {kinds[k]}, " for k in by) + "patch_row long, patch_col long, d_row double, d_col double, corr double")
