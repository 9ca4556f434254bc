"""Projection, regression and resampling. Data become small sums (Gram matrices) in partial aggregates; only these are solved."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def harmonic_labels(degree: int) -> list[tuple[int, int, str]]:
    """(l, m, phase) of each real harmonic, in order."""
    return [(n, m, p) for n in range(degree + 1) for m in range(n + 1) for p in (("cos",) if m == 0 else ("cos", "sin"))]


def harmonics(lat: np.ndarray, lon: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, eastward and northward derivatives of the real spherical harmonics with mean square one, at positions in degrees.

    Fully normalised Legendre functions by the stable column recurrence. Derivatives need positions off the poles.
    """
    colat, lam = np.radians(90.0 - lat), np.radians(lon)
    c, s = np.cos(colat), np.sin(colat)
    p = np.zeros((degree + 2, degree + 2, len(lat)))
    p[0, 0] = 1.0
    for m in range(1, degree + 1):
        p[m, m] = s * np.sqrt((2 * m + 1) / (2 * m) * (2.0 if m == 1 else 1.0)) * p[m - 1, m - 1]
    for m in range(degree + 1):
        for n in range(m + 1, degree + 1):
            a = np.sqrt((2 * n + 1) * (2 * n - 1) / ((n - m) * (n + m)))
            b = np.sqrt((2 * n + 1) * (n + m - 1) * (n - m - 1) / ((n - m) * (n + m) * (2 * n - 3))) if n > m + 1 else 0.0
            p[n, m] = a * c * p[n - 1, m] - b * p[n - 2, m]
    safe = np.where(s < 1e-10, np.nan, s)
    value, east, north = [], [], []
    for n, m, phase in harmonic_labels(degree):
        f = np.sqrt((n * n - m * m) * (2 * n + 1) / (2 * n - 1)) if n else 0.0
        slope = (n * c * p[n, m] - (f * p[n - 1, m] if n else 0.0)) / safe
        wave, dwave = (np.cos(m * lam), -m * np.sin(m * lam)) if phase == "cos" else (np.sin(m * lam), m * np.cos(m * lam))
        value.append(p[n, m] * wave)
        east.append(p[n, m] * dwave / safe)
        north.append(-slope * wave)
    return np.stack(value, 1), np.stack(east, 1), np.stack(north, 1)


def cross_sums(df: DataFrame, by: list[str], features: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """``by, i, j, total``: the sums over rows of w * a_i * b_j, for ``features(batch) -> (a, b, w)``.

    Without groups, features may have several rows per row of the batch (the components of a vector). Each batch yields one matrix per group, so the shuffle carries matrices, not rows; rows with NaN features are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            a, b, w = features(batch)
            ok = np.isfinite(a).all(1) & np.isfinite(b).all(1) & np.isfinite(w)
            groups = [((), np.arange(len(a)))] if not by else [(k if isinstance(k, tuple) else (k,), v) for k, v in batch.groupby(by, sort=False).indices.items()]
            out = []
            for key, rows in groups:
                rows = rows[ok[rows]]
                m = (a[rows] * w[rows, None]).T @ b[rows]
                i, j = np.indices(m.shape)
                out.append(pd.DataFrame({**dict(zip(by, ([k] * m.size for k in key), strict=True)), "i": i.ravel(), "j": j.ravel(), "total": m.ravel()}))
            yield pd.concat(out)

    kinds = dict(df.dtypes)
    parts = df.mapInPandas(run, "".join(f"{k} {kinds[k]}, " for k in by) + "i int, j int, total double")
    return parts.groupBy(*by, "i", "j").agg(F.sum("total").alias("total"))


def matrix(g: pd.DataFrame) -> np.ndarray:
    """The matrix of rows (i, j, total)."""
    m = np.zeros((g["i"].max() + 1, g["j"].max() + 1))
    m[g["i"], g["j"]] = g["total"]
    return m


def least_squares(sums: DataFrame, by: list[str], n: int, penalty: float = 0.0) -> DataFrame:
    """``by, k, coef, rank, cond``: solutions of the normal equations in sums of [X y]' W [X y] (y the last column) of ``n`` unknowns.

    The group is one small matrix. The rank is told, and where it falls short or the condition exceeds 1e8 without a penalty, coefficients are null.
    """

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        m = matrix(g)
        a, r = m[:n, :n], m[:n, n]
        if penalty:
            a = a + penalty * np.eye(n) * np.trace(a) / n
        rank, cond = int(np.linalg.matrix_rank(a)), float(np.linalg.cond(a))
        x = np.linalg.solve(a, r) if rank == n and cond <= 1e8 else np.full(n, np.nan)
        head = {k: [g[k].iloc[0]] * n for k in by}
        return pd.DataFrame({**head, "k": range(n), "coef": x, "rank": rank, "cond": cond})

    kinds = dict(sums.dtypes)
    out = sums.groupBy(*by).applyInPandas(solve, "".join(f"{k} {kinds[k]}, " for k in by) + "k int, coef double, rank int, cond double")
    return out.withColumn("coef", F.when(~F.isnan("coef"), F.col("coef")))


def eof(gram: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvectors of a Gram matrix, signed so that the largest loading is positive, and their shares of variance."""
    w, v = np.linalg.eigh(gram)
    o = np.argsort(w)[::-1][:rank]
    v = v[:, o]
    v = v * np.sign(v[np.abs(v).argmax(0), range(v.shape[1])])
    return v, w[o] / w.sum()


def ridge_ladder(train: dict[int, tuple[np.ndarray, np.ndarray, int]], valid: dict[int, tuple[np.ndarray, np.ndarray, float, int]], gram: np.ndarray, ranks: list[int], penalties: list[float]) -> list[dict]:
    """Rows ``rank, penalty, loss`` of multi-lead ridge maps in EOF space, from sums only: per lead (X'X, X'Y, n) of training pairs, (X'X, X'Y, trace Y'Y, n) of validation pairs."""
    rows = []
    for rank in ranks:
        v, _ = eof(gram, rank)
        for penalty in penalties:
            losses = []
            for lead, (a, b, n) in train.items():
                w = np.linalg.solve(v.T @ a @ v / n + penalty * np.eye(rank), v.T @ b / n)
                xx, xy, yy, k = valid[lead]
                m = v @ w
                losses.append((np.trace(m.T @ xx @ m) - 2 * np.trace(m.T @ xy) + yy) / k)
            rows.append({"rank": rank, "penalty": penalty, "loss": float(np.mean(losses))})
    return rows


def spectrum(df: DataFrame, key: str, at: str, value: str, taper: bool = True) -> DataFrame:
    """``key, k, frequency, power``: the spectrum of each evenly sampled series, at most one value per slot of the calendar.

    Gaps aren't filled: an uneven or short series, or one with missing values, gives no rows.
    """

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(at)
        x, t = g[value].to_numpy(float), g[at].to_numpy(float)
        cols = [key, "k", "frequency", "power"]
        if len(x) < 4 or not np.isfinite(x).all() or len(set(np.diff(t))) != 1:
            return pd.DataFrame(columns=cols)
        w = np.hanning(len(x)) if taper else np.ones(len(x))
        f = np.abs(np.fft.rfft((x - x.mean()) * w)) ** 2 / (w**2).sum()
        return pd.DataFrame({key: g[key].iloc[0], "k": range(len(f)), "frequency": np.fft.rfftfreq(len(x), t[1] - t[0]), "power": f})[cols]

    return df.groupBy(key).applyInPandas(one, f"{key} {dict(df.dtypes)[key]}, k int, frequency double, power double")


def surrogate_correlations(spark, series: np.ndarray, draws: int, seed: int, block: int = 24) -> DataFrame:
    """``draw, pair, null_r, boot_r``: correlations of phase-randomised surrogates and of block-bootstrap samples of a few short series, drawn in parallel over Spark tasks.

    ``series`` is time by series, one row per month; draw ``d`` has the seed (seed, d), so results don't depend on the partitioning.
    """
    pairs = [(i, j) for i in range(series.shape[1]) for j in range(i + 1, series.shape[1])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = series - series.mean(0)
        f, n = np.fft.rfft(a, axis=0), len(a)
        for b in batches:
            rows = []
            for d in b["id"]:
                rng = np.random.default_rng((seed, int(d)))
                s = f * np.exp(1j * rng.uniform(0, 2 * np.pi, f.shape))
                s[0] = 0
                if n % 2 == 0:
                    s[-1] = f[-1] * rng.choice([-1, 1], f.shape[1])
                x = np.corrcoef(np.fft.irfft(s, n=n, axis=0).T)
                starts = rng.integers(0, n, -(-n // block))
                y = np.corrcoef(a[((starts[:, None] + np.arange(block)) % n).ravel()[:n]].T)
                rows += [(d, k, x[i, j], y[i, j]) for k, (i, j) in enumerate(pairs)]
            yield pd.DataFrame(rows, columns=["draw", "pair", "null_r", "boot_r"])

    return spark.range(draws).mapInPandas(run, "draw long, pair int, null_r double, boot_r double")
