"""Quantities recorded in different units, resolved by segmenting the history of each source.

The readings that state no unit form a history of daily mean log values per source and code. An exact penalised
changepoint search cuts it into segments of one level. The segment that lies nearest to where the source's stated readings would be
takes the unit they state; from there each level shift that matches the factor between two known units marks a change of unit, to be reversed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.units import UNITS, scale_of
from ..session import written

SCALES = {(q, u): (f, o) for q, u, f, o, _ in UNITS}


def segments(x: np.ndarray, w: np.ndarray, penalty: float) -> list[int]:
    """Starts of the segments of the exact minimum of weighted squared error plus ``penalty`` per segment (pruned, PELT)."""
    n = len(x)
    cw, cx, cxx = (np.concatenate([[0.0], np.cumsum(v)]) for v in (w, w * x, w * x * x))
    best, last, live = np.zeros(n + 1), np.zeros(n + 1, int), np.array([0])
    best[0] = -penalty
    for j in range(1, n + 1):
        m = cw[j] - cw[live]
        cost = best[live] + cxx[j] - cxx[live] - (cx[j] - cx[live]) ** 2 / np.maximum(m, 1e-300)
        k = int(np.argmin(cost))
        best[j], last[j] = cost[k] + penalty, live[k]
        live = np.append(live[cost <= best[j]], j)
    starts, j = [], n
    while j > 0:
        j = int(last[j])
        starts.append(j)
    return starts[::-1]


def _level(quantity: str, unit: str, base: float) -> float:
    """The log value that a base-unit value has in a unit (of its absolute value, at least 1e-9)."""
    f, o = SCALES[(quantity, unit)]
    return math.log(max(abs((base - o) / f), 1e-9))


def noise(x: np.ndarray) -> float:
    """The standard deviation of single values about a slowly moving level, from the median step, which a few shifts don't move; infinite for fewer than eight values, which show no shift."""
    return float(np.median(np.abs(np.diff(x))) / 0.954) if len(x) >= 8 else float("inf")


def units_along(levels: list[float], start: int, unit: str, level_of: dict[str, float], sd: float, least: float = 0.05) -> list[str]:
    """The unit of each segment: ``unit`` at ``start``, another one beyond each shift that matches the step between two units of ``level_of``.

    A shift is a change of unit if it is five times the ``sd`` of single days, and a known step explains all of it but a quarter (and ``least`` or half an ``sd``).
    Other shifts are changes of the quantity itself.
    """
    out = [unit] * len(levels)
    for step, path in ((1, range(start, len(levels) - 1)), (-1, range(start, 0, -1))):
        for j in path:
            s, u = levels[j + step] - levels[j], out[j]
            v = min(level_of, key=lambda k: (abs(s - level_of[k] + level_of[u]), k != u, k))
            left = abs(s - level_of[v] + level_of[u])
            out[j + step] = v if v != u and abs(s) > 5 * sd and left <= max(least, sd / 2) and left < abs(s) / 4 else u
    return out


def unit_history(df: DataFrame, source: str, code: str, quantity: str, day: str, value: str, unit: str, penalty: float = 25.0, default: dict[str, str] | None = None) -> DataFrame:
    """``source, code, day, resolved, segment, level, shift``: the unit of the readings without stated unit, day by day.

    Per source, code and day one row of sums is made before anything is gathered, so a group holds at most one row per day and unit,
    however many readings a source has. The history of daily mean log values is cut into segments; a new one costs ``penalty`` times the variance of single days.
    The segment nearest to the level of the source's stated readings (of all sources', if it states none) takes the unit they state; a
    source that states none for a quantity named in ``default`` takes that unit, otherwise the known unit of the quantity that lies nearest.
    ``units_along`` then follows the shifts to all other segments, among all known units of the quantity. ``shift`` is the level's step from the segment before. Days on which all values are zero or missing
    follow the segment before them, or the next one. Null sources count as one source.
    """
    v = F.col(value).cast("double")
    f, o = scale_of(F.col(quantity), F.col(unit))
    base = v * f + o
    logs = F.when(v != 0, F.ln(F.abs(v)))
    daily = df.groupBy(F.col(source).alias("source"), F.col(code).alias("code"), F.col(quantity).alias("quantity"), F.col(day).alias("day"), F.col(unit).alias("unit")).agg(
        F.count(logs).alias("n"), F.avg(logs).alias("m"), F.avg(base).alias("base"), F.count(base).alias("n_base")
    )

    daily = written(daily)  # one row per source, code, day and unit, read twice below
    known = daily.where("unit is not null and n_base > 0").groupBy("code").agg((F.sum(F.col("base") * F.col("n_base")) / F.sum("n_base")).alias("base_all"))
    daily = daily.join(known, "code", "left")

    def one(g: pd.DataFrame) -> pd.DataFrame:
        q, g = g["quantity"].iloc[0], g.sort_values("day")
        stated, bare = g[g["unit"].notna()], g[g["unit"].isna()]
        cols = ["source", "code", "day", "resolved", "segment", "level", "shift"]
        if bare.empty:
            return pd.DataFrame(columns=cols)
        units = sorted(stated["unit"].unique()) or ([(default or {})[q]] if q in (default or {}) else [u for (p, u) in SCALES if p == q])
        weight = stated["n_base"].to_numpy(float)
        base = float(np.average(stated["base"].fillna(0), weights=weight)) if weight.sum() > 0 else g["base_all"].iloc[0]
        base = None if base is None or math.isnan(base) else base
        seen = bare[bare["n"] > 0]
        x = seen["m"].to_numpy(float)
        sd = noise(x)
        starts = segments(x, np.ones(len(x)), penalty * max(sd, 1e-3) ** 2 if math.isfinite(sd) else 1e12) if len(x) else []
        number = np.zeros(len(bare), int)
        levels = []
        for i, s in enumerate(starts):
            part = seen.iloc[s : starts[i + 1] if i + 1 < len(starts) else None]
            levels.append(float(np.average(part["m"], weights=part["n"])))
            if i:
                number[(bare["day"] >= part["day"].iloc[0]).to_numpy()] = i
        picks = [units[0]] * max(1, len(levels))
        if levels and base is not None:
            level_of = {u: _level(q, u, base) for (p, u) in SCALES if p == q}
            _, start, first = min((abs(level_of[u] - v), i, u) for i, v in enumerate(levels) for u in units)
            picks = units_along(levels, start, first, level_of, sd)
        levels = levels or [float("nan")]
        shift = [0.0, *np.diff(levels)]
        out = bare[["source", "code", "day"]].copy()
        out["resolved"], out["segment"] = [picks[i] for i in number], number
        out["level"], out["shift"] = [levels[i] for i in number], [shift[i] for i in number]
        return out[cols]

    return daily.groupBy("source", "code", "quantity").applyInPandas(one, "source string, code string, day long, resolved string, segment int, level double, shift double")


def with_units(df: DataFrame, history: DataFrame, source: str, code: str, day: str, unit: str) -> DataFrame:
    """``df`` with ``recorded_unit``: the stated unit, or what the history resolved for the row's source, code and day.

    The history has one row per source, code and day, so a source with a third of all rows is spread over its days.
    """
    h = history.select(F.col("source").alias("_fc_s"), F.col("code").alias("_fc_c"), F.col("day").alias("_fc_d"), F.col("resolved").alias("_fc_u"))
    on = F.col(source).eqNullSafe(F.col("_fc_s")) & (F.col(code) == F.col("_fc_c")) & (F.col(day) == F.col("_fc_d")) & F.col(unit).isNull()
    return df.join(h, on, "left").withColumn("recorded_unit", F.coalesce(unit, "_fc_u")).drop("_fc_s", "_fc_c", "_fc_d", "_fc_u")
