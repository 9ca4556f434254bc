"""Implausible spikes, stuck values and impossible readings, relative to each source's normal behaviour.

Residuals from the local middle follow season and time of day, so what is left is the source's own scatter. In series a fixed
multiple of it is the limit. For levels, peaks over a threshold of it are described per source by a generalised Pareto distribution;
the size that it passes at a fixed risk is the source's cutoff, against which levels are held in their surroundings.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .stats import exact_percentiles


def ranked_blocks(df: DataFrame, key: str, time: str, value: str, day_len: int, block: int = 4000, halo: int = 47) -> DataFrame:
    """The distinct (key, time, value) rows as ``key, time, value, rank, block, core``, cut into overlapping blocks.

    The rank in a key's series is the number of rows of earlier days, from daily counts, plus the rank within the day.
    Blocks of ``block`` ranks hold ``halo`` rows of their neighbours on either side (``core`` false), so
    windows of that reach see what they would see in the whole series, and no task holds a whole long series.
    Nulls in any of the three are left out.
    """
    day = F.floor(F.col("time") / day_len).cast("long")
    s = df.select(F.col(key).alias("key"), F.col(time).alias("time"), F.col(value).alias("value")).dropna().withColumn("day", day)
    s = s.repartition("key", "day").groupBy("key", "day", "time", "value").agg(F.lit(1).alias("_"))
    per_day = s.groupBy("key", "day").agg(F.count("*").alias("n"))
    before = per_day.select("key", "day", (F.sum("n").over(Window.partitionBy("key").orderBy("day")) - F.col("n")).alias("before"))
    r = s.withColumn("rn", F.row_number().over(Window.partitionBy("key", "day").orderBy("time", "value"))).join(before, ["key", "day"])
    rank = (F.col("before") + F.col("rn") - 1).cast("long")
    own = F.floor(F.col("rank") / block).cast("long")
    return r.select("key", "time", "value", rank.alias("rank")).withColumn(
        "block", F.explode(F.array_distinct(F.array(own, F.floor((F.col("rank") - halo) / block).cast("long"), F.floor((F.col("rank") + halo) / block).cast("long"))))
    ).withColumn("core", own == F.col("block"))


def local_residuals(blocks: DataFrame, reach: int = 3) -> DataFrame:
    """The core rows with ``residual`` from the median of the row and ``reach`` rows on either side (null where fewer are there, at the ends of a series), and ``run``, the number of successive equal values it is part of, as far as the halo shows."""
    w = Window.partitionBy("key", "block").orderBy("rank")
    near = F.sort_array(F.array_compact(F.array(*[F.lag("value", i).over(w) for i in range(reach, 0, -1)], F.col("value"), *[F.lead("value", i).over(w) for i in range(1, reach + 1)])))
    x = blocks.withColumn("_near", near).withColumn("_new", F.coalesce(F.lag("value").over(w) != F.col("value"), F.lit(True)).cast("int")).withColumn("first", F.coalesce(F.lag("time").over(w) != F.col("time"), F.lit(True)))
    x = x.withColumn("_run", F.sum("_new").over(w)).withColumn("run", F.count("*").over(Window.partitionBy("key", "block", "_run")))
    n = F.size("_near")
    middle = F.get("_near", F.lit(reach))
    return x.where("core").select("key", "time", "value", "first", "run", F.when(n == 2 * reach + 1, F.round(F.col("value") - middle, 4)).alias("residual"))


def tail_cutoffs(histogram: DataFrame, keys: list[str], size: str, count: str, risk: float, peaks: float = 0.1, trim: float | None = 6.0, least: int = 10, near: str | None = None) -> DataFrame:
    """``keys, usual, threshold, peaks, shape, scale, cutoff``: per source the size that a normal residual passes with probability ``risk``.

    ``histogram`` has residual sizes with their counts; they are rounded to three digits, so a source has some thousand different ones at most. ``usual`` is 1.4826 times the median size. Only sizes up to ``trim`` times ``usual`` (and residuals whose
    surroundings ``near`` are as calm) are fitted, so that the outliers sought don't stretch the tail. The threshold is the ``1 - peaks`` quantile of these; a generalised Pareto
    distribution is fitted to the excesses by moments (Hosking and Wallis 1987), its shape at least 0: a bounded tail would call any new extreme impossible.
    Sources with fewer than ``least`` peaks take the mean excess of all sources, in units of ``usual``. Sources without residual have no row.
    """
    x = F.col(size)
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.when(x > 1e-9, x))) - 2)
    x = F.when(x > 1e-9, F.round(x / unit) * unit).otherwise(F.when(x.isNotNull(), 0.0))
    h = histogram.select(*keys, x.alias("_size"), F.col(count).alias("_n"), (F.col(near) if near else F.lit(0.0)).alias("_near")).where("_size is not null")
    h = written(h.groupBy(*keys, "_size", "_near").agg(F.sum("_n").alias("_n")))  # read for the median, the threshold and the excesses
    mad = h.groupBy(*keys).agg((1.4826 * F.percentile("_size", F.lit(0.5), F.col("_n"))).alias("usual"))
    h = h.join(mad, keys)
    if trim is not None:
        h = h.where((F.col("_size") <= trim * F.col("usual")) & (F.col("_near") <= trim * F.col("usual")))
    e, c = F.col("_size") - F.col("threshold"), F.col("_n")
    of = lambda v, name: F.sum(F.when(e > 0, v)).alias(name)
    at = h.groupBy(*keys).agg(F.percentile("_size", F.lit(1 - peaks), F.col("_n")).alias("threshold"))
    fit = h.join(at, keys).groupBy(*keys).agg(
        F.first("usual").alias("usual"), F.first("threshold").alias("threshold"), F.sum(c).alias("_all"), of(c, "_k"), of(c * e, "_s1"), of(c * e * e, "_s2"), of(F.try_divide(c * e, F.col("usual")), "_s0")
    )
    k = F.coalesce("_k", F.lit(0))
    pooled = fit.agg(F.try_divide(F.sum("_s0"), F.sum("_k")).alias("_pooled"))
    fit = fit.withColumn("peaks", k).crossJoin(F.broadcast(pooled))  # one row
    mean = F.when(F.col("peaks") >= least, F.col("_s1") / F.col("_k")).otherwise(F.col("_pooled") * F.col("usual"))
    var = F.when(F.col("peaks") >= least, F.col("_s2") / F.col("_k") - mean * mean)
    ratio = F.coalesce(F.least(F.try_divide(mean * mean, F.when(var > 1e-12, var)), F.lit(1.0)), F.lit(1.0))
    fit = fit.withColumn("shape", (1 - ratio) / 2).withColumn("scale", mean * (ratio + 1) / 2)
    share = F.greatest(F.col("peaks") / F.col("_all"), F.lit(risk))
    bent = F.when(F.col("shape") > 1e-6, F.col("shape"))
    beyond = F.coalesce(F.col("scale") / bent * (F.pow(share / risk, bent) - 1), F.col("scale") * F.ln(share / risk))
    return fit.select(*keys, "usual", "threshold", "peaks", "shape", "scale", (F.col("threshold") + F.coalesce(beyond, F.lit(0.0))).alias("cutoff"))


def series_residuals(df: DataFrame, key: str, time: str, value: str, day_len: int, reach: int = 47) -> DataFrame:
    """The residuals and runs of all series, written once."""
    return written(local_residuals(ranked_blocks(df, key, time, value, day_len, halo=reach)))


def residual_sizes(residuals: DataFrame) -> DataFrame:
    """``key, size, n, whole, times``: how often each size of residual occurs, how many of these values are whole numbers, and how many times are distinct."""
    return residuals.groupBy("key", F.abs("residual").alias("size")).agg(F.count("*").alias("n"), F.sum((F.col("value") == F.round("value")).cast("long")).alias("whole"), F.sum(F.col("first").cast("long")).alias("times"))


def spikes_in_series(df: DataFrame, key: str, time: str, value: str, day_len: int, low: float, high: float, factor: float = 8.0, least: tuple[float, float] = (0.3, 0.74), stuck: tuple[int, int] = (12, 48), whole_share: float = 0.9, min_times: int = 40) -> DataFrame:
    """Distinct ``key, time, value`` of readings that are impossible, stuck or spikes, for keys with ``min_times`` distinct times.

    A reading is a spike if it departs from the local median of seven by more than ``factor`` times the key's usual departure, 1.4826 times
    its median absolute departure but at least ``least``; the second values of ``least`` and ``stuck`` hold for keys of which the share
    ``whole_share`` of readings are whole numbers. A run of ``stuck`` successive equal values is stuck throughout.
    Readings without three others on either side are no spikes, but may be impossible or stuck.
    Repeated rows count once. Null keys, times and values are left out; an empty table gives no rows.
    """
    r = series_residuals(df, key, time, value, day_len, max(stuck) - 1)
    hist = written(residual_sizes(r))
    known = exact_percentiles(hist, ["key"], {"mad": ("size", 0.5)}, weight="n")
    stats = hist.groupBy("key").agg((F.sum("whole") / F.sum("n") >= whole_share).alias("whole"), F.sum("times").alias("times")).where(F.col("times") >= min_times).join(known, "key", "left")
    usual = F.greatest(F.coalesce(F.lit(1.4826) * F.col("mad"), F.lit(0.0)), F.when(F.col("whole"), least[1]).otherwise(least[0]))
    stats = stats.select("key", (factor * usual).alias("limit"), F.when(F.col("whole"), stuck[1]).otherwise(stuck[0]).alias("stuck"))
    off = (F.col("value") < low) | (F.col("value") > high)
    some = r.where(off | (F.col("run") >= min(stuck)) | (F.abs("residual") > factor * min(least)))
    return some.join(stats, "key").where(off | (F.col("run") >= F.col("stuck")) | (F.abs("residual") > F.col("limit"))).select("key", "time", "value").distinct()


# --- profiles


def line_departures(x: np.ndarray, y: np.ndarray, before: int = 1, after: int = 1) -> np.ndarray:
    """Departure of each point from the line between the ``before``-th point before it and the ``after``-th after it; NaN without both."""
    d = np.full(len(x), np.nan)
    if len(x) > before + after:
        a, b, i = slice(0, len(x) - before - after), slice(before + after, len(x)), slice(before, len(x) - after)
        span = x[b] - x[a]
        with np.errstate(divide="ignore", invalid="ignore"):
            d[i] = np.abs(y[i] - y[a] - (y[b] - y[a]) * (x[i] - x[a]) / np.where(span == 0, np.nan, span))
    return d


#: Lines that judge a level: those of the nearest pairs, and all by which a wrong neighbour can be passed over.
NEAREST = ((1, 1), (1, 2), (2, 1))
PAIRS = (*NEAREST, (2, 2), (1, 3), (3, 1))


def _over(how, x: np.ndarray, y: np.ndarray, pairs: tuple) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return np.nan_to_num(reduce(how, (line_departures(x, y, a, b) for a, b in pairs)))


def wrong_levels(x: np.ndarray, y: np.ndarray, honest: np.ndarray, limit: float) -> np.ndarray:
    """True for the points that leave the line between their nearest honest neighbours by more than ``limit``.

    The point that departs most from all lines of near pairs goes first, as one wrong point also moves the lines of its neighbours, until none
    departs from its nearest lines (the first alone, and, as two equally wrong neighbours hide each other from it, those over one neighbour where no level is missing between); in the end every
    point that went is held against its nearest honest neighbours again. ``honest`` is false for points that are already known to be wrong.
    """
    wrong = np.zeros(len(x), bool)
    alive = np.flatnonzero(honest)
    while len(alive) > 2:
        xs, ys = x[alive], y[alive]
        d = np.nan_to_num(line_departures(xs, ys))
        for a, b in NEAREST[1:]:
            apart = np.full(len(alive), True)
            apart[a : len(alive) - b] = alive[a + b :] - alive[: -a - b] != a + b
            d = np.fmax(d, np.where(apart, 0, np.nan_to_num(line_departures(xs, ys, a, b))))
        if d.max() <= limit:
            break
        least = _over(np.fmin, xs, ys, PAIRS)
        k = int(np.argmax(np.where(d > limit, least, -1.0))) if least.max() > limit else int(np.argmax(d))
        if k == 1 and len(alive) > 4 and _end_is_off(xs[:5], ys[:5], limit):
            k = 0
        elif k == len(alive) - 2 and len(alive) > 4 and _end_is_off(xs[-5:][::-1], ys[-5:][::-1], limit):
            k = len(alive) - 1
        wrong[alive[k]] = True
        alive = np.delete(alive, k)
    for i in np.flatnonzero(wrong):
        j = np.searchsorted(alive, i)
        if 0 < j < len(alive):
            a, b = alive[j - 1], alive[j]
            if x[a] != x[b] and abs(y[i] - y[a] - (y[b] - y[a]) * (x[i] - x[a]) / (x[b] - x[a])) <= limit:
                wrong[i] = False
    return wrong


def _end_is_off(x: np.ndarray, y: np.ndarray, limit: float) -> bool:
    """True if the second to fifth point agree without the first, but not with it."""
    d = np.nan_to_num(line_departures(x[1:], y[1:]))
    return bool(d.max() <= limit)


class Levels:
    """The levels of a batch of profiles end to end: ``row`` of the batch, ``no`` in the profile, ``x`` (ln p), ``t`` in kelvin, ``z``; missing values are NaN.

    Columns p, t, z, factor, offset; arrays of unequal length are padded.
    """

    def __init__(self, batch: pa.RecordBatch):
        flat, lens = {}, {}
        for c in "ptz":
            a = batch.column(batch.schema.get_field_index(c))
            lens[c] = np.nan_to_num(pc.list_value_length(a).to_numpy(zero_copy_only=False).astype(float)).astype(int)
            flat[c] = pc.list_flatten(a).to_numpy(zero_copy_only=False).astype(float)
        size = np.maximum.reduce(list(lens.values()))
        self.first = np.cumsum(size) - size
        self.row = np.repeat(np.arange(len(size)), size)
        self.no = np.arange(len(self.row)) - self.first[self.row]
        for c in "ptz":
            v, n = np.full(len(self.row), np.nan), lens[c]
            at = np.repeat(self.first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            v[at] = np.where(flat[c] == -32768, np.nan, flat[c])
            flat[c] = v
        f, o = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in ("factor", "offset"))
        with np.errstate(divide="ignore", invalid="ignore"):
            self.x = np.log(np.where(flat["p"] > 0, flat["p"], np.nan))
        self.t, self.z = flat["t"] * f[self.row] + o[self.row], flat["z"]


def departures(row: np.ndarray, x: np.ndarray, y: np.ndarray, a: int, b: int) -> np.ndarray:
    """``line_departures`` within each of many profiles that lie end to end."""
    d = line_departures(x, y, a, b)
    if len(row) > a + b:
        i = slice(a, len(row) - b)
        d[i] = np.where(row[: len(row) - a - b] == row[a + b :], d[i], np.nan)
    return d


def profile_residuals(df: DataFrame) -> DataFrame:
    """``source, field, size, near, n``: counts of the departures of levels from the lines that pass over one neighbour, and the most that the two levels on either side depart from all their near lines.

    Lines over a neighbour scatter as those over a level that was taken out. Sizes to three digits, surroundings in five steps a decade, so that the rows are few whatever the number of profiles.
    """

    def digits(v: np.ndarray) -> np.ndarray:
        unit = 10.0 ** (np.floor(np.log10(np.maximum(v, 1e-3))) - 2)
        return np.round(v / unit) * unit

    def steps(v: np.ndarray) -> np.ndarray:
        return 10.0 ** (np.ceil(np.log10(np.maximum(v, 1e-3)) * 5) / 5)

    kind = pa.schema([("source", pa.string()), ("field", pa.string()), ("size", pa.float64()), ("near", pa.float64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = Levels(batch)
            code = pc.dictionary_encode(batch.column(0))
            source = pc.fill_null(code.indices, -1).to_numpy(zero_copy_only=False)
            for field, y in (("t", v.t), ("z", v.z)):
                ok = ~(np.isnan(v.x) | np.isnan(y))
                row, xs, ys = v.row[ok], v.x[ok], y[ok]
                with np.errstate(invalid="ignore"):
                    least = np.nan_to_num(reduce(np.fmin, (departures(row, xs, ys, a, b) for a, b in PAIRS)))
                near = least.copy()
                for k in (1, 2):
                    same = row[k:] == row[:-k]
                    near[k:] = np.maximum(near[k:], np.where(same, least[:-k], 0))
                    near[:-k] = np.maximum(near[:-k], np.where(same, least[k:], 0))
                found = []
                for a, b in NEAREST[1:]:
                    d = departures(row, xs, ys, a, b)
                    there = ~np.isnan(d)
                    found.append(np.c_[source[row[there]], digits(d[there]), steps(near[there])])
                u, n = np.unique(np.concatenate(found), axis=0, return_counts=True)
                names = code.dictionary.take(pa.array(np.where(u[:, 0] < 0, None, u[:, 0]), pa.int32()))
                yield pa.RecordBatch.from_arrays([names, pa.array([field] * len(n), pa.string()), pa.array(u[:, 1]), pa.array(u[:, 2]), pa.array(n, pa.int64())], schema=kind)

    parts = df.select("source", "p", "t", "z", "factor", "offset").mapInArrow(run, "source string, field string, size double, near double, n long")
    return parts.groupBy("source", "field", "size", "near").agg(F.sum("n").alias("n"))


def wrong_in_profiles(df: DataFrame, t_range: tuple[float, float], z_range: tuple[float, float], stuck: int = 6) -> DataFrame:
    """``record_id, ascent_no, level_no`` of levels with an impossible, stuck or locally wrong t or z.

    ``df``: ``record_id, ascent_no, source, p, t, z`` (arrays of unequal length are padded with missing), ``factor, offset`` to kelvin, and the tail cutoffs
    ``cut_t, cut_z`` of the source. -32768 and null are missing and never come out; missing values don't end a run of equal t.
    Levels without pressure, and those of sources without cutoff (null), are held against the ranges and runs only.
    """

    kind = pa.schema([("record_id", pa.int64()), ("ascent_no", pa.int32()), ("level_no", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = Levels(batch)
            bad = np.zeros(len(v.row), bool)
            for y, (low, high), cut, runs in ((v.t, t_range, "cut_t", True), (v.z, z_range, "cut_z", False)):
                there = ~np.isnan(y)
                off = there & ((np.nan_to_num(y) < low) | (np.nan_to_num(y) > high))
                if runs:
                    at = np.flatnonzero(there)
                    if len(at):
                        new = np.r_[True, (y[at][1:] != y[at][:-1]) | (v.row[at][1:] != v.row[at][:-1])]
                        edge = np.flatnonzero(np.r_[new, True])
                        off[at[np.repeat(np.diff(edge) >= stuck, np.diff(edge))]] = True
                bad |= off
                limit = batch.column(batch.schema.get_field_index(cut)).to_numpy(zero_copy_only=False).astype(float)
                known = np.flatnonzero(there & ~np.isnan(v.x))
                alive = np.flatnonzero(~off[known])
                row, xs, ys = v.row[known][alive], v.x[known][alive], y[known][alive]
                d = departures(row, xs, ys, 1, 1)
                for a, b in NEAREST[1:]:
                    e = departures(row, xs, ys, a, b)
                    if len(alive) > a + b:
                        e[a : len(e) - b][alive[a + b :] - alive[: -a - b] != a + b] = np.nan
                    d = np.fmax(d, e)
                # Only profiles with a departure beyond the cutoff are searched, one by one.
                for r in np.unique(row[np.nan_to_num(d) > limit[row]]):
                    i = known[v.row[known] == r]
                    bad[i[wrong_levels(v.x[i], y[i], ~off[i], limit[r])]] = True
            hit = np.flatnonzero(bad)
            ids, nos = (batch.column(batch.schema.get_field_index(c)).take(pa.array(v.row[hit])) for c in ("record_id", "ascent_no"))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), nos.cast(pa.int32()), pa.array(v.no[hit], pa.int32())], schema=kind)

    return df.select("record_id", "ascent_no", "p", "t", "z", "factor", "offset", "cut_t", "cut_z").mapInArrow(run, "record_id long, ascent_no int, level_no int")
