"""Statistics of errors and groups, each one aggregation with partial sums before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def clean(x: Column) -> Column:
    """A finite number or null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def exact_percentiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]], index: bool = False, weight: str | None = None, few: int = 50_000) -> DataFrame:
    """``by`` and a column per name of ``wanted`` (name to value column and share): the interpolated percentile, or with ``index`` ``sorted[int(n * share)]``, exact at any size.

    No group is ever held. Values are counted in bins of a logarithm with sign, at most some ten thousand a group whatever its size; a running
    sum over the bins tells in which ones the ranks fall. Bins of more than ``few`` rows are cut into 4,096 equal parts once more. Only rows in the bins
    of a rank are then counted value by value. ``weight`` says how often a row counts. Null, NaN and infinite values are left out; a group
    without others has no row; null groups are a group. ``df`` is read three times: a table, or what was ``written``.
    """
    fields = sorted({f for f, _ in wanted.values()})
    g = F.struct(*(F.col(c) for c in by)) if by else F.struct(F.lit(0).alias("_"))
    w = (F.col(weight) if weight else F.lit(1)).cast("long")
    base = df.select(g.alias("g"), w.alias("w"), F.inline(F.array(*(F.struct(F.lit(f).alias("f"), clean(F.col(f).cast("double")).alias("v")) for f in fields)))).where("v is not null")
    base = base.withColumn("b", F.floor(F.signum("v") * F.log1p(F.least(F.abs("v") * 1e6, F.lit(1e308))) * 32).cast("int"))

    def ranked(bins: DataFrame, keys: list[str], order: str, ranks: Column | None) -> DataFrame:
        """The bins that hold a rank: with their least and greatest value, the count before them and the ranks in them."""
        over = Window.partitionBy(*keys)
        n = bins.withColumn("upto", F.sum("n").over(over.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
        if ranks is None:
            n = n.withColumn("all", F.sum("n").over(over))
            at = lambda s: F.array(F.floor(F.col("all") * s)) if index else F.array(F.floor((F.col("all") - 1) * s), F.ceil((F.col("all") - 1) * s))
            ranks = F.coalesce(*(F.when(F.col("f") == f, F.array_distinct(F.concat(*(at(s) for c, s in wanted.values() if c == f)))) for f in fields))
            before = F.col("upto") - F.col("n")
        else:
            before = F.col("before") + F.col("upto") - F.col("n")
        n = n.withColumn("before", before).withColumn("k", F.filter(ranks, lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("n"))))
        return n.where(F.size("k") > 0)

    bounds = [F.sum("w").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    one = written(ranked(base.groupBy("g", "f", "b").agg(*bounds), ["g", "f"], "b", None).select("g", "f", "b", "n", "lo", "hi", "all", "before", "k"))
    part = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 4096), F.lit(4095)).cast("int")
    many = one.where((F.col("n") > few) & (F.col("lo") < F.col("hi"))).select("g", "f", "b", "lo", "hi", "before", "k")
    cut = base.join(many, ["g", "f", "b"]).withColumn("b2", part)
    two = ranked(cut.groupBy("g", "f", "b", "b2", F.col("lo").alias("l1"), F.col("hi").alias("h1"), "before", F.col("k").alias("k1")).agg(*bounds), ["g", "f", "b"], "b2", F.col("k1"))
    two = two.select("g", "f", "b", "b2", F.col("l1").alias("lo"), F.col("h1").alias("hi"), "before", "k")
    rest = one.where((F.col("n") <= few) & (F.col("lo") < F.col("hi"))).select("g", "f", "b", F.lit(0).alias("b2"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), "before", "k")
    need = rest.unionByName(two)
    near = base.join(need.withColumnRenamed("b2", "_b2"), ["g", "f", "b"]).where(F.col("lo").isNull() | (part == F.col("_b2")))
    three = ranked(near.groupBy("g", "f", "b", F.col("_b2").alias("b2"), "before", F.col("k").alias("k1"), "v").agg(F.sum("w").alias("n")), ["g", "f", "b", "b2"], "v", F.col("k1"))
    found = one.where("lo = hi").select("g", "f", F.explode("k").alias("k"), F.col("lo").alias("v")).unionByName(three.select("g", "f", F.explode("k").alias("k"), "v"))
    maps = found.groupBy("g", "f").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))  # two entries a share
    all_n = one.groupBy("g", "f").agg(F.max("all").alias("all"))
    x = all_n.join(maps, ["g", "f"], "left")

    def value(f: str, share: float) -> Column:
        if index:
            v = F.col("m")[F.floor(F.col("all") * share)]
        else:
            at = (F.col("all") - 1) * share
            a, b = F.col("m")[F.floor(at)], F.col("m")[F.ceil(at)]
            v = a + (b - a) * (at - F.floor(at))
        return F.max(F.when(F.col("f") == f, v))

    out = x.groupBy("g").agg(*(value(f, share).alias(name) for name, (f, share) in wanted.items()))
    return out.select(*(F.col("g")[c].alias(c) for c in by), *wanted)


def with_percentiles(stats: DataFrame, percentiles: DataFrame, by: list[str]) -> DataFrame:
    """Aggregates of groups with the exact percentiles of the same groups beside them; null keys meet."""
    if not by:
        return stats.join(percentiles.withColumn("_one", F.lit(1)), F.col("_one") == 1, "left").drop("_one")  # one row each
    p = percentiles.select(*(F.col(c).alias(f"_p_{c}") for c in by), *(c for c in percentiles.columns if c not in by))
    return stats.join(p, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in by]), "left").drop(*(f"_p_{c}" for c in by))


def error_summary(df: DataFrame, by: list[str], error: str, population: bool = True, digits: int = 6) -> DataFrame:
    """``n, median_bias, mean_bias, mae, rmse`` and the sd of an error per group; population or sample sd, named so."""
    df = written(df.select(*by, error))  # two columns, read for the sums and for the median
    e = F.col(error)
    sd = F.stddev_pop(e) if population else F.stddev_samp(e)
    aggs = {"mean_bias": F.avg(e), "mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "sd_pop" if population else "sd_samp": sd}
    sums = df.groupBy(*by).agg(F.count(e).alias("n"), *(F.round(a, digits).alias(n) for n, a in aggs.items()))
    out = with_percentiles(sums, exact_percentiles(df, by, {"median_bias": (error, 0.5)}), by)
    return out.select(*by, "n", F.round("median_bias", digits).alias("median_bias"), *aggs)


def pooled(per_run: DataFrame, by: list[str], n: str, values: list[str], digits: int = 6) -> DataFrame:
    """The n-weighted mean of per-run statistics: medians of runs are pooled, never recomputed from raw errors."""
    return per_run.groupBy(*by).agg(F.count("*").alias("runs"), F.sum(n).alias("n"), *(F.round(F.sum(F.col(v) * F.col(n)) / F.sum(n), digits).alias(v) for v in values))


def gated(df: DataFrame, n: str, least: int, values: list[str]) -> DataFrame:
    """Rows below the least number stay, with their values suppressed and ``state`` = insufficient."""
    ok = F.col(n) >= least
    return df.select(*(F.when(ok, F.col(c)).alias(c) if c in values else c for c in df.columns), F.when(ok, "ok").otherwise("insufficient").alias("state"))


def index_percentiles(df: DataFrame, by: list[str], x: str, shares: dict[str, float]) -> DataFrame:
    """``n`` and ``sorted[int(n * share)]`` per group, another value than the interpolated percentile; columns named by ``shares``. Nulls are left out."""
    n = df.where(clean(F.col(x)).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"))
    return with_percentiles(n, exact_percentiles(df, by, {name: (x, s) for name, s in shares.items()}, index=True), by)


def guarded_corr(x: Column, y: Column, least: int = 3) -> Column:
    """Pearson correlation of the complete pairs; null for fewer than ``least`` pairs or no variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.when(F.count(a) >= least, F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))))


def normal_sums(y: Column, xs: list[Column]) -> list[Column]:
    """The sums of the normal equations of y on xs with intercept, over complete rows: ``n, s_i, s_ij, sy, sy_i``."""
    ok = reduce(lambda a, b: a & b, [c.isNotNull() for c in (y, *xs)])
    w = lambda c: F.sum(F.when(ok, c))
    out = [F.count(F.when(ok, 1)).alias("n"), w(y).alias("sy"), w(y * y).alias("syy")]
    for i, a in enumerate(xs):
        out += [w(a).alias(f"s{i}"), w(a * y).alias(f"sy{i}")]
        out += [w(a * b).alias(f"s{i}{j}") for j, b in enumerate(xs) if j >= i]
    return out


def ols2(df: DataFrame, by: list[str], y: str, x0: str, x1: str, digits: int = 6) -> DataFrame:
    """``n, b0, b1, b2`` of y = b0 + b1 x0 + b2 x1 by the closed form of the centred normal equations; null where the regressors are all but collinear."""
    s = df.groupBy(*by).agg(*normal_sums(F.col(y), [F.col(x0), F.col(x1)]))
    n = F.col("n")
    c = lambda ab, a, b: F.col(ab) - F.col(a) * F.col(b) / n
    a00, a01, a11, g0, g1 = c("s00", "s0", "s0"), c("s01", "s0", "s1"), c("s11", "s1", "s1"), c("sy0", "sy", "s0"), c("sy1", "sy", "s1")
    det = a00 * a11 - a01 * a01
    det = F.when(det > 1e-9 * a00 * a11, det)
    b1, b2 = F.try_divide(g0 * a11 - g1 * a01, det), F.try_divide(g1 * a00 - g0 * a01, det)
    b0 = (F.col("sy") - b1 * F.col("s0") - b2 * F.col("s1")) / n
    return s.select(*by, "n", F.round(b0, digits).alias("b0"), F.round(b1, digits).alias("b1"), F.round(b2, digits).alias("b2"))


def weighted_mean(x: Column, w: Column) -> Column:
    """sum(xw) / sum(w over present x)."""
    return F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def contingency(df: DataFrame, by: list[str], a: Column, b: Column) -> DataFrame:
    """Shares of rows where both, only a and only b hold, and the hit rate of a given b (null without any b)."""
    both, only_a, only_b = (a & b).cast("int"), (a & ~b).cast("int"), (~a & b).cast("int")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg(both), 6).alias("share_both"), F.round(F.avg(only_a), 6).alias("share_a_only"), F.round(F.avg(only_b), 6).alias("share_b_only"),
        F.round(F.try_divide(F.sum(both), F.sum(b.cast("int"))), 6).alias("hit_rate"),
    )


def threshold_sweep(df: DataFrame, by: list[str], score: str, truth: Column, thresholds: list[float]) -> DataFrame:
    """Per threshold ``flagged, hits, false_alarms, misses`` and rates. Thresholds are exploded from a literal list, so rows are read once."""
    t = df.select(*by, F.col(score).alias("_s"), truth.alias("_y"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    on = F.col("_s") >= F.col("threshold")
    n = lambda c: F.count(F.when(c, 1))
    return t.groupBy(*by, "threshold").agg(
        n(on).alias("flagged"), n(on & F.col("_y")).alias("hits"), n(on & ~F.col("_y")).alias("false_alarms"), n(~on & F.col("_y")).alias("misses"),
        F.round(F.try_divide(n(on & F.col("_y")), n(on)), 6).alias("precision"), F.round(F.try_divide(n(on & F.col("_y")), n(F.col("_y"))), 6).alias("recall"),
    )


def banded(x: Column, edges: list[float], name: str = "band") -> Column:
    """The half-open band [lo, hi) of a number with open ends, numbered from 0; null stays null."""
    out = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        out = F.when(x < e, i).otherwise(out)
    return F.when(x.isNotNull(), out).alias(name)
