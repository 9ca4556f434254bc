"""Seasonal states, projections, regressions, scores and significance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.learn import cross_sums, eof, harmonic_labels, harmonics, least_squares, matrix, ridge_ladder, spectrum, surrogate_correlations
from ..operators.stats import guarded_corr
from ..operators.windows import seasonal_anomaly
from ..tables import table
from .registry import registry
from .sequences import MONTHS, monthly
from .verification import OBS, good

QUERIES, ORACLE, query = registry()

ANOM = MONTHS + ", an as (select code, i, v - avg(v) filter (i < 48) over (partition by code, mo) a from m)"


def anomalies(spark, folder):
    """``code, i, a``: anomalies of the monthly series from the climatology of the first 48 months."""
    return seasonal_anomaly(monthly(spark, folder), ["code"], "mo", "v", F.col("i") < 48, "a").select("code", "i", "a")


@query(ANOM + ", s as (select code, greatest(sqrt(avg(a * a) filter (i < 48)), 1e-12) scale from an group by code) select code, i, round(a / scale, 6) z from an join s using (code)")
def mat_seasonal_state(spark, folder):
    """MAT-05: states scaled by the training RMS of their block."""
    a = anomalies(spark, folder)
    s = a.where("i < 48").groupBy("code").agg(F.greatest(F.sqrt(F.avg(F.col("a") * F.col("a"))), F.lit(1e-12)).alias("scale"))
    return a.join(s, "code").select("code", "i", F.round(F.col("a") / F.col("scale"), 6).alias("z"))


def harmonic_features(degree: int):
    def features(b: pd.DataFrame):
        y, _, _ = harmonics(b["lat"].to_numpy(float), b["lon"].to_numpy(float), degree)
        x = np.column_stack([y, b["t"].to_numpy(float)])
        return x, x, np.cos(np.radians(b["lat"].to_numpy(float)))

    return features


@query()
def mat_harmonic_fit(spark, folder):
    """MAT-01, MAT-03: weighted least squares of t on harmonics of degree 3 per six hours, with rank and condition."""
    g = good(spark, folder).where("abs(lat) < 89.9").select((F.floor(F.hour("obstime") / 6)).cast("int").alias("h"), "lat", "lon", "t")
    n = len(harmonic_labels(3))
    labels = F.array(*[F.struct(F.lit(a).alias("l"), F.lit(m).alias("m"), F.lit(p).alias("phase")) for a, m, p in harmonic_labels(3)])
    return least_squares(cross_sums(g, ["h"], harmonic_features(3)), ["h"], n, 1e-6).select("h", labels[F.col("k")].alias("mode"), "coef", "rank", "cond").select("h", "mode.*", "coef", "rank", "cond")


@query()
def mat_vector_fit(spark, folder):
    """MAT-02: winds fitted by gradient and rotation families of degree 2; angular divergence and curl of each mode."""
    d = F.radians("wd")
    g = good(spark, folder).where("ws is not null and wd is not null and abs(lat) < 89.9").select("lat", "lon", (-F.col("ws") * F.sin(d)).alias("u"), (-F.col("ws") * F.cos(d)).alias("v"))
    labels = harmonic_labels(2)[1:]
    k = len(labels)
    norm = np.sqrt([n * (n + 1) for n, _, _ in labels])

    def features(b: pd.DataFrame):
        lat = b["lat"].to_numpy(float)
        _, e, n = harmonics(lat, b["lon"].to_numpy(float), 2)
        e, n = e[:, 1:] / norm, n[:, 1:] / norm
        rows = np.column_stack([np.vstack([np.hstack([e, -n]), np.hstack([n, e])]), np.r_[b["u"].to_numpy(float), b["v"].to_numpy(float)]])
        return rows, rows, np.tile(np.cos(np.radians(lat)), 2)

    fit = least_squares(cross_sums(g, [], features), [], 2 * k, 1e-9)
    table_ = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(n).alias("l"), F.lit(m).alias("m"), F.lit(p).alias("phase"), F.lit(-float(np.sqrt(n * (n + 1)))).alias("s")) for f in ("gradient", "rotation") for n, m, p in labels])
    x = fit.select(table_[F.col("k")].alias("q"), "coef")
    channel = F.when(F.col("q.family") == "gradient", "divergence").otherwise("curl")
    return x.select("q.family", "q.l", "q.m", "q.phase", "coef", channel.alias("channel"), (F.col("q.s") * F.col("coef")).alias("channel_coef"))


@query()
def mat_advection(spark, folder):
    """MAT-15: the Galerkin operator of advection by the observed winds between modes of degree 1, as sums over rows."""
    d = F.radians("wd")
    g = good(spark, folder).where("ws is not null and wd is not null and abs(lat) < 89.9").select("lat", "lon", (-F.col("ws") * F.sin(d)).alias("u"), (-F.col("ws") * F.cos(d)).alias("v"))

    def features(b: pd.DataFrame):
        lat = b["lat"].to_numpy(float)
        y, e, n = harmonics(lat, b["lon"].to_numpy(float), 1)
        return y, -(b["u"].to_numpy(float)[:, None] * e + b["v"].to_numpy(float)[:, None] * n), np.cos(np.radians(lat))

    return cross_sums(g, [], features)


def projected(r: DataFrame) -> DataFrame:
    """``variable, run, mask, runs, n, rank, cond, c0, c1, c2`` from ``variable, run, region, x, y``: each run's y projected on a quadratic in x.

    The Gram matrix is built and judged once per identical mask (the set of regions of a run), as x depends on the region alone; the sums with y are each run's own.
    Coefficients are null where the rank falls short or the condition exceeds 1e8.
    """
    mask = r.groupBy("variable", "run").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("region")), ","), 256).alias("mask"), F.count("*").alias("n"))  # at most 52 regions a run
    one = mask.groupBy("mask").agg(F.min(F.struct("variable", "run")).alias("_r"), F.count("*").alias("runs"))
    quadratic = lambda b: np.vander(b["x"].to_numpy(float), 3, increasing=True)
    gram = cross_sums(r.join(one.select("mask", "_r.*"), ["variable", "run"]).select("mask", "x"), ["mask"], lambda b: (quadratic(b), quadratic(b), np.ones(len(b))))
    right = cross_sums(r.select("variable", "run", "x", "y"), ["variable", "run"], lambda b: (quadratic(b), b[["y"]].to_numpy(float), np.ones(len(b))))
    row = lambda s, by, name: s.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "total"))), lambda e: e["total"]).alias(name))
    runs = mask.join(one.select("mask", "runs"), "mask").join(row(gram, ["mask"], "gram"), "mask").join(row(right, ["variable", "run"], "right"), ["variable", "run"])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a = np.stack(b["gram"].to_numpy()).astype(float).reshape(-1, 3, 3) if len(b) else np.empty((0, 3, 3))
            y = np.stack(b["right"].to_numpy()).astype(float) if len(b) else np.empty((0, 3))
            rank, cond, c = np.linalg.matrix_rank(a), np.linalg.cond(a), np.full((len(b), 3), np.nan)
            ok = (rank == 3) & (cond <= 1e8)
            c[ok] = np.linalg.solve(a[ok], y[ok][..., None])[..., 0]
            yield b[["variable", "run", "mask", "runs", "n"]].assign(rank=rank, cond=cond, c0=c[:, 0], c1=c[:, 1], c2=c[:, 2])

    out = runs.mapInPandas(solve, "variable string, run string, mask string, runs long, n long, rank int, cond double, c0 double, c1 double, c2 double")
    return out.select("variable", "run", "mask", "runs", "n", "rank", "cond", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("c0", "c1", "c2")))


@query()
def mat_masked_projection(spark, folder):
    """MAT-04, AGG-22, R-19: regions of each run and variable projected on a quadratic; Gram matrices are built once per identical mask, runs share them."""
    p = table(spark, folder, "plane_ceiling").where("variable is not null and run is not null and region is not null and median is not null and not isnan(median) and median < 1e19 and median <> -9999")
    r = p.groupBy("variable", F.col("run").cast("string").alias("run"), "region").agg(F.avg("median").alias("y"))
    return projected(r.withColumn("x", F.regexp_extract("region", r"(\d+)", 1).cast("double") / 26 - 1))


EMB = "with e as (select vec_id, label, unnest(embedding)::double x, generate_subscripts(embedding, 1) - 1 i from embeddings)"
GRAM = EMB + " select a.label, a.i::int i, b.i::int j, round(sum(a.x * b.x), 6) total from e a join e b using (vec_id) group by a.label, a.i, b.i"


@query(GRAM)
def mat_gram(spark, folder):
    """MAT-03: Gram matrices per label, of all dimensions."""

    def features(b: pd.DataFrame):
        x = np.stack(b["embedding"].to_numpy()).astype(float)
        return x, x, np.ones(len(b))

    return cross_sums(table(spark, folder, "embeddings").select("label", "embedding"), ["label"], features).withColumn("total", F.round("total", 6))


@query()
def mat_eof(spark, folder):
    """MAT-06: leading patterns of the embeddings from their 64 by 64 Gram matrix, the only thing that reaches the driver."""

    def features(b: pd.DataFrame):
        x = np.stack(b["embedding"].to_numpy()).astype(float)
        return x, x, np.ones(len(b))

    m = matrix(cross_sums(table(spark, folder, "embeddings").select("embedding"), [], features).toPandas())
    v, share = eof(m, 4)
    return spark.createDataFrame([(k, float(share[k]), [float(x) for x in v[:, k]]) for k in range(4)], "k int, share double, loadings array<double>")


SCORE = EMB + """, g as (select a.label, a.i, b.i j, avg(a.x * b.x) v, count(*) n from e a join e b using (vec_id) group by a.label, a.i, b.i), m as (select label, i, avg(x) v from e group by label, i)
 select g.label, max(g.n) n, round(sum(g.v * (g.v - a.v * b.v)), 6) resolved_mse from g join m a on a.label = g.label and a.i = g.i join m b on b.label = g.label and b.i = g.j group by g.label"""


@query(SCORE)
def mat_quadratic_score(spark, folder):
    """MAT-10: quadratic-form errors d'Gd over all dimensions, from sums per label."""

    def features(b: pd.DataFrame):
        z = np.column_stack([np.ones(len(b)), np.stack(b["embedding"].to_numpy()).astype(float)])
        return z, z, np.ones(len(b))

    def score(g: pd.DataFrame) -> pd.DataFrame:
        m = matrix(g)
        n, mean, second = m[0, 0], m[0, 1:] / m[0, 0], m[1:, 1:] / m[0, 0]
        return pd.DataFrame({"label": [g["label"].iloc[0]], "n": [int(n)], "resolved_mse": [float((second * (second - np.outer(mean, mean))).sum())]})

    e = table(spark, folder, "embeddings").select("label", "embedding")
    return cross_sums(e, ["label"], features).groupBy("label").applyInPandas(score, f"label {dict(e.dtypes)['label']}, n long, resolved_mse double").withColumn("resolved_mse", F.round("resolved_mse", 6))


@query(ANOM + """, p as (select a.code, a.i, a.a x, b.a y from an a join an b on b.code = a.code and b.i = a.i + 1), f as (select code, least(greatest(sum(x * y) / greatest(sum(x * x), 1e-12), -0.98), 0.98) phi from p where i < 47 group by code)
 select code, round(phi, 6) phi, round(1 - avg((y - phi * x) * (y - phi * x)) / avg(y * y), 6) skill from p join f using (code) where i >= 48 group by code, phi""")
def mat_ar1(spark, folder):
    """MAT-09, MAT-17, R-18: AR(1) per series on training pairs, clipped at 0.98, and its skill against climatology later on."""
    an = anomalies(spark, folder)
    p = an.select("code", "i", F.col("a").alias("x")).join(an.select("code", (F.col("i") - 1).alias("i"), F.col("a").alias("y")), ["code", "i"])
    x, y = F.col("x"), F.col("y")
    f = p.where("i < 47").groupBy("code").agg(F.least(F.greatest(F.sum(x * y) / F.greatest(F.sum(x * x), F.lit(1e-12)), F.lit(-0.98)), F.lit(0.98)).alias("phi"))
    e = y - F.col("phi") * x
    return p.where("i >= 48").join(f, "code").groupBy("code", "phi").agg(F.round(1 - F.avg(e * e) / F.avg(y * y), 6).alias("skill")).withColumn("phi", F.round("phi", 6))


@query(ANOM + """, p as (select a.code, a.i, a.a x, b.a y from an a join an b on b.code = a.code and b.i = a.i + 1), f as (select code, least(greatest(sum(x * y) / greatest(sum(x * x), 1e-12), -0.98), 0.98) phi from p where i < 47 group by code),
 s as (select code, sqrt(avg(a * a) filter (i < 48)) sd, max(a) filter (i = 60) x0 from an group by code) select code, k step, round(x0 * pow(phi, k), 3) forecast, abs(x0 * pow(phi, k) / sd) <= 3 in_scope from f join s using (code), range(1, 7) r(k)""")
def mat_chained_forecast(spark, folder):
    """MAT-11: the one-step map iterated over six steps from month 60, each step held against the training scale."""
    an = anomalies(spark, folder)
    p = an.select("code", "i", F.col("a").alias("x")).join(an.select("code", (F.col("i") - 1).alias("i"), F.col("a").alias("y")), ["code", "i"])
    x, y = F.col("x"), F.col("y")
    f = p.where("i < 47").groupBy("code").agg(F.least(F.greatest(F.sum(x * y) / F.greatest(F.sum(x * x), F.lit(1e-12)), F.lit(-0.98)), F.lit(0.98)).alias("phi"))
    s = an.groupBy("code").agg(F.sqrt(F.avg(F.when(F.col("i") < 48, F.col("a") * F.col("a")))).alias("sd"), F.max(F.when(F.col("i") == 60, F.col("a"))).alias("x0"))
    k = f.join(s, "code").select("*", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("step"))
    v = F.col("x0") * F.pow("phi", F.col("step"))
    return k.select("code", F.col("step").cast("long").alias("step"), F.round(v, 3).alias("forecast"), (F.abs(v / F.col("sd")) <= 3).alias("in_scope"))


def wide(spark, folder) -> tuple[list[str], pd.DataFrame]:
    """The anomalies as months by series: at most one row per calendar month, a few series."""
    codes = [r.code for r in anomalies(spark, folder).select("code").distinct().orderBy("code").collect()]
    return codes, anomalies(spark, folder).groupBy("i").pivot("code", codes).agg(F.first("a")).dropna().orderBy("i")


@query()
def mat_ridge_select(spark, folder):
    """MAT-07, MAT-08: six-lead ridge maps over ranks and penalties, chosen on validation months only, all from sums per lead."""
    codes, w = wide(spark, folder)
    pairs = w.select("i", F.array(*[F.col(c) / 1e6 for c in codes]).alias("x"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("lead")).withColumn("t", F.col("i") + F.col("lead"))
    pairs = pairs.join(w.select(F.col("i").alias("t"), F.array(*[F.col(c) / 1e6 for c in codes]).alias("y")), "t").withColumn("part", F.when(F.col("t") < 48, "train").when((F.col("t") < 64), "valid")).where("part is not null")

    def features(b: pd.DataFrame):
        z = np.column_stack([np.stack(b["x"].to_numpy()), np.stack(b["y"].to_numpy()), np.ones(len(b))])
        return z, z, np.ones(len(b))

    sums = cross_sums(pairs.select("lead", "part", "x", "y"), ["lead", "part"], features).toPandas()
    n, train, valid = len(codes), {}, {}
    for (lead, part), g in sums.groupby(["lead", "part"]):
        m = matrix(g)
        if part == "train":
            train[lead] = (m[:n, :n], m[:n, n : 2 * n], m[-1, -1])
        else:
            valid[lead] = (m[:n, :n], m[:n, n : 2 * n], float(np.trace(m[n : 2 * n, n : 2 * n])), m[-1, -1])
    rows = ridge_ladder(train, valid, train[1][0], list(range(1, n + 1)), [0.01, 0.1, 1.0])
    best = min(range(len(rows)), key=lambda k: rows[k]["loss"])
    return spark.createDataFrame([(r["rank"], r["penalty"], r["loss"], k == best) for k, r in enumerate(rows)], "rank int, penalty double, loss double, chosen boolean")


@query()
def mat_ablation(spark, folder):
    """MAT-12: nested models M0 to M4 of next month's first series on a growing set of series, fitted on training months, scored later."""
    codes, w = wide(spark, folder)
    nxt = w.select((F.col("i") - 1).alias("i"), F.col(codes[0]).alias("y"))
    d = w.select("i", *(F.col(c).alias(f"x{k}") for k, c in enumerate(codes))).join(nxt, "i").withColumn("part", F.when(F.col("i") < 47, "train").otherwise("test"))

    def features(b: pd.DataFrame):
        z = np.column_stack([np.ones(len(b)), b[[f"x{k}" for k in range(len(codes))]].to_numpy(float) / 1e6, b["y"].to_numpy(float) / 1e6])
        return z, z, np.ones(len(b))

    s = {part: matrix(g) for part, g in cross_sums(d, ["part"], features).toPandas().groupby("part")}
    out = []
    for m in range(len(codes)):
        k = m + 1
        a, t = s["train"], s["test"]
        coef = np.linalg.lstsq(a[:k, :k], a[:k, -1], rcond=None)[0]
        n = t[0, 0]
        mse = (coef @ t[:k, :k] @ coef - 2 * coef @ t[:k, -1] + t[-1, -1]) / n
        mean_p, mean_y = coef @ t[:k, 0] / n, t[0, -1] / n
        var_p, var_y, cov = coef @ t[:k, :k] @ coef / n - mean_p**2, t[-1, -1] / n - mean_y**2, coef @ t[:k, -1] / n - mean_p * mean_y
        out.append((f"M{m}", int(n), float(np.sqrt(max(mse, 0))), float(cov / np.sqrt(var_p * var_y)) if var_p > 1e-12 else None))
    return spark.createDataFrame(out, "model string, n int, rmse double, r double")


@query(ANOM + """, n as (select code, count(*) n, avg(a) mean_a, min(i) i0 from an group by code), x as (select code, n, i - i0 j, (a - mean_a) * (0.5 - 0.5 * cos(2 * pi() * (i - i0) / (n - 1))) v, pow(0.5 - 0.5 * cos(2 * pi() * (i - i0) / (n - 1)), 2) w from an join n using (code))
 select code, k::int k, round(k::double / n, 9) frequency, round((pow(sum(v * cos(2 * pi() * k * j / n)), 2) + pow(sum(v * sin(2 * pi() * k * j / n)), 2)) / sum(w) / 1e9, 4) power from x, range(0, 1000) r(k) where k <= n // 2 group by code, n, k""")
def mat_spectrum(spark, folder):
    """MAT-13: tapered spectra of the monthly series, power in units of 1e9; uneven series give none."""
    s = spectrum(anomalies(spark, folder), "code", "i", "a")
    return s.withColumn("frequency", F.round("frequency", 9)).withColumn("power", F.round(F.col("power") / 1e9, 4))


@query()
def mat_significance(spark, folder):
    """MAT-14: correlations of all pairs of series (in the order of their codes) with surrogate p-values, bootstrap intervals and Holm's correction."""
    codes, w = wide(spark, folder)
    x = w.toPandas()[codes].to_numpy(float)  # one row per month of the calendar
    r = np.corrcoef(x.T)
    draws = surrogate_correlations(spark, x, 1999, 20240924)
    obs = F.array(*[F.lit(float(r[i, j])) for i in range(len(codes)) for j in range(i + 1, len(codes))])[F.col("pair")]
    p = draws.groupBy("pair").agg(((1 + F.count_if(F.abs("null_r") >= F.abs(obs))) / (F.count("*") + 1)).alias("p"), F.percentile("boot_r", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))
    n, rank = F.count("*").over(Window.partitionBy()), F.row_number().over(Window.orderBy("p", "pair"))
    h = p.withColumn("_k", rank).withColumn("_h", (n - F.col("_k") + 1) * F.col("p"))
    return h.select("pair", obs.alias("r"), "p", F.col("ci")[0].alias("low"), F.col("ci")[1].alias("high"), F.least(F.lit(1.0), F.max("_h").over(Window.orderBy("_k"))).alias("p_holm"))


@query(OBS + """, c as (select s, floor((90 - lat) / s)::bigint r, floor((lon + 180) / s)::bigint q, t from good, (values (5.0::double), (10.0::double), (15.0::double)) v(s)), g as (select s, r, q, count(*) n, var_pop(t) v from c group by all having count(*) >= 3 and var_pop(t) > 1e-9),
 l as (select s, count(*) cells, sum(n)::bigint n, round(sum(0.5 * n * (log2(2 * pi() * exp(1)) + log2(v))), 3) bits from g group by s) select s size, cells, n, bits, rank() over (order by bits / n, s) place from l""")
def mat_caliber_ledger(spark, folder):
    """MAT-18, FN-11: code length of the same rows on grids of several sizes, ranked."""
    c = good(spark, folder).select("lat", "lon", "t", F.explode(F.array(F.lit(5.0), F.lit(10.0), F.lit(15.0))).alias("size"))
    g = c.groupBy("size", F.floor((90 - F.col("lat")) / F.col("size")).alias("r"), F.floor((F.col("lon") + 180) / F.col("size")).alias("q")).agg(F.count("*").alias("n"), F.var_pop("t").alias("v")).where("n >= 3 and v > 1e-9")
    bits = F.sum(0.5 * F.col("n") * (F.log2(2 * F.pi() * F.exp(F.lit(1.0))) + F.log2("v")))
    x = g.groupBy("size").agg(F.count("*").alias("cells"), F.sum("n").alias("n"), F.round(bits, 3).alias("bits"))
    return x.withColumn("place", F.rank().over(Window.orderBy(F.col("bits") / F.col("n"), "size")))  # one row per size


@query(OBS + """, p as (select hour(obstime) h, t, td from good where td is not null) select h, count(*) n, round(corr(t, td) * corr(t, td), 6) r2, round(regr_slope(td, t), 6) forward, round(regr_slope(t, td), 6) backward from p group by h""")
def mat_redundancy(spark, folder):
    """MAT-19: how much of either of two columns the other explains, in both directions."""
    p = good(spark, folder).where("td is not null")
    r = guarded_corr(F.col("t"), F.col("td"))
    return p.groupBy(F.hour("obstime").alias("h")).agg(F.count("*").alias("n"), F.round(r * r, 6).alias("r2"), F.round(F.regr_slope("td", "t"), 6).alias("forward"), F.round(F.regr_slope("t", "td"), 6).alias("backward"))


QUERIES["mat_gram_all"], QUERIES["mat_quadratic_score_all"] = mat_gram, mat_quadratic_score  # names of the last round, the same work
ORACLE["mat_gram_all"], ORACLE["mat_quadratic_score_all"] = GRAM, SCORE
