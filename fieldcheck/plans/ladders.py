"""Models over leads, targets, resolutions and geometries, and rechecks of what was published."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import located, wrap_lon
from ..operators.learn import spectrum
from ..operators.stats import guarded_corr, ols2
from ..session import shared_folder, written
from ..sources import sinks
from ..tables import entity, number, table
from .learning import ANOM, anomalies
from .registry import registry
from .sequences import CELLS, cell_means
from .verification import OBS, PAIRS, good, lead_pairs

QUERIES, ORACLE, query = registry()

NEXT = ANOM + """, p as (select a.code, a.i, a.a x, b.a y from an a join an b on b.code = a.code and b.i = a.i + 1),
 f as (select code, sum(x * y) / greatest(sum(x * x), 1e-12) phi from p where i < 47 group by code)"""


def next_month(spark, folder, lead: int = 1) -> DataFrame:
    """``code, i, x, y``: anomalies of a month and of the one ``lead`` months on."""
    an = anomalies(spark, folder)
    return an.select("code", "i", F.col("a").alias("x")).join(an.select("code", (F.col("i") - lead).alias("i"), F.col("a").alias("y")), ["code", "i"])


def slope(p: DataFrame, by: list[str]) -> DataFrame:
    """The slope through the origin of y on x."""
    x, y = F.col("x"), F.col("y")
    return p.groupBy(*by).agg((F.sum(x * y) / F.greatest(F.sum(x * x), F.lit(1e-12))).alias("phi"))


def rms(c, scale: float = 1000.0, digits: int = 3):
    return F.round(F.sqrt(F.avg(c * c)) / scale, digits)


@query(ANOM + """, p as (select a.code, k lead, a.i, a.a x, b.a y from an a, range(1, 7) v(k), an b where b.code = a.code and b.i = a.i + k),
 f as (select code, lead, sum(x * y) / greatest(sum(x * x), 1e-12) phi from p where i + lead < 48 group by all)
 select code, lead, count(*) n, round(phi, 5) phi, round(sqrt(avg((y - phi * x) * (y - phi * x))) / 1000, 3) rmse, round(sqrt(avg((y - x) * (y - x))) / 1000, 3) persistence, round(sqrt(avg(y * y)) / 1000, 3) climatology
 from p join f using (code, lead) where i >= 48 group by code, lead, phi""")
def mat_lead_sweep(spark, folder):
    """R-23: a model fitted for each lead on training months, scored later against persistence and climatology."""
    an = anomalies(spark, folder)
    a = an.select("code", "i", F.col("a").alias("x"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(6).cast("long"))).alias("lead")).withColumn("t", F.col("i") + F.col("lead"))
    p = a.join(an.select("code", F.col("i").alias("t"), F.col("a").alias("y")), ["code", "t"])
    f = slope(p.where("t < 48"), ["code", "lead"])
    x, y = F.col("x"), F.col("y")
    s = p.where("i >= 48").join(f, ["code", "lead"]).groupBy("code", "lead", "phi").agg(F.count("*").alias("n"), rms(y - F.col("phi") * x).alias("rmse"), rms(y - x).alias("persistence"), rms(y).alias("climatology"))
    return s.withColumn("phi", F.round("phi", 5))


@query(ANOM + """, t as (select i, sum(a) s, count(*) k from an group by i), d as (select a.code, a.i, a.a / 1e5 x0, (s - a.a) / (k - 1) / 1e5 x1, b.a / 1e5 y from an a join t using (i) join an b on b.code = a.code and b.i = a.i + 1 where k > 1),
 s as (select code, count(*) n, sum(y) sy, sum(x0) s0, sum(x1) s1, sum(x0*x0) s00, sum(x0*x1) s01, sum(x1*x1) s11, sum(x0*y) sy0, sum(x1*y) sy1 from d where i < 47 group by code),
 c as (select *, s00-s0*s0/n a00, s01-s0*s1/n a01, s11-s1*s1/n a11, sy0-sy*s0/n g0, sy1-sy*s1/n g1 from s),
 b as (select *, (g0*a11-g1*a01)/(a00*a11-a01*a01) b1, (g1*a00-g0*a01)/(a00*a11-a01*a01) b2, sy0 / s00 phi from c), fit as (select *, (sy - b1*s0 - b2*s1)/n b0 from b),
 o as (select d.code, y, phi * x0 m1, b0 + b1 * x0 + b2 * x1 m2 from d join fit using (code) where i >= 48)
 select code target, count(*) n, round(sqrt(avg(y*y)), 5) m0_rmse, round(sqrt(avg((y-m1)*(y-m1))), 5) m1_rmse, round(sqrt(avg((y-m2)*(y-m2))), 5) m2_rmse, round(corr(y, m2), 5) m2_r from o group by code""")
def mat_target_ablation(spark, folder):
    """R-22: for each target series the nested models climatology, its own last month, and that with the mean of all other series; fitted on training months, scored later."""
    an = anomalies(spark, folder)
    t = an.groupBy("i").agg(F.sum("a").alias("s"), F.count("*").alias("k")).where("k > 1")
    d = next_month(spark, folder).join(t, "i").select("code", "i", (F.col("x") / 1e5).alias("x0"), ((F.col("s") - F.col("x")) / (F.col("k") - 1) / 1e5).alias("x1"), (F.col("y") / 1e5).alias("y"))
    d = written(d)
    two = ols2(d.where("i < 47"), ["code"], "y", "x0", "x1", 12).drop("n")
    one = slope(d.where("i < 47").withColumnRenamed("x0", "x"), ["code"])
    y, m1, m2 = F.col("y"), F.col("phi") * F.col("x0"), F.col("b0") + F.col("b1") * F.col("x0") + F.col("b2") * F.col("x1")
    return d.where("i >= 48").join(two, "code").join(one, "code").groupBy(F.col("code").alias("target")).agg(
        F.count("*").alias("n"), rms(y, 1, 5).alias("m0_rmse"), rms(y - m1, 1, 5).alias("m1_rmse"), rms(y - m2, 1, 5).alias("m2_rmse"), F.round(guarded_corr(y, m2), 5).alias("m2_r")
    )


@query(NEXT + """, v as (select code, k * 0.25 shrink, avg((y - phi * k * 0.25 * x) * (y - phi * k * 0.25 * x)) loss from p join f using (code), range(0, 5) r(k) where i between 48 and 59 group by all),
 c as (select code, arg_min(shrink, (round(loss / 1e6, 4), shrink)) shrink from v group by code)
 select code, round(shrink, 2)::double shrink, round(1 - avg((y - phi * shrink * x) * (y - phi * shrink * x)) / avg(y * y), 6) skill from p join f using (code) join c using (code) where i >= 60 group by code, shrink""")
def mat_shrink_select(spark, folder):
    """R-18: the shrinkage of an AR(1) chosen on validation months alone, the smaller on ties, and its skill on later ones."""
    p = written(next_month(spark, folder).join(slope(next_month(spark, folder).where("i < 47"), ["code"]), "code"))
    e = F.col("y") - F.col("phi") * F.col("shrink") * F.col("x")
    v = p.where("i between 48 and 59").withColumn("shrink", F.explode(F.array(*(F.lit(k * 0.25) for k in range(5))))).groupBy("code", "shrink").agg(F.avg(e * e).alias("loss"))
    c = v.groupBy("code").agg(F.min_by("shrink", F.struct(F.round(F.col("loss") / 1e6, 4), F.col("shrink"))).alias("shrink"))
    return p.where("i >= 60").join(c, "code").groupBy("code", "shrink").agg(F.round(1 - F.avg(e * e) / F.avg(F.col("y") * F.col("y")), 6).alias("skill"))


@query(NEXT + """, e as (select code, i, (i + 1) % 12 mo, y - phi * x r from p join f using (code)), c as (select code, mo, avg(r) c from e where i < 47 group by all)
 select code, count(*) n, round(sqrt(avg(r * r)) / 1000, 3) before, round(sqrt(avg((r - c) * (r - c))) / 1000, 3) after, avg((r - c) * (r - c)) < avg(r * r) better from e join c using (code, mo) where i >= 48 group by code""")
def mat_residual_correction(spark, folder):
    """R-27: the mean residual of each calendar month taken off later forecasts. A hard gate first: the slope must come out alike from regression moments, or the query raises."""
    p = written(next_month(spark, folder))
    train = p.where("i < 47")
    again = train.groupBy("code").agg((F.avg(F.col("x") * F.col("y")) / F.avg(F.col("x") * F.col("x"))).alias("again"))
    f = slope(train, ["code"]).join(again, "code")
    gate = F.abs(F.col("again") - F.col("phi")) <= 1e-9 * F.abs("phi") + 1e-12
    f = f.select("code", F.when(gate, F.col("phi")).otherwise(F.raise_error(F.lit("the published slope isn't reproduced")).cast("double")).alias("phi"))
    e = p.join(f, "code").select("code", "i", ((F.col("i") + 1) % 12).alias("mo"), (F.col("y") - F.col("phi") * F.col("x")).alias("r"))
    c = e.where("i < 47").groupBy("code", "mo").agg(F.avg("r").alias("c"))
    r, d = F.col("r"), F.col("r") - F.col("c")
    return e.where("i >= 48").join(c, ["code", "mo"]).groupBy("code").agg(F.count("*").alias("n"), rms(r).alias("before"), rms(d).alias("after"), (F.avg(d * d) < F.avg(r * r)).alias("better"))


@query(OBS + """, x as (select obs_id, t, day(obstime) <= 15 train, floor((90 - lat) / 5)::bigint r5, floor((lon + 180) / 5)::bigint q5, floor((90 - lat) / 10)::bigint r10, floor((lon + 180) / 10)::bigint q10 from good),
 a as (select r5, q5, avg(t) p5 from x where train group by all), b as (select r10, q10, avg(t) p10 from x where train group by all), c as (select avg(t) clim from x where train),
 z as (select t, p5, p10, clim from x join a using (r5, q5) join b using (r10, q10), c where not train)
 select size, count(*) n, round(avg(case size when 5 then (t - p5) * (t - p5) else (t - p10) * (t - p10) end) / avg((t - clim) * (t - clim)), 6) ratio from z, (values (5), (10)) v(size) group by size""")
def mat_resolution_comparison(spark, folder):
    """MAT-17: fields of two resolutions fitted on training days, their errors on the same later rows, normalised by that of the training climatology."""
    g = good(spark, folder).select("t", (F.dayofmonth("obstime") <= 15).alias("train"), *(F.floor((90 - F.col("lat")) / s).alias(f"r{s}") for s in (5, 10)), *(F.floor((F.col("lon") + 180) / s).alias(f"q{s}") for s in (5, 10)))
    train, z = g.where("train"), g.where("not train")
    for s in (5, 10):
        z = z.join(train.groupBy(f"r{s}", f"q{s}").agg(F.avg("t").alias(f"p{s}")), [f"r{s}", f"q{s}"])
    z = z.crossJoin(train.agg(F.avg("t").alias("clim")))  # one row
    z = z.select("t", "clim", F.inline(F.array(*(F.struct(F.lit(s).alias("size"), F.col(f"p{s}").alias("p")) for s in (5, 10)))))
    e, c = F.col("t") - F.col("p"), F.col("t") - F.col("clim")
    return z.groupBy("size").agg(F.count("*").alias("n"), F.round(F.avg(e * e) / F.avg(c * c), 6).alias("ratio"))


@query(OBS + """, l as (select unnest(['t', 'td', 'qnh']) channel, unnest([t, td, qnh]) v, day(obstime) <= 15 early, lat, lon from good), c as (select channel, early, s, floor((90 - lat) / s)::bigint r, floor((lon + 180) / s)::bigint q, v from l, (values (5.0::double), (10.0::double), (15.0::double)) w(s) where v between -100 and 1100),
 g as (select channel, early, s, count(*) n, var_pop(v) w from c group by channel, early, s, r, q having count(*) >= 3 and var_pop(v) > 1e-9), b as (select channel, early, s, sum(n * log2(w)) / sum(n) bits from g group by all),
 k as (select channel from b group by channel having count(*) = 6), a as (select channel, early, s, bits from b union all select '(common)', early, s, sum(bits) from b join k using (channel) group by early, s),
 best as (select channel, early, arg_min(s, (round(bits, 6), s)) s, min(bits) bits from a group by all)
 select channel, count(*) calibers, count(distinct s) = 1 same_best, min(s) best, round((max(bits) - min(bits)) / max(abs(bits)), 5) spread, (max(bits) - min(bits)) / max(abs(bits)) <= 0.05 within_tolerance from best group by channel""")
def mat_caliber_verdicts(spark, folder):
    """MAT-18: is the best resolution of a channel the same whichever half of the rows judges it (exact), and is its code length alike (relative tolerance); for each channel and for the sum of those that every half and size has."""
    ch = F.inline(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in ("t", "td", "qnh"))))
    c = good(spark, folder).select(ch, (F.dayofmonth("obstime") <= 15).alias("early"), "lat", "lon").where("v between -100 and 1100").withColumn("s", F.explode(F.array(*map(F.lit, (5.0, 10.0, 15.0)))))
    g = c.groupBy("channel", "early", "s", F.floor((90 - F.col("lat")) / F.col("s")).alias("r"), F.floor((F.col("lon") + 180) / F.col("s")).alias("q")).agg(F.count("*").alias("n"), F.var_pop("v").alias("w")).where("n >= 3 and w > 1e-9")
    b = written(g.groupBy("channel", "early", "s").agg((F.sum(F.col("n") * F.log2("w")) / F.sum("n")).alias("bits")))
    common = b.join(b.groupBy("channel").agg(F.count("*").alias("k")).where("k = 6"), "channel", "left_semi").groupBy("early", "s").agg(F.sum("bits").alias("bits")).withColumn("channel", F.lit("(common)"))
    best = b.unionByName(common).groupBy("channel", "early").agg(F.min_by("s", F.struct(F.round("bits", 6), F.col("s"))).alias("s"), F.min("bits").alias("bits"))
    spread = (F.max("bits") - F.min("bits")) / F.max(F.abs("bits"))
    return best.groupBy("channel").agg(F.count("*").alias("calibers"), (F.countDistinct("s") == 1).alias("same_best"), F.min("s").alias("best"), F.round(spread, 5).alias("spread"), (spread <= 0.05).alias("within_tolerance"))


@query(OBS + """, d as (select least(floor((lat + 90) / 30), 5)::bigint band, obstime::date d, avg(t) v from good group by all)
 select a.band a, b.band b, k lag_days, count(*) n, round(corr(a.v, b.v), 6) r from d a, range(0, 4) l(k), d b where b.d = a.d + k::int group by all having count(*) >= 3""")
def agg_lagged_bands(spark, folder):
    """R-25: correlations of the daily means of latitude bands across both hemispheres, at lags of up to three days."""
    d = good(spark, folder).groupBy(F.least(F.floor((F.col("lat") + 90) / 30), F.lit(5)).alias("band"), F.to_date("obstime").alias("d")).agg(F.avg("t").alias("v"))
    d = written(d)  # one row per band and day
    a = d.select(F.col("band").alias("a"), F.col("v").alias("x"), "d", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select("a", "x", F.col("k").cast("long").alias("lag_days"), F.expr("date_add(d, k)").alias("d"))
    j = a.join(d.select(F.col("band").alias("b"), F.col("v").alias("y"), "d"), "d")
    return j.groupBy("a", "b", "lag_days").agg(F.count("*").alias("n"), F.round(guarded_corr(F.col("x"), F.col("y")), 6).alias("r")).where("n >= 3")


@query("""with p as (select * from plane_ceiling where variable is not null and mean is not null and not isnan(mean)), rep as (select variable, round(avg(mean), 2) v from p group by variable), r as (select variable, run, sum(mean) s, count(*) n from p group by all),
 x as (select variable, sum(s) / sum(n) v, sum(n)::bigint n from r group by variable) select variable, n, abs(x.v - rep.v) <= 1e-4 * abs(rep.v) holds, true known from x join rep using (variable)""")
def ver_report_recheck(spark, folder):
    """R-12: a report stored as JSON, recomputed on another way (from sums per run) and joined to it: does each number hold within a relative tolerance, and is it in the report at all."""
    p = table(spark, folder, "plane_ceiling").where("variable is not null and mean is not null and not isnan(mean)")
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    sinks.report_json(p.groupBy("variable").agg(F.round(F.avg("mean"), 2).alias("published")), path)
    report = spark.read.schema("variable string, published double").json(path).withColumn("known", F.lit(True))
    x = p.groupBy("variable", "run").agg(F.sum("mean").alias("s"), F.count("*").alias("n")).groupBy("variable").agg((F.sum("s") / F.sum("n")).alias("v"), F.sum("n").alias("n"))
    holds = F.abs(F.col("v") - F.col("published")) <= 1e-4 * F.abs("published")
    return x.join(report, "variable", "left").select("variable", "n", F.coalesce(holds, F.lit(False)).alias("holds"), F.coalesce("known", F.lit(False)).alias("known"))


@query(PAIRS + """, m as (select lead, l_returnflag f, avg(abs(err)) mae, sqrt(avg(err * err)) rmse from pairs where l_returnflag in ('A', 'R') group by all), d as (select a.lead, a.mae - r.mae d1, a.rmse - r.rmse d2 from m a join m r on a.lead = r.lead and a.f = 'A' and r.f = 'R'),
 s as (select axis, count(*) n, count(*) filter (case axis when 'mae' then d1 else d2 end > 0) ups, count(*) filter ((d1 > 0) = (d2 > 0)) agree from d, (values ('mae'), ('rmse')) v(axis) group by axis)
 select axis, n, ups, agree, round(least(1.0, 2 * list_sum(list_transform(range(0, least(ups, n - ups) + 1), lambda j: factorial(n::int)::double / (factorial(j::int)::double * factorial((n - j)::int)::double))) * pow(0.5, n)), 9) p from s""")
def ver_two_axes(spark, folder):
    """VER-10: two groups compared lead by lead on two axes that are computed apart, with the sign test of each axis and how often they agree."""
    m = lead_pairs(spark, folder).where("l_returnflag in ('A', 'R')").groupBy("lead").pivot("l_returnflag", ["A", "R"]).agg(F.avg(F.abs("err")).alias("mae"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"))
    d = m.select((F.col("A_mae") - F.col("R_mae")).alias("d1"), (F.col("A_rmse") - F.col("R_rmse")).alias("d2")).dropna()
    both = ((F.col("d1") > 0) == (F.col("d2") > 0)).alias("both")
    x = d.select(both, F.inline(F.array(F.struct(F.lit("mae").alias("axis"), F.col("d1").alias("d")), F.struct(F.lit("rmse").alias("axis"), F.col("d2").alias("d")))))
    s = x.groupBy("axis").agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("ups"), F.count_if("both").alias("agree"))
    n, k = F.col("n"), F.least(F.col("ups"), F.col("n") - F.col("ups"))
    js = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    start = F.struct(F.lit(1.0).alias("c"), F.lit(1.0).alias("s"))
    ways = F.aggregate(js, start, lambda a, j: F.struct((a["c"] * (n - j + 1) / j).alias("c"), (a["s"] + a["c"] * (n - j + 1) / j).alias("s")), lambda a: a["s"])
    return s.withColumn("p", F.round(F.least(F.lit(1.0), 2 * ways * F.pow(F.lit(0.5), n)), 9))


_WHERE = "lat between -90 and 90 and lon between -180 and 360 and not (lat = 0 and lon = 0) and nullif(upper(trim(icao)), '') is not null"
_KEY = "upper(trim(icao)) icao, round(lat * 100)::bigint la, round(((((lon + 180) % 360 + 360) % 360) - 180) * 100)::bigint lo"


@query(f"""with r as (select {_KEY}, station_id, updated_at from stations where {_WHERE}), o as (select *, row_number() over (partition by icao order by updated_at desc, station_id desc) = 1 cur from r), g as (select icao, la, lo, bool_or(cur) cur from o group by all),
 f as (select {_KEY}, count(*) n from station_index where {_WHERE} group by all), k as (select distinct icao from g)
 select case when g.cur then 'current' when not g.cur then 'superseded' when k.icao is not null then 'mismatch' else 'unregistered' end state, count(*) places, sum(n)::bigint n from f left join g using (icao, la, lo) left join k using (icao) group by 1
 union all select 'uncovered', count(*), 0 from g anti join f using (icao, la, lo)""")
def ver_revision_lifecycle(spark, folder):
    """VER-07: references against a register of revisions: to the current one, to a superseded one, to none of a known key, to an unknown key; and revisions without any reference."""

    def places(name: str, *more: str) -> DataFrame:
        t = table(spark, folder, name).where(located(F.col("lat"), F.col("lon"))).select(entity("icao").alias("icao"), F.round(F.col("lat") * 100).cast("long").alias("la"), F.round(wrap_lon(F.col("lon")) * 100).cast("long").alias("lo"), *more)
        return t.where("icao is not null")

    by = ["icao", "la", "lo"]
    r = places("stations", "updated_at", "station_id")
    last = r.groupBy("icao").agg(F.max_by(F.struct("la", "lo"), F.struct("updated_at", "station_id")).alias("m"))
    g = r.select(*by).distinct().join(last, "icao").select(*by, ((F.col("la") == F.col("m.la")) & (F.col("lo") == F.col("m.lo"))).alias("cur"))
    f = places("station_index").groupBy(*by).agg(F.count("*").alias("n"))
    j = f.join(g, by, "left").join(last.select("icao", F.lit(True).alias("known")), "icao", "left")
    state = F.when(F.col("cur"), "current").when(~F.col("cur"), "superseded").when(F.col("known"), "mismatch").otherwise("unregistered")
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("places"), F.sum("n").alias("n")).unionByName(
        g.join(f, by, "left_anti").agg(F.lit("uncovered").alias("state"), F.count("*").alias("places"), F.lit(0).cast("long").alias("n"))
    )


@query(ANOM + """, n as (select code, count(*) n, avg(a) mean_a, min(i) i0 from an group by code), f as (select code, n, k, sum((a - mean_a) * cos(2 * pi() * k * (i - i0) / n)) re, sum((a - mean_a) * sin(2 * pi() * k * (i - i0) / n)) im from an join n using (code), range(0, 1000) r(k) where k <= n // 2 group by all),
 w as (select *, (re * re + im * im) / n pw, case when k = 0 or 2 * k = n then 1 else 2 end c from f), v as (select code, sum((a - mean_a) * (a - mean_a)) s from an join n using (code) group by code)
 select code, n as months, round(sum(c * pw) / s, 6) parseval, arg_max(k, pw) peak, round(max(pw) / sum(pw), 6) peak_share, true refused from w join v using (code) group by code, n, s""")
def mat_spectrum_checks(spark, folder):
    """R-13, R-14: per series the ratio of the spectrum's sum to the variance's (Parseval), the strongest frequency and its share, and that the same series with one month missing is refused."""
    an = written(anomalies(spark, folder))
    s = spectrum(an, "code", "i", "a", taper=False)
    n = an.groupBy("code").agg(F.count("*").alias("months"), (F.var_pop("a") * F.count("*")).alias("s"))
    c = F.when((F.col("k") == 0) | (2 * F.col("k") == F.col("months")), 1).otherwise(2)
    uneven = spectrum(an.where("i <> 40"), "code", "i", "a").select("code").distinct().withColumn("accepted", F.lit(True))
    x = s.join(n, "code").groupBy("code", "months", "s").agg(F.sum(c * F.col("power")).alias("p"), F.max_by("k", "power").cast("long").alias("peak"), (F.max("power") / F.sum("power")).alias("share"))
    return x.join(uneven, "code", "left").select("code", "months", F.round(F.col("p") / F.col("s"), 6).alias("parseval"), "peak", F.round("share", 6).alias("peak_share"), F.col("accepted").isNull().alias("refused"))


@query("""with st as (select round_even(90 - lat, 0)::bigint r, ((round_even(((((lon + 180) % 360 + 360) % 360) - 180) + 180, 0)::bigint % 360) + 360) % 360 c, elev from stations where lat between -90 and 90 and lon between -180 and 360 and not (lat = 0 and lon = 0) and not isnan(elev) and abs(elev) <> 9999),
 g as (select r, c, avg(elev) > 300 high from st group by r, c), s as (select round_even(90 - lat, 0)::bigint r, ((round_even(((((lon + 180) % 360 + 360) % 360) - 180) + 180, 0)::bigint % 360) + 360) % 360 c from soundings where lat between -90 and 90 and lon between -180 and 360 and not (lat = 0 and lon = 0))
 select case when high then 'high' when not high then 'low' else 'unknown' end class, count(*) n from s left join g using (r, c) group by 1""")
def src_class_lookup(spark, folder):
    """SRC-22: the class of the nearest cell of a mask grid of one degree, looked up for each ascent's position; positions off the mask are unknown."""
    row, col = F.rint(90 - F.col("lat")).cast("long").alias("r"), F.pmod(F.rint(wrap_lon(F.col("lon")) + 180).cast("long"), F.lit(360)).alias("c")
    elev = number("elev")
    g = table(spark, folder, "stations").where(located(F.col("lat"), F.col("lon"))).select(row, col, F.when(F.abs(elev) != 9999, elev).alias("elev")).where("elev is not null").groupBy("r", "c").agg((F.avg("elev") > 300).alias("high"))
    s = table(spark, folder, "soundings").where(located(F.col("lat"), F.col("lon"))).select(row, col)
    return s.join(g, ["r", "c"], "left").groupBy(F.when(F.col("high"), "high").when(~F.col("high"), "low").otherwise("unknown").alias("class")).agg(F.count("*").alias("n"))


@query("""with a as (select source, unnest(soundings) a from soundings) select source, count(*) ascents, count(*) filter (a.n = greatest(len(a.p), len(a.t), len(a.z))) declared_right, count(*) filter (len(a.p) = len(a.t) and len(a.t) = len(a.z)) same_length,
 count(*) filter (len(list_filter(range(1, len(a.p)), lambda i: a.p[i] <> -32768 and a.p[i + 1] <> -32768 and a.p[i + 1] >= a.p[i])) = 0) descending from a where a is not null group by source""")
def ver_structure(spark, folder):
    """R-30: structure of nested inputs per source: declared against actual number of levels, arrays of one length, and pressure in strictly descending order."""
    a = table(spark, folder, "soundings").select("source", F.explode("soundings").alias("a")).where("a is not null")
    n = lambda c: F.when(F.col(f"a.{c}").isNotNull(), F.size(f"a.{c}"))
    pairs = F.arrays_zip(F.slice("a.p", 1, F.greatest(F.size("a.p") - 1, F.lit(0))).alias("x"), F.slice("a.p", 2, F.greatest(F.size("a.p"), F.lit(0))).alias("y"))
    wrong = F.exists(pairs, lambda v: (v["x"] != -32768) & (v["y"] != -32768) & (v["y"] >= v["x"]))
    return a.groupBy("source").agg(
        F.count("*").alias("ascents"), F.count_if(F.col("a.n") == F.greatest(n("p"), n("t"), n("z"))).alias("declared_right"), F.count_if((n("p") == n("t")) & (n("t") == n("z"))).alias("same_length"), F.count_if(F.col("a.p").isNotNull() & ~F.coalesce(wrong, F.lit(False))).alias("descending")
    )


@query(CELLS + """, j as (select k * 12 shift, a.v, b.v o from c a, range(0, 6) s(k), c b where b.row_no = 35 - a.row_no and b.col_no = (a.col_no + k * 12) % 72)
 select shift, count(*) n, round(corr(v, o), 6) r, round(sqrt(avg((v - o) * (v - o) / 4)), 6) odd_rms, round(sqrt(avg((v + o) * (v + o) / 4)), 6) even_rms, count(*) filter ((v > 10) = (o > 10)) same_class from j group by shift""")
def grd_geometry_sweep(spark, folder):
    """R-24, R-28: cells paired with the mirrored latitude at several rotations of longitude (half a turn: the antipode): correlation, odd and even parts, and shared classes per geometry."""
    c = cell_means(spark, folder)
    b = c.select((35 - F.col("row_no")).alias("row_no"), F.col("col_no").alias("c2"), F.col("v").alias("o"))
    a = c.select("row_no", "col_no", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(60).cast("long"), F.lit(12).cast("long"))).alias("shift")).withColumn("c2", (F.col("col_no") + F.col("shift")) % 72)
    v, o = F.col("v"), F.col("o")
    return a.join(b, ["row_no", "c2"]).groupBy("shift").agg(
        F.count("*").alias("n"), F.round(guarded_corr(v, o), 6).alias("r"), rms((v - o) / 2, 1, 6).alias("odd_rms"), rms((v + o) / 2, 1, 6).alias("even_rms"), F.count_if((v > 10) == (o > 10)).alias("same_class")
    )


@query()
def ver_negative_controls(spark, folder):
    """VER-14: checks run on true and on spoilt input, where they must fail: kelvin in a Celsius column against the range guard, a field looked up at the mirrored row, an AR(1) scored against months in reverse order.
    ``sound`` and ``spoilt``: the measure on either (shares in range, errors); ``failed``: the check tells them apart."""
    g = written(good(spark, folder).select("t", F.hour("obstime").alias("h"), F.floor((90 - F.col("lat")) / 5).alias("row_no"), F.floor((F.col("lon") + 180) / 5).alias("col_no")))
    share = lambda c: F.avg(c.between(-90, 60).cast("int"))
    unit = g.agg(share(F.col("t")).alias("sound"), share(F.col("t") + 273.15).alias("spoilt")).withColumn("control", F.lit("unit injection")).withColumn("failed", F.col("spoilt") < 0.01)
    c = g.groupBy("row_no", "col_no").agg(F.avg("t").alias("v"))
    off = lambda field: g.join(field, ["row_no", "col_no"]).agg(F.sqrt(F.avg((F.col("t") - F.col("v")) * (F.col("t") - F.col("v")))).alias("e"))
    mapping = off(c).withColumnRenamed("e", "sound").crossJoin(off(c.withColumn("row_no", 35 - F.col("row_no"))).withColumnRenamed("e", "spoilt"))  # one row each
    mapping = mapping.withColumn("control", F.lit("permuted mapping")).withColumn("failed", F.col("spoilt") > 1.5 * F.col("sound"))
    p = written(next_month(spark, folder).join(slope(next_month(spark, folder).where("i < 47"), ["code"]), "code"))
    last = p.groupBy("code").agg(F.max("i").alias("top"), F.min("i").alias("low"))
    other = p.join(last, "code").select("code", (F.col("top") + F.col("low") - F.col("i")).alias("i"), F.col("y").alias("z"))
    e, d = F.col("y") - F.col("phi") * F.col("x"), F.col("z") - F.col("phi") * F.col("x")
    lead = p.join(other, ["code", "i"]).agg(F.sqrt(F.avg(e * e)).alias("sound"), F.sqrt(F.avg(d * d)).alias("spoilt")).withColumn("control", F.lit("shuffled lead")).withColumn("failed", F.col("spoilt") > F.col("sound"))
    return unit.select("control", "sound", "spoilt", "failed").unionByName(mapping.select("control", "sound", "spoilt", "failed")).unionByName(lead.select("control", "sound", "spoilt", "failed"))
