"""Forecast against observation: lead-time skill, bias by band, representativeness, joins in time and place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..operators.joins import asof_backward, asof_nearest, interval_join, pairs_in_group
from ..operators.stats import banded, contingency, error_summary, exact_percentiles, gated, guarded_corr, index_percentiles, ols2, pooled, threshold_sweep, with_percentiles
from ..session import written
from ..tables import entity, number, table
from .registry import registry

HOUR = 3_600_000_000

QUERIES, ORACLE, query = registry()


# --- lead-time skill: orders are runs, line items what came of them

PAIRS = """with pairs as (select o_orderpriority run, l_suppkey, l_returnflag, date_trunc('month', o_orderdate) valid_month,
 date_diff('day', o_orderdate::date, l_shipdate::date) // 7 lead, l_extendedprice - l_quantity * p_retailprice err
 from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
 where date_diff('day', o_orderdate::date, l_shipdate::date) between 0 and 180)"""


def lead_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """JOIN-04, PRJ-09: run and observation pairs with 0 <= lead <= 180 days, an equality join with a lead filter."""
    li, o, p = (table(spark, folder, n) for n in ("lineitem", "orders", "part"))
    lead = F.datediff("l_shipdate", "o_orderdate")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"]).where(lead.between(0, 180))
    return j.select(F.col("o_orderpriority").alias("run"), "l_suppkey", "l_returnflag", F.trunc("o_orderdate", "month").alias("valid_month"), F.floor(lead / 7).alias("lead"),
                    (F.col("l_extendedprice") - F.col("l_quantity") * F.col("p_retailprice")).alias("err"))


def per_run(spark: SparkSession, folder: str) -> DataFrame:
    return error_summary(lead_pairs(spark, folder), ["run", "lead"], "err", population=False, digits=7)


RUNS = PAIRS + """, runs as (select run, lead, count(err) n, round(median(err), 7) median_bias, round(avg(err), 7) mean_bias, round(avg(abs(err)), 7) mae,
 round(sqrt(avg(err * err)), 7) rmse, round(stddev_samp(err), 7) sd_samp from pairs group by run, lead)"""


@query(RUNS + " select * from runs")
def lead_skill_per_run(spark, folder):
    """AGG-02, AGG-03: n, median, MAE, RMSE and sample sd per run and lead."""
    return per_run(spark, folder)


CURVE = RUNS + """, curve as (select lead, count(*) runs, sum(n)::bigint n, round(sum(median_bias * n) / sum(n), 3) median_bias, round(sum(mae * n) / sum(n), 3) mae from runs group by lead)"""


@query(CURVE + " select lead, runs, n, case when n >= 30 then median_bias end median_bias, case when n >= 30 then mae end mae, case when n >= 30 then 'ok' else 'insufficient' end state from curve")
def lead_skill_curve(spark, folder):
    """AGG-04, FLT-09: the n-weighted curve over runs with its least number of pairs."""
    return gated(pooled(per_run(spark, folder), ["lead"], "n", ["median_bias", "mae"], 3), "n", 30, ["median_bias", "mae"])


@query(CURVE + """, f as (select lead, mae, lag(mae) over (order by lead) before from curve where n >= 30)
 select count(*) leads, bool_and(before is null or mae >= before) monotone, count(*) >= 3 judged from f""")
def lead_monotone_verdict(spark, folder):
    """WIN-14: is the error non-decreasing with lead, over at least three leads."""
    c = pooled(per_run(spark, folder), ["lead"], "n", ["mae"], 3).where("n >= 30")
    before = F.lag("mae").over(Window.orderBy("lead"))  # one row per lead
    return c.select("mae", before.alias("before")).agg(F.count("*").alias("leads"), F.bool_and(F.col("before").isNull() | (F.col("mae") >= F.col("before"))).alias("monotone"), (F.count("*") >= 3).alias("judged"))


@query(PAIRS + """, m as (select valid_month, lead, avg(abs(err)) mae, count(*) n from pairs group by 1, 2)
 select strftime(valid_month, '%Y-%m') valid_month, count(*) leads, round(arg_max(mae, lead) - arg_min(mae, lead), 4) growth from m group by valid_month having count(*) >= 2""")
def lead_paired_growth(spark, folder):
    """AGG-03: per valid month with at least two leads, the error of the longest less that of the shortest."""
    m = lead_pairs(spark, folder).groupBy("valid_month", "lead").agg(F.avg(F.abs("err")).alias("mae"))
    g = m.groupBy("valid_month").agg(F.count("*").alias("leads"), F.round(F.max_by("mae", "lead") - F.min_by("mae", "lead"), 4).alias("growth"))
    return g.where("leads >= 2").withColumn("valid_month", F.date_format("valid_month", "yyyy-MM"))


@query(PAIRS + """, t as (select l_returnflag tier, lead, avg(abs(err)) mae from pairs group by 1, 2),
 shared as (select lead from t group by lead having count(distinct tier) = (select count(distinct tier) from t))
 select tier, count(*) leads, round(avg(mae), 4) mae from t join shared using (lead) group by tier""")
def tier_penalty(spark, folder):
    """SET-02: tiers compared over the leads they share only."""
    t = lead_pairs(spark, folder).groupBy(F.col("l_returnflag").alias("tier"), "lead").agg(F.avg(F.abs("err")).alias("mae"))
    tiers = t.agg(F.countDistinct("tier").alias("k"))
    shared = t.groupBy("lead").agg(F.countDistinct("tier").alias("n")).join(F.broadcast(tiers), F.col("n") == F.col("k")).select("lead")
    return t.join(shared, "lead").groupBy("tier").agg(F.count("*").alias("leads"), F.round(F.avg("mae"), 4).alias("mae"))


@query(PAIRS + " select run, lead, count(distinct l_suppkey) suppliers, count(*) n from pairs group by run, lead")
def lead_distinct_sources(spark, folder):
    """AGG-03: distinct stations behind each statistic."""
    return lead_pairs(spark, folder).groupBy("run", "lead").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.count("*").alias("n"))


# --- stations and cells

OBS = """with obs as (select obs_id, upper(trim(icao)) icao, lat, case when lon >= 180 then lon - 360 else lon end lon, case when isnan(elev) or abs(elev) = 9999 then null else elev end elev,
 obstime, case when isnan(t) or t < -90 or t > 60 then null else t end t, case when isnan(td) then null else td end td, qnh, ws, wd, vis from station_index),
 good as (select * from obs where icao <> '' and t is not null and lat between -90 and 90 and lon between -180 and 180)"""


def good(spark: SparkSession, folder: str) -> DataFrame:
    """Station rows with a code, a position and a possible t; elev without fillers; one longitude convention."""
    s = table(spark, folder, "station_index")
    elev = number("elev")
    t = number("t")
    return s.select(
        "obs_id", entity("icao").alias("icao"), "lat", F.when(F.col("lon") >= 180, F.col("lon") - 360).otherwise(F.col("lon")).alias("lon"), F.when(F.abs(elev) != 9999, elev).alias("elev"),
        "obstime", F.when(t.between(-90, 60), t).alias("t"), number("td").alias("td"), "qnh", "ws", "wd", "vis",
    ).where("icao is not null and t is not null and lat between -90 and 90 and lon between -180 and 180")


CELL = "floor((90 - lat) / 5)::bigint row_no, floor((lon + 180) / 5)::bigint col_no"


def with_cell(df: DataFrame, size: float = 5.0) -> DataFrame:
    """PRJ-06: cells by floor."""
    return df.withColumn("row_no", F.floor((90 - F.col("lat")) / size)).withColumn("col_no", F.floor((F.col("lon") + 180) / size))


FIELD = OBS + f", field as (select {CELL}, hour(obstime) hour_no, avg(t) model from good group by all), err as (select g.*, f.model, f.model - g.t e from (select *, {CELL}, hour(obstime) hour_no from good) g join field f using (row_no, col_no, hour_no))"


def against_field(spark: SparkSession, folder: str) -> DataFrame:
    """JOIN-01: observations joined to the value of their cell and hour by equality; ``e`` is model less observation."""
    g = with_cell(good(spark, folder)).withColumn("hour_no", F.hour("obstime"))
    field = g.groupBy("row_no", "col_no", "hour_no").agg(F.avg("t").alias("model"))
    return g.join(field, ["row_no", "col_no", "hour_no"]).withColumn("e", F.col("model") - F.col("t"))


BAND = "case when elev < 100 then 0 when elev < 500 then 1 when elev < 1500 then 2 when elev is not null then 3 end"


@query(FIELD + f""", b as (select {BAND} band, e from err)
 select coalesce(band, -1) band, grouping(band) is_all, count(e) n, round(median(e), 5) median_bias, round(avg(e), 5) mean_bias, round(stddev_pop(e), 5) sd_pop from b where band is not null group by grouping sets ((band), ())""")
def band_bias_grouping_sets(spark, folder):
    """FLT-04, AGG-01, AGG-32: bias per half-open elevation band and over all."""
    b = against_field(spark, folder).select(banded(F.col("elev"), [100, 500, 1500]), "e").where("band is not null")
    b = written(b)
    g = b.groupingSets([[F.col("band")], []], F.col("band"))
    g = g.agg(F.grouping("band").cast("int").alias("is_all"), F.count("e").alias("n"), F.round(F.avg("e"), 5).alias("mean_bias"), F.round(F.stddev_pop("e"), 5).alias("sd_pop"))
    both = b.select(F.inline(F.array(F.struct("band", F.lit(0).alias("is_all")), F.struct(F.lit(None).cast("int").alias("band"), F.lit(1).alias("is_all")))), "e")
    g = with_percentiles(g, exact_percentiles(both, ["band", "is_all"], {"median_bias": ("e", 0.5)}), ["band", "is_all"])
    return g.withColumn("median_bias", F.round("median_bias", 5)).withColumn("band", F.coalesce("band", F.lit(-1)))


@query(FIELD + """ select row_no, count(e) n, round(median(e), 5) median_bias, round(avg(e), 5) + 0.0 mean_bias, round(avg(abs(e)), 5) mae, round(sqrt(avg(e * e)), 5) rmse, round(stddev_pop(e), 5) sd_pop from err group by row_no""")
def cell_row_bias(spark, folder):
    """AGG-01: bias summary per grid row with the population sd."""
    return error_summary(against_field(spark, folder), ["row_no"], "e", digits=5)


@query(OBS + """, n as (select obs_id, least(greatest(round_even((90 - lat) / 2.5, 0), 0), 72)::bigint row_no, ((round_even((lon + 180) / 2.5, 0)::bigint % 144) + 144) % 144 col_no from good)
 select row_no, col_no, count(*) n from n group by all""")
def nearest_cells_wrapped(spark, folder):
    """PRJ-07: the nearest cell by half-even rounding; columns wrap, rows are clipped."""
    g = good(spark, folder)
    row = F.least(F.greatest(F.rint((90 - F.col("lat")) / 2.5), F.lit(0)), F.lit(72)).cast("long")
    return g.groupBy(row.alias("row_no"), F.pmod(F.rint((F.col("lon") + 180) / 2.5).cast("long"), F.lit(144)).alias("col_no")).agg(F.count("*").alias("n"))


@query(OBS + """ select round_even((60 - lat) / 2.5, 0)::bigint row_no, round_even((lon + 100) / 2.5, 0)::bigint col_no, count(*) n from good
 where round_even((60 - lat) / 2.5, 0) between 0 and 47 and round_even((lon + 100) / 2.5, 0) between 0 and 79 group by all""")
def nearest_cells_dropped(spark, folder):
    """PRJ-08: the nearest cell of a limited grid; rows outside are dropped, nothing wraps."""
    g = good(spark, folder).select(F.rint((60 - F.col("lat")) / 2.5).cast("long").alias("row_no"), F.rint((F.col("lon") + 100) / 2.5).cast("long").alias("col_no"))
    return g.where("row_no between 0 and 47 and col_no between 0 and 79").groupBy("row_no", "col_no").agg(F.count("*").alias("n"))


LAST = """, last as (select * from (select *, row_number() over (partition by icao, date_trunc('hour', obstime) order by obstime desc, obs_id desc) rn from good) where rn = 1)"""


def last_per_hour(spark: SparkSession, folder: str) -> DataFrame:
    """WIN-13: the last row of a station and hour, by time then id; the aggregate needs no sort of a station."""
    g = with_cell(good(spark, folder)).withColumn("hour", F.date_trunc("hour", "obstime"))
    cols = ["obs_id", "icao", "lat", "lon", "elev", "t", "td", "row_no", "col_no"]
    return g.groupBy(F.col("icao").alias("_i"), "hour").agg(F.max_by(F.struct(*cols), F.struct("obstime", "obs_id")).alias("r")).select("hour", "r.*")


SPREAD = OBS + LAST + f", spread as (select {CELL}, date_trunc('hour', obstime) h, count(*) n, max(t) - min(t) spread from last group by all having count(*) >= 2)"


@query(SPREAD + " select count(*) cells, round(median(spread), 6) median_spread, round(quantile_cont(spread, 0.9), 6) p90, round(avg((spread > 2)::int), 6) over_2 from spread")
def cell_spread(spark, folder):
    """AGG-07, AGG-05: the spread of t within a cell and hour, and its share over 2 K."""
    s = last_per_hour(spark, folder).groupBy("row_no", "col_no", "hour").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("spread")).where("n >= 2")
    s = written(s.select("spread"))
    one = with_percentiles(s.agg(F.count("*").alias("cells"), F.round(F.avg((F.col("spread") > 2).cast("int")), 6).alias("over_2")), exact_percentiles(s, [], {"median_spread": ("spread", 0.5), "p90": ("spread", 0.9)}), [])
    return one.select("cells", F.round("median_spread", 6).alias("median_spread"), F.round("p90", 6).alias("p90"), "over_2")


PAIRED = OBS + LAST + f""", l as (select {CELL}, date_trunc('hour', obstime) h, icao, lat, lon, t, elev from last),
 pr as (select a.icao a, b.icao b, a.t - b.t d, a.elev - b.elev de, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) km
 from l a join l b on a.row_no = b.row_no and a.col_no = b.col_no and a.h = b.h and a.icao < b.icao)"""


def cell_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """JOIN-05: pairs of stations within a cell and hour, one row per station there."""
    p = pairs_in_group(last_per_hour(spark, folder), ["row_no", "col_no", "hour"], "icao", ["t", "elev", "lat", "lon"])
    return p.withColumn("d", F.col("t_a") - F.col("t_b")).withColumn("km", haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")))


@query(PAIRED + """ select (km // 100)::bigint band, count(*) n, count(distinct a || '|' || b) pairs, round(sqrt(greatest(var_samp(d) / 2 - 0.25, 0)), 5) representativeness from pr group by 1 having count(*) >= 2""")
def cell_pairs_representativeness(spark, folder):
    """AGG-17, FN-03, AGG-30: half the variance of differences less the instrument's, by distance; pair observations and distinct pairs."""
    g = cell_pairs(spark, folder).groupBy(F.floor(F.col("km") / 100).alias("band"))
    s = g.agg(F.count("*").alias("n"), F.countDistinct("key_a", "key_b").alias("pairs"), F.round(F.sqrt(F.greatest(F.var_samp("d") / 2 - 0.25, F.lit(0.0))), 5).alias("representativeness"))
    return s.where("n >= 2")


@query(PAIRED + """, o as (select d y, abs(de) x0, km x1 from pr where d is not null and de is not null and km is not null),
 s as (select count(*) n, sum(y) sy, sum(x0) s0, sum(x1) s1, sum(x0*x0) s00, sum(x0*x1) s01, sum(x1*x1) s11, sum(x0*y) sy0, sum(x1*y) sy1 from o),
 c as (select *, s00-s0*s0/n a00, s01-s0*s1/n a01, s11-s1*s1/n a11, sy0-sy*s0/n g0, sy1-sy*s1/n g1 from s)
, b as (select *, case when a00*a11-a01*a01 > 1e-9*a00*a11 then (g0*a11-g1*a01)/(a00*a11-a01*a01) end b1, case when a00*a11-a01*a01 > 1e-9*a00*a11 then (g1*a00-g0*a01)/(a00*a11-a01*a01) end b2 from c)
 select n, round((sy - b1*s0 - b2*s1)/n, 5) b0, round(b1, 5) b1, round(b2, 5) b2 from b""")
def separation_ols2(spark, folder):
    """AGG-16: the difference of a pair regressed on separation in height and distance."""
    p = cell_pairs(spark, folder).select("d", F.abs(F.col("elev_a") - F.col("elev_b")).alias("de"), "km")
    return ols2(p, [], "d", "de", "km", 5)


@query(FIELD + """ select k, round(avg((abs(e) < k * 0.5)::int), 6) instrument, round(avg((abs(e) < k * 1.0)::int), 6) cell, round(avg((abs(e) < k * sqrt(0.25 + 1.0))::int), 6) both_errors from err, (values (1), (2), (3)) v(k) group by k""")
def sigma_share(spark, folder):
    """AGG-19: the share of errors strictly within k sigma under three error standards."""
    e = against_field(spark, folder).select("e", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))
    share = lambda s: F.round(F.avg((F.abs("e") < F.col("k") * s).cast("int")), 6)
    return e.groupBy("k").agg(share(0.5).alias("instrument"), share(1.0).alias("cell"), share(1.25**0.5).alias("both_errors"))


@query(FIELD + """ select icao, count(e) n, case when count(e) >= 20 then round(sqrt(avg(e * e)), 5) end rmse, case when count(e) >= 20 then 'ok' else 'insufficient' end state from err group by icao""")
def station_rmse_gated(spark, folder):
    """FLT-09: stations with too few pairs stay, without a value."""
    s = against_field(spark, folder).groupBy("icao").agg(F.count("e").alias("n"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 5).alias("rmse"))
    return gated(s, "n", 20, ["rmse"])


@query(FIELD + """ select hour_no, count(*) n, round(avg(e), 5) + 0.0 mean, round(median(e), 5) + 0.0 median, round(stddev_pop(e), 5) sd, round(median(abs(e)), 5) median_abs, round(quantile_cont(abs(e), 0.95), 5) p95_abs, round(max(abs(e)), 5) max_abs, round(avg((abs(e) < 1)::int), 5) within_1 from err group by hour_no""")
def column_error_stats(spark, folder):
    """AGG-27: signed and absolute statistics of a comparison."""
    e = F.col("e")
    x = written(against_field(spark, folder).select("hour_no", "e", F.abs("e").alias("size")))
    sums = x.groupBy("hour_no").agg(
        F.count("*").alias("n"), F.round(F.avg(e), 5).alias("mean"), F.round(F.stddev_pop(e), 5).alias("sd"), F.round(F.max("size"), 5).alias("max_abs"), F.round(F.avg((F.col("size") < 1).cast("int")), 5).alias("within_1")
    )
    names = {"median": ("e", 0.5), "median_abs": ("size", 0.5), "p95_abs": ("size", 0.95)}
    return with_percentiles(sums, exact_percentiles(x, ["hour_no"], names), ["hour_no"]).select(*sums.columns, *(F.round(c, 5).alias(c) for c in names))


@query(FIELD + " select row_no, count(*) n, round(avg((model >= 10 and t >= 10)::int), 6) share_both, round(avg((model >= 10 and not t >= 10)::int), 6) share_a_only, round(avg((not model >= 10 and t >= 10)::int), 6) share_b_only, round(sum((model >= 10 and t >= 10)::int) / nullif(sum((t >= 10)::int), 0), 6) hit_rate from err group by row_no")
def contingency_shares(spark, folder):
    """AGG-12: shares of both, model only and observation only over a threshold, and the hit rate."""
    return contingency(against_field(spark, folder), ["row_no"], F.col("model") >= 10, F.col("t") >= 10)


@query(FIELD + """ select th threshold, count(*) filter (model >= th) flagged, count(*) filter (model >= th and t >= 15) hits, count(*) filter (model >= th and t < 15) false_alarms, count(*) filter (model < th and t >= 15) misses,
 round(count(*) filter (model >= th and t >= 15) / nullif(count(*) filter (model >= th), 0), 6) as "precision", round(count(*) filter (model >= th and t >= 15) / nullif(count(*) filter (t >= 15), 0), 6) recall
 from err, (values (0.0::double), (5.0::double), (10.0::double), (15.0::double), (20.0::double)) v(th) group by th""")
def warning_threshold_sweep(spark, folder):
    """AGG-13: flagged, hits, false alarms and misses over thresholds."""
    return threshold_sweep(against_field(spark, folder), [], "model", F.col("t") >= 15, [0.0, 5.0, 10.0, 15.0, 20.0])


@query(FIELD + """ select th_m model_threshold, th_o obs_threshold, count(*) filter (model >= th_m and t >= th_o) hits, round(count(*) filter (model >= th_m and t >= th_o) / nullif(count(*) filter (t >= th_o), 0), 6) hit_rate
 from err, (values (5.0::double), (10.0::double)) a(th_m), (values (5.0::double), (10.0::double)) b(th_o) group by all""")
def both_thresholds_sweep(spark, folder):
    """AGG-13: both thresholds swept."""
    th = lambda n: F.explode(F.array(F.lit(5.0), F.lit(10.0))).alias(n)
    x = against_field(spark, folder).select("model", "t", th("model_threshold")).select("*", th("obs_threshold"))
    obs = F.col("t") >= F.col("obs_threshold")
    hit = F.count(F.when(obs & (F.col("model") >= F.col("model_threshold")), 1))
    return x.groupBy("model_threshold", "obs_threshold").agg(hit.alias("hits"), F.round(F.try_divide(hit, F.count(F.when(obs, 1))), 6).alias("hit_rate"))


@query(FIELD + """ select icao, count(*) filter (t is not null and model is not null) n, case when count(*) >= 3 and stddev_pop(t) > 0 and stddev_pop(model) > 0 then round(covar_pop(model, t) / (stddev_pop(model) * stddev_pop(t)), 5) end r from err group by icao having count(*) >= 5""")
def station_guarded_corr(spark, folder):
    """AGG-14: Pearson per station, null without variance."""
    return against_field(spark, folder).groupBy("icao").agg(F.count("*").alias("n"), F.round(guarded_corr(F.col("model"), F.col("t")), 5).alias("r")).where("n >= 5")


# --- joins in time

EV = "with v as (select * from events where event_type = 'view'), p as (select * from events where event_type = 'purchase')"


def two_streams(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return e.where("event_type = 'view'").withColumnRenamed("event_id", "view_id"), e.where("event_type = 'purchase'").withColumnRenamed("event_id", "purchase_id")


@query(EV + """ select view_id, purchase_id, distance from (select v.event_id view_id, p.event_id purchase_id, abs(epoch_us(p.ts) - epoch_us(v.ts)) distance,
 row_number() over (partition by v.event_id order by abs(epoch_us(p.ts) - epoch_us(v.ts)), p.ts, p.event_id) rn from v join p on v.user_id = p.user_id and abs(epoch_us(p.ts) - epoch_us(v.ts)) <= 21600000000) where rn = 1""")
def join_asof_nearest(spark, folder):
    """JOIN-02: view and purchase of a user nearest in time, within six hours."""
    v, p = two_streams(spark, folder)
    return asof_nearest(v, p, "view_id", "purchase_id", "user_id", "us", 6 * HOUR)


@query(EV + " select v.event_id view_id, (select arg_max(p.event_id, (p.ts, p.event_id)) from p where p.user_id = v.user_id and p.ts <= v.ts) purchase_id from v")
def join_asof_backward(spark, folder):
    """JOIN-02, backward: the last purchase at or before a view."""
    v, p = two_streams(spark, folder)
    return asof_backward(v, p, "view_id", "purchase_id", "user_id", "us", 24 * HOUR)


@query("""with f as (select event_type, date_trunc('hour', ts) h, avg(value) model from events group by all)
 select event_id, round(model - value, 6) d from events e join f on e.event_type = f.event_type and date_trunc('hour', e.ts) = f.h""")
def join_exact_time(spark, folder):
    """JOIN-03: observations joined to the field of their hour by equality."""
    e = table(spark, folder, "events").withColumn("h", F.date_trunc("hour", "ts"))
    f = e.groupBy("event_type", "h").agg(F.avg("value").alias("model"))
    return e.join(f, ["event_type", "h"]).select("event_id", F.round(F.col("model") - F.col("value"), 6).alias("d"))


@query("""with d as (select distinct date_diff('day', date '1970-01-01', ts::date) day_no from events), o as (select o_orderkey, date_diff('day', date '1970-01-01', o_orderdate::date) % 60 + 19690 lo from orders)
 select day_no, count(*) n from d join o on day_no between lo and lo + 20 group by day_no""")
def join_interval_binned(spark, folder):
    """JOIN-04: spans that hold a day, by bins."""
    d = table(spark, folder, "events").select(F.unix_date(F.to_date("ts")).alias("day_no")).distinct()
    o = table(spark, folder, "orders").select("o_orderkey", (F.unix_date(F.to_date("o_orderdate")) % 60 + 19690).alias("lo")).withColumn("hi", F.col("lo") + 20)
    return interval_join(d, "day_no", o, "lo", "hi", 32).groupBy("day_no").agg(F.count("*").alias("n"))


@query("""with u as (select event_type, value, count(*) over (partition by event_type) n, row_number() over (partition by event_type order by value) rn from events)
 select event_type, max(n) n, max(value) filter (rn = floor(n * 0.9) + 1) p90_index, max(value) filter (rn = floor(n * 0.5) + 1) upper_median, max(value) filter (rn = floor(n * 0.05) + 1) p05_index from u group by event_type""")
def percentiles_index(spark, folder):
    """AGG-06: index percentiles."""
    return index_percentiles(table(spark, folder, "events"), ["event_type"], "value", {"p90_index": 0.9, "upper_median": 0.5, "p05_index": 0.05})


@query("select event_type, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.9), 6) p90, round(quantile_cont(value, 0.95), 6) p95 from events group by event_type")
def percentiles_linear(spark, folder):
    """AGG-05: interpolated percentiles."""
    names = {"p50": 0.5, "p90": 0.9, "p95": 0.95}
    p = exact_percentiles(table(spark, folder, "events"), ["event_type"], {n: ("value", q) for n, q in names.items()})
    return p.select("event_type", *(F.round(n, 6).alias(n) for n in names))
