"""Aggregates, windows over sequences, and grids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..operators.grid import axis_weights, components, local_maxima, offset_field, regridded
from ..operators.stats import banded, exact_percentiles, guarded_corr, weighted_mean, with_percentiles
from ..operators.windows import detrended, islands, longest_run, neighbours, running_total, seasonal_anomaly, uniform_filter
from ..session import written
from ..tables import entity, table
from .columns import LEVELS, levels
from .registry import registry
from .verification import CELL, FIELD, OBS, against_field, good, with_cell

QUERIES, ORACLE, query = registry()

# --- aggregates


@query(OBS + """, h as (select icao, date_trunc('hour', obstime) h, avg(t) t from good group by all), d as (select icao, h::date d, avg(t) t, count(*) n_hours, list_sort(list_filter([0, 6, 12, 18], lambda x: not list_contains(list(hour(h)), x))) missing from h group by all)
 select icao, strftime(date_trunc('month', d), '%Y-%m') "month", round(avg(t), 5) mean_of_means, count(*) n_days, sum((len(missing) = 0)::int)::bigint complete_days, sum(n_hours)::bigint n_hours from d group by all""")
def agg_daily_then_monthly(spark, folder):
    """AGG-08: mean of daily means, with complete days by synoptic hours; missing hours are reported, not filled."""
    h = good(spark, folder).groupBy("icao", F.date_trunc("hour", "obstime").alias("h")).agg(F.avg("t").alias("t"))
    missing = F.array_except(F.array(*map(F.lit, (0, 6, 12, 18))), F.collect_set(F.hour("h")))
    d = h.groupBy("icao", F.to_date("h").alias("d")).agg(F.avg("t").alias("t"), F.count("*").alias("hours"), F.size(missing).alias("missing"))
    m = d.groupBy("icao", F.date_format("d", "yyyy-MM").alias("month"))
    return m.agg(F.round(F.avg("t"), 5).alias("mean_of_means"), F.count("*").alias("n_days"), F.count_if(F.col("missing") == 0).alias("complete_days"), F.sum("hours").alias("n_hours"))


@query(OBS + f", c as (select {CELL}, elev, td from good) select row_no, col_no, count(*) seen, count(td) n_td, round(avg(td), 6) mean_td, round(avg(elev), 6) mean_elev from c group by all")
def agg_cell_means(spark, folder):
    """AGG-09, SRC-18, JOIN-08: means per cell over present values, each with its own count."""
    return with_cell(good(spark, folder)).groupBy("row_no", "col_no").agg(F.count("*").alias("seen"), F.count("td").alias("n_td"), F.round(F.avg("td"), 6).alias("mean_td"), F.round(F.avg("elev"), 6).alias("mean_elev"))


@query(OBS + """, w as (select hour(obstime) h, td, cos(radians(lat)) w from good) select h, round(sum(td * w) / sum(case when td is not null then w end), 6) mean from w group by h""")
def agg_area_weighted(spark, folder):
    """AGG-10: cosine-weighted means, weights renormalised over present values."""
    return good(spark, folder).groupBy(F.hour("obstime").alias("h")).agg(F.round(weighted_mean(F.col("td"), F.cos(F.radians("lat"))), 6).alias("mean"))


@query(OBS + """, v as (select icao, ws * -sin(radians(wd)) u, ws * -cos(radians(wd)) v from good where ws is not null and wd is not null)
 select icao, count(*) n, round(sqrt(avg(u) * avg(u) + avg(v) * avg(v)), 6) speed_of_mean, round(avg(sqrt(u * u + v * v)), 6) mean_of_speeds from v group by icao""")
def agg_vector_mean(spark, folder):
    """AGG-11: the speed of the mean vector and the mean of speeds."""
    d = F.radians("wd")
    v = good(spark, folder).where("ws is not null and wd is not null").select("icao", (-F.col("ws") * F.sin(d)).alias("u"), (-F.col("ws") * F.cos(d)).alias("v"))
    return v.groupBy("icao").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg("u") * F.avg("u") + F.avg("v") * F.avg("v")), 6).alias("speed_of_mean"), F.round(F.avg(F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))), 6).alias("mean_of_speeds"))


@query(OBS + """ select a, b, round(r, 6) r from (select corr(t, td) t_td, corr(t, qnh) t_qnh, corr(t, ws) t_ws, corr(td, qnh) td_qnh, corr(td, ws) td_ws, corr(qnh, ws) qnh_ws from good) unpivot (r for k in (t_td, t_qnh, t_ws, td_qnh, td_ws, qnh_ws)) , (values ('t_td','t','td'), ('t_qnh','t','qnh'), ('t_ws','t','ws'), ('td_qnh','td','qnh'), ('td_ws','td','ws'), ('qnh_ws','qnh','ws')) m(kk, a, b) where k = kk""")
def agg_corr_matrix(spark, folder):
    """AGG-15, R-25: pairwise correlations in one pass over the data."""
    names = ["t", "td", "qnh", "ws"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    g = good(spark, folder).agg(*(F.round(guarded_corr(F.col(a), F.col(b)), 6).alias(f"{a}|{b}") for a, b in pairs))
    return g.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs])).alias("x")).select("x.*")


@query("select category, count(*) n, round(avg(tafpresent), 6) p, round(sqrt(avg(tafpresent) * (1 - avg(tafpresent)) / count(tafpresent)), 6) se from station_index where tafpresent is not null group by category")
def agg_binomial_se(spark, folder):
    """AGG-18: a share with its binomial standard error."""
    p = F.avg("tafpresent")
    return table(spark, folder, "station_index").where("tafpresent is not null").groupBy("category").agg(F.count("*").alias("n"), F.round(p, 6).alias("p"), F.round(F.sqrt(p * (1 - p) / F.count("tafpresent")), 6).alias("se"))


@query("select minute(obstime) m, count(*) n from station_index group by 1 having count(*) >= 3")
def agg_minute_histogram(spark, folder):
    """AGG-20, ST-08: counts by minute of the hour."""
    return table(spark, folder, "station_index").groupBy(F.minute("obstime").alias("m")).agg(F.count("*").alias("n")).where("n >= 3")


@query("select model, count(*) filter (variable = 'mslp') mslp, count(*) filter (variable = 'tmp500') tmp500, count(*) filter (variable = 'thetae850') thetae850 from plane_ceiling where model is not null group by model")
def agg_status_pivot(spark, folder):
    """AGG-21: counts pivoted by a declared list of kinds."""
    return table(spark, folder, "plane_ceiling").where("model is not null").groupBy("model").pivot("variable", ["mslp", "tmp500", "thetae850"]).agg(F.count(F.lit(1))).na.fill(0)


@query("""with s as (select run, list_sort(list(distinct region)) regions from plane_ceiling where region is not null and median is not null and not isnan(median) and median < 1e19 and median <> -9999 group by run)
 select sha256(array_to_string(regions, ',')) domain, count(*) runs, min(run) first_run from s group by 1""")
def agg_mask_groups(spark, folder):
    """AGG-22, MAT-04: runs grouped by their identical observed domain."""
    s = table(spark, folder, "plane_ceiling").where("region is not null and median is not null and not isnan(median) and median < 1e19 and median <> -9999").groupBy("run").agg(F.array_sort(F.collect_set("region")).alias("r"))
    return s.groupBy(F.sha2(F.array_join("r", ","), 256).alias("domain")).agg(F.count("*").alias("runs"), F.min("run").alias("first_run"))


@query("""with g as (select model, variable, run, median(median) m from plane_ceiling where model is not null and variable is not null and not isnan(median) and median < 1e19 and median <> -9999 group by all)
 select model, variable, count(*) runs, round(min(m), 4) low, round(max(m), 4) high, round(median(m), 4) middle, max(m) - min(m) > 5 spread from g group by all""")
def agg_model_range(spark, folder):
    """AGG-24, R-04: the range over runs of a model's statistic, with a spread test that can fail."""
    p = table(spark, folder, "plane_ceiling").where("model is not null and variable is not null and not isnan(median) and median < 1e19 and median <> -9999")
    by = ["model", "variable"]
    m = written(exact_percentiles(p, [*by, "run"], {"m": ("median", 0.5)}))
    g = with_percentiles(m.groupBy(*by).agg(F.count("*").alias("runs"), F.min("m").alias("low"), F.max("m").alias("high")), exact_percentiles(m, by, {"middle": ("m", 0.5)}), by)
    return g.select(*by, "runs", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), F.round("middle", 4).alias("middle"), (F.col("high") - F.col("low") > 5).alias("spread"))


@query(OBS + f""", c as (select {CELL}, avg(t) v from good group by all), z as (select row_no, v, avg(v) over (partition by row_no) zonal, cos(radians(87.5 - 5 * row_no)) w from c)
 select row_no, round(max(zonal), 6) zonal_mean, round(sqrt(sum(w * (v - zonal) * (v - zonal)) / sum(w)), 6) eddy_rms from z group by row_no""")
def agg_zonal_eddy(spark, folder):
    """AGG-25, GRD-10: zonal means and the RMS of what departs from them; a row of the grid is a bounded group."""
    c = with_cell(good(spark, folder)).groupBy("row_no", "col_no").agg(F.avg("t").alias("v"))
    z = c.withColumn("zonal", F.avg("v").over(Window.partitionBy("row_no"))).withColumn("w", F.cos(F.radians(87.5 - 5 * F.col("row_no"))))
    d = F.col("v") - F.col("zonal")
    return z.groupBy("row_no").agg(F.round(F.max("zonal"), 6).alias("zonal_mean"), F.round(F.sqrt(F.sum(F.col("w") * d * d) / F.sum("w")), 6).alias("eddy_rms"))


@query(FIELD + f""", land as (select distinct row_no, col_no from err), nb as (select l.row_no, l.col_no, count(*) n from land l, (values (-1), (0), (1)) a(dr), (values (-1), (0), (1)) b(dc), land m where m.row_no = l.row_no + dr and m.col_no = (l.col_no + dc + 72) % 72 and not (dr = 0 and dc = 0) group by all),
 k as (select l.*, coalesce(n, 0) < 8 coast from land l left join nb using (row_no, col_no))
 select coast, (floor((lon + 180) / 60))::bigint sector, case when lat < -30 then 0 when lat < 30 then 1 else 2 end band, count(*) n, round(avg(e), 5) + 0.0 bias, round(avg(abs(e)), 5) mae from err join k using (row_no, col_no) group by all""")
def agg_coast_sectors(spark, folder):
    """AGG-26: cells with an absent neighbour among eight against the rest, by latitude band and 60-degree sector; columns wrap."""
    e = against_field(spark, folder)
    land = e.select("row_no", "col_no").distinct()
    n = neighbours(land, "row_no", "col_no", 1, 1, 72).where("not (to_row = row_no and to_col = col_no)")
    there = n.join(land.select(F.col("row_no").alias("to_row"), F.col("col_no").alias("to_col")), ["to_row", "to_col"]).groupBy("row_no", "col_no").agg(F.count("*").alias("k"))
    coast = land.join(there, ["row_no", "col_no"], "left").select("row_no", "col_no", (F.coalesce("k", F.lit(0)) < 8).alias("coast"))
    g = e.join(coast, ["row_no", "col_no"]).groupBy("coast", F.floor((F.col("lon") + 180) / 60).alias("sector"), banded(F.col("lat"), [-30, 30]))
    return g.agg(F.count("*").alias("n"), F.round(F.avg("e"), 5).alias("bias"), F.round(F.avg(F.abs("e")), 5).alias("mae"))


@query("""select year(l_shipdate) yr, th threshold, round(sum(case when l_discount > th then l_quantity else 0 end), 2) liquid, round(sum(case when l_discount <= th then l_quantity else 0 end), 2) solid,
 round(sum(case when l_discount > th then l_quantity else 0 end) / sum(l_quantity), 6) share from lineitem, (values (0.02::double), (0.05::double)) v(th) group by all""")
def agg_conditional_sums(spark, folder):
    """AGG-28: sums split at thresholds, strictly above and at most, by year."""
    x = table(spark, folder, "lineitem").select(F.year("l_shipdate").alias("yr"), "l_discount", "l_quantity", F.explode(F.array(F.lit(0.02), F.lit(0.05))).alias("threshold"))
    above = F.sum(F.when(F.col("l_discount") > F.col("threshold"), F.col("l_quantity")).otherwise(0))
    below = F.sum(F.when(F.col("l_discount") <= F.col("threshold"), F.col("l_quantity")).otherwise(0))
    return x.groupBy("yr", "threshold").agg(F.round(above, 2).alias("liquid"), F.round(below, 2).alias("solid"), F.round(above / F.sum("l_quantity"), 6).alias("share"))


@query("""with y as (select year(l_shipdate) yr, month(l_shipdate) mo, sum((l_quantity >= 25 and l_discount > 0.03 and l_tax > 0.02)::int)::bigint idx from lineitem group by all)
 select yr, mo, idx, rank() over (partition by mo order by idx desc, yr) place from y""")
def agg_multi_predicate_index(spark, folder):
    """AGG-29, WIN-12, JOIN-20: counts of rows that meet all conditions, ranked over the years of a calendar month."""
    y = table(spark, folder, "lineitem").groupBy(F.year("l_shipdate").alias("yr"), F.month("l_shipdate").alias("mo")).agg(F.count_if(F.expr("l_quantity >= 25 and l_discount > 0.03 and l_tax > 0.02")).alias("idx"))
    return y.withColumn("place", F.rank().over(Window.partitionBy("mo").orderBy(F.desc("idx"), "yr")))


@query("select coalesce(model, '-') model, coalesce(variable, '-') variable, grouping(model) * 2 + grouping(variable) lvl, count(*) n, sum(n)::bigint cells from plane_ceiling where model is not null and variable is not null group by rollup (model, variable)")
def agg_inventory_rollup(spark, folder):
    """AGG-31, AGG-32, SNK-09: sums by kind and tier with all subtotals."""
    r = table(spark, folder, "plane_ceiling").where("model is not null and variable is not null").rollup("model", "variable")
    a = r.agg(F.grouping_id().cast("int").alias("lvl"), F.count("*").alias("rows"), F.sum("n").alias("cells"))
    return a.select(F.coalesce("model", F.lit("-")).alias("model"), F.coalesce("variable", F.lit("-")).alias("variable"), "lvl", F.col("rows").alias("n"), "cells")


@query("""with y as (select variable, substr(run, 1, 8) d, avg(mean) m, max(mean) hi, quantile_cont(mean, 0.9) p90, sum((vmax >= ceiling)::int)::bigint hits from plane_ceiling where variable is not null and mean is not null and not isnan(mean) group by all)
 select variable, d, round(m, 4) mean, round(hi, 4) high, round(p90, 4) p90, hits, m > avg(m) over (partition by variable) above from y""")
def agg_climatology_by_year(spark, folder):
    """R-02, R-03: mean, maximum, p90 and exceedances per period, and the periods above the overall mean."""
    p = table(spark, folder, "plane_ceiling").where("variable is not null and mean is not null and not isnan(mean)")
    p, by = p.withColumn("d", F.substring("run", 1, 8)), ["variable", "d"]
    y = p.groupBy(*by).agg(F.avg("mean").alias("m"), F.round(F.max("mean"), 4).alias("high"), F.count_if(F.col("vmax") >= F.col("ceiling")).alias("hits"))
    y = with_percentiles(y, exact_percentiles(p, by, {"p90": ("mean", 0.9)}), by).withColumn("p90", F.round("p90", 4))
    return y.select("variable", "d", F.round("m", 4).alias("mean"), "high", "p90", "hits", (F.col("m") > F.avg("m").over(Window.partitionBy("variable"))).alias("above"))


# --- windows

DAYS = "with d as (select distinct user_id, date_diff('day', date '2024-01-01', ts::date) d from events), g as (select *, d - row_number() over (partition by user_id order by d) k from d), isl as (select user_id, min(d) first, max(d) last, count(*) len from g group by user_id, k)"


def active_days(spark, folder):
    return table(spark, folder, "events").select("user_id", F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("d"))


@query(DAYS + " select user_id, max(len) longest from isl group by user_id")
def win_longest_run(spark, folder):
    """WIN-01: the longest run of active days."""
    return longest_run(active_days(spark, folder), ["user_id"], "d")


@query(DAYS + " select user_id, first first_day, last last_day, len length from isl where len >= 3")
def win_episodes(spark, folder):
    """WIN-02: episodes of adjacent days, at least three."""
    return islands(active_days(spark, folder), ["user_id"], "d").where("length >= 3").select("user_id", F.col("first").alias("first_day"), F.col("last").alias("last_day"), "length")


@query(DAYS + """, v as (select user_id, date_diff('day', date '2024-01-01', ts::date) d, avg(value) v, count(*) n from events group by all), e as (select * from isl where len >= 3)
 select e.user_id, e.first first_day, case when b.v - a.v < -20 then 'decay' when b.n - a.n >= 2 then 'displace' when b.v - a.v > 20 then 'growth' else 'ambiguous' end kind from e join v a on a.user_id = e.user_id and a.d = e.last - 2 join v b on b.user_id = e.user_id and b.d = e.last""")
def win_episode_exit(spark, folder):
    """WIN-03: how episodes end, by the change over their last days, rules in order."""
    d = table(spark, folder, "events").select("user_id", F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("d"), "value").groupBy("user_id", "d").agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    e = islands(d, ["user_id"], "d").where("length >= 3")
    a, b = (d.select("user_id", (F.col("d") + k).alias("last"), F.col("v").alias(f"v{k}"), F.col("n").alias(f"n{k}")) for k in (2, 0))
    dv, dn = F.col("v0") - F.col("v2"), F.col("n0") - F.col("n2")
    kind = F.when(dv < -20, "decay").when(dn >= 2, "displace").when(dv > 20, "growth").otherwise("ambiguous")
    return e.join(a, ["user_id", "last"]).join(b, ["user_id", "last"]).select("user_id", F.col("first").alias("first_day"), kind.alias("kind"))


@query("""with s as (select distinct date_diff('day', date '2024-01-01', ts::date) d, user_id from events where event_type = 'purchase'), n as (select d, count(*) n from s group by d), b as (select a.d, count(*) k from s a join s b on b.d = a.d + 1 and a.user_id = b.user_id group by a.d)
 select n.d, coalesce(k, 0) both_frames, n.n + m.n - coalesce(k, 0) any_frame, round(coalesce(k, 0) / (n.n + m.n - coalesce(k, 0)), 6) iou from n join n m on m.d = n.d + 1 left join b on b.d = n.d""")
def win_frame_iou(spark, folder):
    """WIN-04, JOIN-15: overlap of consecutive frames, as intersection over union; empty frames are skipped."""
    s = table(spark, folder, "events").where("event_type = 'purchase'").select(F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("d"), "user_id").distinct()
    nxt = s.select((F.col("d") - 1).alias("d"), "user_id")
    n = s.groupBy("d").agg(F.count("*").alias("n")).join(nxt.groupBy("d").agg(F.count("*").alias("m")), "d")
    k = F.coalesce("k", F.lit(0))
    u = F.col("n") + F.col("m") - k
    return n.join(s.join(nxt, ["d", "user_id"]).groupBy("d").agg(F.count("*").alias("k")), "d", "left").select("d", k.alias("both_frames"), u.alias("any_frame"), F.round(k / u, 6).alias("iou"))


@query(LEVELS + """, c as (select sounding_id, ascent_no, level_no, ((p % 256) + 256) % 256 code from l where p <> -32768), e as (select *, coalesce(((code - lag(code) over w) % 256 + 256) % 256, code) delta from c window w as (partition by sounding_id, ascent_no order by level_no))
 select sounding_id, ascent_no, level_no, delta, (sum(delta) over (partition by sounding_id, ascent_no order by level_no) % 256)::int restored, (sum(delta) over (partition by sounding_id, ascent_no order by level_no) % 256)::int = code same from e""")
def win_delta_mod256(spark, folder):
    """WIN-05, WIN-06, SRC-15: differences modulo 256 and their running sum, which restores the codes. A profile is a bounded group."""
    c = levels(spark, folder).where("p is not null").select("sounding_id", "ascent_no", "level_no", F.pmod("p", F.lit(256)).alias("code"))
    w = Window.partitionBy("sounding_id", "ascent_no").orderBy("level_no")
    e = c.withColumn("delta", F.coalesce(F.pmod(F.col("code") - F.lag("code").over(w), F.lit(256)), F.col("code")))
    e = e.withColumn("restored", F.pmod(F.sum("delta").over(w), F.lit(256)).cast("int"))
    return e.select("sounding_id", "ascent_no", "level_no", "delta", "restored", (F.col("restored") == F.col("code")).alias("same"))


@query("select doc_id, (sum((n_chars + 7) // 8 * 8) over (order by doc_id) - (n_chars + 7) // 8 * 8)::bigint start from documents")
def win_prefix_offsets(spark, folder):
    """WIN-07, SRC-13: offsets as running sums of lengths rounded up to 8, by block totals rather than one sort of the table."""
    d = table(spark, folder, "documents").select("doc_id", (F.floor((F.col("n_chars") + 7) / 8) * 8).alias("len"))
    return running_total(d, [], "doc_id", "len", 5000).select("doc_id", (F.col("total") - F.col("len")).alias("start"))


@query("""select count(*) links, count(b.byte_offset) glued from (select byte_offset + byte_length e from station_index where byte_length is not null) a left join (select distinct byte_offset from station_index) b on a.e = b.byte_offset""")
def win_chain_check(spark, folder):
    """WIN-16: does each record begin where another ends, an equality join of ends and starts."""
    s = table(spark, folder, "station_index")
    a = s.where("byte_length is not null").select((F.col("byte_offset") + F.col("byte_length")).alias("e"))
    return a.join(s.select("byte_offset").distinct(), F.col("e") == F.col("byte_offset"), "left").agg(F.count("*").alias("links"), F.count("byte_offset").alias("glued"))


@query("""select c.thread_id, count(*) links, count(*) filter (c.n_chars >= p.n_chars) gains, count(*) filter (c.posted_at < p.posted_at) backwards from documents c join documents p on c.parent_id = p.doc_id group by c.thread_id""")
def win_step_gain(spark, folder):
    """WIN-16: from parent to child along chains: gains in length, and steps back in time."""
    d = table(spark, folder, "documents")
    p = d.select(F.col("doc_id").alias("parent_id"), F.col("n_chars").alias("before"), F.col("posted_at").alias("at_before"))
    j = d.select("thread_id", "parent_id", "n_chars", "posted_at").join(p, "parent_id")
    return j.groupBy("thread_id").agg(F.count("*").alias("links"), F.count_if(F.col("n_chars") >= F.col("before")).alias("gains"), F.count_if(F.col("posted_at") < F.col("at_before")).alias("backwards"))


MONTHS = "with m as (select o_orderpriority code, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 i, month(o_orderdate) mo, sum(o_totalprice) v from orders group by all)"


def monthly(spark, folder):
    """A monthly series per priority: ``code, i, mo, v``; at most one row per month of the calendar."""
    o = table(spark, folder, "orders")
    i = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    return o.groupBy(F.col("o_orderpriority").alias("code"), i.alias("i"), F.month("o_orderdate").alias("mo")).agg(F.sum("o_totalprice").alias("v"))


@query(MONTHS + ", c as (select code, mo, avg(v) clim from m where i < 48 group by all) select code, i, round(v - clim, 4) anomaly from m join c using (code, mo)")
def win_climatology_anomaly(spark, folder):
    """WIN-08, MAT-05: anomalies from a climatology of training months only."""
    return seasonal_anomaly(monthly(spark, folder), ["code"], "mo", "v", F.col("i") < 48).select("code", "i", F.round("anomaly", 4).alias("anomaly"))


@query(MONTHS + " select code, i, round(v - avg(v) over (partition by code, mo), 4) anomaly from m")
def win_deseasonalised(spark, folder):
    """WIN-09: anomalies from the whole sample."""
    return seasonal_anomaly(monthly(spark, folder), ["code"], "mo", "v", F.lit(True)).select("code", "i", F.round("anomaly", 4).alias("anomaly"))


@query(MONTHS + ", f as (select code, regr_slope(v, i) b, avg(v) my, avg(i) mx from m where i < 48 group by code) select code, i, round(v - my - b * (i - mx), 2) detrended from m join f using (code)")
def win_detrend(spark, folder):
    """WIN-10: a line fitted on training months, taken off everywhere."""
    return detrended(monthly(spark, folder), ["code"], "i", "v", F.col("i") < 48).select("code", "i", F.round("detrended", 2).alias("detrended"))


@query(MONTHS + """, p as (select a.code, k lead, a.v x, b.v y from m a, (values (1), (2), (3)) v(k), m b where b.code = a.code and b.i = a.i + k) select code, lead, count(*) n, round(avg(abs(y - x)), 3) persistence_mae, round(avg(abs(y - x)) / avg(abs(y)), 6) relative from p group by all""")
def win_lag_persistence(spark, folder):
    """WIN-11, JOIN-19, R-22, R-23: pairs of origin and target over leads, and the error of persistence."""
    m = monthly(spark, folder)
    a = m.select("code", "i", F.col("v").alias("x"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("lead")).withColumn("i", F.col("i") + F.col("lead"))
    p = a.join(m.select("code", "i", F.col("v").alias("y")), ["code", "i"])
    mae = F.avg(F.abs(F.col("y") - F.col("x")))
    return p.groupBy("code", "lead").agg(F.count("*").alias("n"), F.round(mae, 3).alias("persistence_mae"), F.round(mae / F.avg(F.abs("y")), 6).alias("relative"))


@query(LEVELS + """, n as (select *, lead(p) over w np, lead(coalesce(sig, -32768)) over w ns, max(level_no) over (partition by sounding_id, ascent_no) top from l where p <> -32768 window w as (partition by sounding_id, ascent_no order by level_no))
 select count(*) pairs, count(*) filter (ns <> -32768 and ns <> 0) flagged, count(*) filter (not (ns <> -32768 and ns <> 0) and p / np < 1.03) violations, round(min(case when not (ns <> -32768 and ns <> 0) then p / np end), 6) least from n where level_no + 1 < top and np is not null and ns is not null""")
def win_ratio_rule(spark, folder):
    """WIN-15: pressure ratios of adjacent levels, the highest level exempt, flagged levels exempt."""
    w = Window.partitionBy("sounding_id", "ascent_no")
    raw = levels(spark, folder).where("p is not null").withColumn("ns", F.lead(F.coalesce("sig", F.lit(-32768))).over(w.orderBy("level_no")))
    n = raw.withColumn("np", F.lead("p").over(w.orderBy("level_no"))).withColumn("top", F.max("level_no").over(w)).where("level_no + 1 < top and np is not null and ns is not null")
    flagged, ratio = (F.col("ns") != -32768) & (F.col("ns") != 0), F.col("p") / F.col("np")
    return n.agg(F.count("*").alias("pairs"), F.count_if(flagged).alias("flagged"), F.count_if(~flagged & (ratio < 1.03)).alias("violations"), F.round(F.min(F.when(~flagged, ratio)), 6).alias("least"))


@query(MONTHS + """, a as (select i, v x from m where code = '1-URGENT' and i < 72), b as (select i, v y from m where code = '5-LOW' and i < 72), s as (select k, corr(x, y) r from a, (values (0), (1), (2), (3), (4), (5)) v(k), b where b.i = (a.i + 12 * k) % 72 group by k)
 select round(max(r) filter (k = 0), 6) observed, count(*) filter (k > 0) shifts, round((1 + count(*) filter (k > 0 and abs(r) >= abs((select r from s where k = 0)))) / count(*), 6) p from s""")
def win_circular_shift_null(spark, folder):
    """WIN-17: a correlation against those under whole-year circular shifts."""
    m = monthly(spark, folder).where("i < 72")
    a = m.where("code = '1-URGENT'").select("i", F.col("v").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")).withColumn("j", (F.col("i") + 12 * F.col("k")) % 72)
    b = m.where("code = '5-LOW'").select(F.col("i").alias("j"), F.col("v").alias("y"))
    s = a.join(b, "j").groupBy("k").agg(guarded_corr(F.col("x"), F.col("y")).alias("r"))
    o = s.where("k = 0").select(F.col("r").alias("r0"))
    return s.join(F.broadcast(o)).agg(F.round(F.max("r0"), 6).alias("observed"), F.count_if(F.col("k") > 0).alias("shifts"), F.round((1 + F.count_if((F.col("k") > 0) & (F.abs("r") >= F.abs("r0")))) / F.count("*"), 6).alias("p"))


@query(FIELD + """, l as (select th, avg(((model >= th) <> (t >= 15))::int) loss from err, (values (8.0::double), (11.0::double), (13.0::double), (15.0::double), (17.0::double), (20.0::double)) v(th) group by th), r as (select *, row_number() over (order by th) rung, row_number() over (order by loss, th) best, lag(loss) over (order by th) before from l)
 select max(rung) filter (best = 1) at_rung, max(rung) filter (best = 1) not in (1, count(*)) interior, round(max(loss) filter (best = 2) - max(loss) filter (best = 1), 6) margin, bool_and(before is null or loss >= before) monotone from r""")
def win_argmin_interior(spark, folder):
    """WIN-18: the best rung of a ladder, whether it lies inside, its margin, and monotony. Six rungs."""
    x = against_field(spark, folder).select("model", "t", F.explode(F.array(*map(F.lit, (8.0, 11.0, 13.0, 15.0, 17.0, 20.0)))).alias("th"))
    loss = x.groupBy("th").agg(F.avg(((F.col("model") >= F.col("th")) != (F.col("t") >= 15)).cast("int")).alias("loss"))
    w = Window.orderBy("th")
    r = loss.select("loss", F.row_number().over(w).alias("rung"), F.row_number().over(Window.orderBy("loss", "th")).alias("best"), F.lag("loss").over(w).alias("before"))
    top = F.max(F.when(F.col("best") == 1, F.col("rung")))
    pick = lambda k: F.max(F.when(F.col("best") == k, F.col("loss")))
    return r.agg(top.alias("at_rung"), ((top != 1) & (top != F.count("*"))).alias("interior"), F.round(pick(2) - pick(1), 6).alias("margin"), F.bool_and(F.col("before").isNull() | (F.col("loss") >= F.col("before"))).alias("monotone"))


CELLS = OBS + f", c as (select {CELL}, avg(t) v from good group by all)"


def cell_means(spark, folder):
    return with_cell(good(spark, folder)).groupBy("row_no", "col_no").agg(F.avg("t").alias("v"))


@query(CELLS + " select a.row_no, a.col_no, round(avg(b.v), 6) mean, count(*) n from c a join c b on b.row_no between a.row_no - 2 and a.row_no + 2 and (abs(b.col_no - a.col_no) <= 2 or abs(b.col_no - a.col_no) >= 70) group by all")
def win_uniform_filter(spark, folder):
    """WIN-19: a 5 by 5 mean over present cells, columns wrapping."""
    return uniform_filter(cell_means(spark, folder), [], "row_no", "col_no", "v", 2, 72).withColumn("mean", F.round("mean", 6))


@query()
def win_local_maxima(spark, folder):
    """WIN-20: local maxima of the grid at least 8 cells apart, the first five. Greedy: tested against a plain loop."""
    return local_maxima(cell_means(spark, folder).withColumn("one", F.lit(1)), ["one"], "row_no", "col_no", "v", 1, 2, 72, 8, 5)


# --- grids


@query(OBS + f""", c as (select {CELL}, hour(obstime) // 6 h, avg(t) v from good group by all),
 ra as (select i src, j dst, least(sin(radians(90 - 5 * i)), sin(radians(90 - 9 * j))) - greatest(sin(radians(85 - 5 * i)), sin(radians(81 - 9 * j))) w from range(36) a(i), range(20) b(j)),
 ca as (select i src, j dst, least(5 * i + 5, 12 * j + 12) - greatest(5 * i, 12 * j) w from range(72) a(i), range(30) b(j))
 select h, ra.dst to_row, ca.dst to_col, round(sum(v * ra.w * ca.w) / sum(ra.w * ca.w), 6) mean, round(sum(ra.w * ca.w), 6) area from c join ra on ra.src = row_no and ra.w > 1e-12 join ca on ca.src = col_no and ca.w > 0 group by all""")
def grd_regrid(spark, folder):
    """GRD-01, GRD-02, GRD-03, JOIN-09: conservative regridding of a stack of 5-degree cells to 9 by 12 degrees."""
    c = with_cell(good(spark, folder)).groupBy((F.floor(F.hour("obstime") / 6)).alias("h"), "row_no", "col_no").agg(F.avg("t").alias("v"))
    rows = axis_weights(spark, [-90.0 + 5 * i for i in range(37)], [-90.0 + 9 * i for i in range(21)], True)
    rows = rows.select((35 - F.col("src")).alias("src"), (19 - F.col("dst")).alias("dst"), "w").where("w > 1e-12")
    cols = axis_weights(spark, [5.0 * i for i in range(73)], [12.0 * i for i in range(31)], False)
    return regridded(c, ["h"], "row_no", "col_no", "v", rows, cols).select("h", "to_row", "to_col", F.round("mean", 6).alias("mean"), F.round("area", 6).alias("area"))


@query("""with c as (select code, floor(day_no / 7)::bigint wk, avg(value) v from (select code, date_diff('day', date '2014-01-01', valid_time::date) day_no, value from field_readings where value > 0 and value < 9e35 and not isnan(value)) group by all),
 w as (select i src, j dst, least(7 * i + 7, 10 * j + 10) - greatest(7 * i, 10 * j) w from range(6) a(i), range(4) b(j)) select code, dst, round(sum(v * w) / sum(w), 5) mean, sum(w)::double covered from c join w on src = wk and w > 0 group by all""")
def grd_overlap_bins(spark, folder):
    """JOIN-09: means of week bins on ten-day bins by their overlaps."""
    r = table(spark, folder, "field_readings").where("value > 0 and value < 9e35 and not isnan(value)")
    c = r.groupBy("code", F.floor(F.datediff("valid_time", F.lit("2014-01-01").cast("date")) / 7).alias("wk")).agg(F.avg("value").alias("v"))
    w = axis_weights(spark, [7.0 * i for i in range(7)], [10.0 * i for i in range(5)], False)
    j = c.join(w, F.col("wk") == F.col("src"))
    return j.groupBy("code", "dst").agg(F.round(F.sum(F.col("v") * F.col("w")) / F.sum("w"), 5).alias("mean"), F.sum("w").alias("covered"))


@query(OBS + f""", fine as (select floor((90 - lat) / 2.5)::bigint fr, floor((lon + 180) / 2.5)::bigint fc, max((t > 10)::int) warm from good group by all)
 select fr // 4 row_no, fc // 4 col_no, count(*) covered, round(avg(warm), 6) fraction, case when count(*) >= 3 then 'ok' else 'thin' end state from fine group by all""")
def grd_coarsen_fraction(spark, folder):
    """JOIN-07, GRD-08: a fine mask as a fraction of coarse cells, with how many fine cells cover it."""
    fine = good(spark, folder).groupBy(F.floor((90 - F.col("lat")) / 2.5).alias("fr"), F.floor((F.col("lon") + 180) / 2.5).alias("fc")).agg(F.max((F.col("t") > 10).cast("int")).alias("warm"))
    g = fine.groupBy(F.floor(F.col("fr") / 4).alias("row_no"), F.floor(F.col("fc") / 4).alias("col_no"))
    return g.agg(F.count("*").alias("covered"), F.round(F.avg("warm"), 6).alias("fraction"), F.when(F.count("*") >= 3, "ok").otherwise("thin").alias("state"))


@query()
def grd_components(spark, folder):
    """GRD-04: connected components of warm cells per day, with size. Tested against a union-find."""
    g = with_cell(good(spark, folder), 10.0).where("t > 5").withColumn("d", F.datediff("obstime", F.lit("2014-01-01").cast("date")))
    c = components(g, ["d"], "row_no", "col_no")
    return c.groupBy("d", "label").agg(F.count("*").alias("size")).select("d", F.col("label.r").alias("label_row"), F.col("label.c").alias("label_col"), "size")


@query()
def grd_change_patches(spark, folder):
    """GRD-05: filtered late less filtered early field, patches of strong change with their area in km2."""
    g = with_cell(good(spark, folder)).withColumn("late", F.hour("obstime") >= 12)
    c = g.groupBy("row_no", "col_no").agg(F.avg(F.when(F.col("late"), F.col("t"))).alias("b"), F.avg(F.when(~F.col("late"), F.col("t"))).alias("a"))
    side = lambda v: uniform_filter(c.where(F.col(v).isNotNull()), [], "row_no", "col_no", v, 1, 72).select("row_no", "col_no", F.col("mean").alias(v))
    d = side("a").join(side("b"), ["row_no", "col_no"]).withColumn("sign", F.when(F.col("b") - F.col("a") >= 1, 1).when(F.col("b") - F.col("a") <= -1, -1)).where("sign is not null")
    k = components(d, ["sign"], "row_no", "col_no")
    km2 = 6371.0**2 * F.radians(F.lit(5.0)) * (F.sin(F.radians(90 - 5 * F.col("row_no"))) - F.sin(F.radians(85 - 5 * F.col("row_no"))))
    p = k.groupBy("sign", "label").agg(F.count("*").alias("cells"), F.round(F.sum(km2), 1).alias("km2")).where("cells >= 2")
    return p.select("sign", F.col("label.r").alias("label_row"), F.col("label.c").alias("label_col"), "cells", "km2")


@query(OBS + """ select floor(km / 1000)::bigint ring, count(*) n, count(distinct icao) stations from (select icao, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(40 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(40)) * pow(sin(radians(20 - lon) / 2), 2)))) km from good) group by 1""")
def grd_radial_rings(spark, folder):
    """GRD-06: density in rings round a point."""
    g = good(spark, folder).withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.lit(40.0), F.lit(20.0)))
    return g.groupBy(F.floor(F.col("km") / 1000).alias("ring")).agg(F.count("*").alias("n"), F.countDistinct("icao").alias("stations"))


@query()
def grd_offset_field(spark, folder):
    """GRD-07: offsets of patches between early and late fields by normalised correlation. Tested with known shifts."""
    g = with_cell(good(spark, folder), 15.0).withColumn("late", F.hour("obstime") >= 12)
    c = g.groupBy("row_no", "col_no").agg(F.avg(F.when(~F.col("late"), F.col("t"))).alias("a"), F.avg(F.when(F.col("late"), F.col("t"))).alias("b")).where("a is not null and b is not null")
    return offset_field(c, [], "row_no", "col_no", "a", "b", 4, 1)


@query(OBS + f""", f as (select {CELL}, count(*) n, sum(t) s from good where lat > -90 group by all), k as (select row_no // 2 r, col_no // 2 q, sum(n) n, sum(s) s from f group by all), d as (select floor((90 - lat) / 10)::bigint r, floor((lon + 180) / 10)::bigint q, count(*) n, sum(t) s from good where lat > -90 group by all)
 select count(*) cells, count(*) filter (k.n = d.n and abs(k.s - d.s) < 1e-6) same from k join d using (r, q)""")
def grd_nested_identity(spark, folder):
    """GRD-09, VER-11, VER-12: cells nested in coarser cells sum to them."""
    g = good(spark, folder).where("lat > -90")
    agg = lambda df, a, b: df.groupBy(a.alias("r"), b.alias("q")).agg(F.count("*").alias("n"), F.sum("t").alias("s"))
    f = agg(g, F.floor((90 - F.col("lat")) / 5), F.floor((F.col("lon") + 180) / 5))
    k = f.groupBy(F.floor(F.col("r") / 2).alias("r"), F.floor(F.col("q") / 2).alias("q")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    d = agg(g, F.floor((90 - F.col("lat")) / 10), F.floor((F.col("lon") + 180) / 10)).withColumnsRenamed({"n": "m", "s": "u"})
    return k.join(d, ["r", "q"]).agg(F.count("*").alias("cells"), F.count_if((F.col("n") == F.col("m")) & (F.abs(F.col("s") - F.col("u")) < 1e-6)).alias("same"))


@query(CELLS + """, m as (select row_no, col_no, v, 35 - row_no ar, (col_no + 36) % 72 ac from c) select (a.v > 10) warm, (b.v > 10) opposite_warm, count(*) n, round(avg((a.v - b.v) / 2), 6) odd, round(avg((a.v + b.v) / 2), 6) even from m a join c b on b.row_no = a.ar and b.col_no = a.ac group by all""")
def grd_antipodes(spark, folder):
    """GRD-11, MAT-16, R-24, R-28: cells paired with their antipodes, class counts, odd and even parts."""
    c = cell_means(spark, folder)
    b = c.select((35 - F.col("row_no")).alias("row_no"), ((F.col("col_no") + 36) % 72).alias("col_no"), F.col("v").alias("o"))
    j = c.join(b, ["row_no", "col_no"])
    return j.groupBy((F.col("v") > 10).alias("warm"), (F.col("o") > 10).alias("opposite_warm")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("v") - F.col("o")) / 2), 6).alias("odd"), F.round(F.avg((F.col("v") + F.col("o")) / 2), 6).alias("even"))


@query("select upper(trim(icao)) icao, count(*) n, count(distinct obstime) times, (min(epoch_us(received_at) - epoch_us(obstime)) // 1000000)::bigint least_delay_s, (max(epoch_us(received_at) - epoch_us(obstime)) // 1000000)::bigint most_delay_s from station_index where icao is not null group by 1")
def agg_archive_summary(spark, folder):
    """SNK-09, SRC-12: counts, repeats and delays per station of the archive."""
    d = F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("obstime").cast("timestamp"))
    g = table(spark, folder, "station_index").groupBy(entity("icao").alias("icao")).agg(F.count("*").alias("n"), F.countDistinct("obstime").alias("times"), F.floor(F.min(d) / 1000000).alias("least_delay_s"), F.floor(F.max(d) / 1000000).alias("most_delay_s"))
    return g.where("icao is not null")
