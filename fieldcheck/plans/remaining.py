"""Further scans, sinks and rechecks of the inventory."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.thermo import humidity_from_dew, theta_e
from ..functions.units import spelled
from ..operators.stats import exact_percentiles, with_percentiles
from ..session import shared_folder, written
from ..sources import sinks
from ..sources.records import partial_digest
from ..tables import table
from .registry import registry
from .verification import CELL, FIELD, OBS, against_field, good, with_cell

QUERIES, ORACLE, query = registry()


@query("""select reading_id, round(case when unit in ('K', 'kelvin', 'Kelvin', 'degK') then value - 273.15 else value end, 6) celsius from field_readings where code = 'tlo' and unit in ('K', 'kelvin', 'Kelvin', 'degK', 'C', 'celsius', 'degC', 'deg C', '°C') and value is not null and not isnan(value)""")
def prj_unit_guard(spark, folder):
    """PRJ-03: kelvin to Celsius only where the unit says kelvin. Readings in a unit that is neither are quarantined (``prj_unit_quarantine``) first; the guard then raises on any that is left."""
    r, known = unit_split(spark, folder)
    return guarded_celsius(r.where(known), "reading_id", "value", "unit")


def unit_split(spark, folder):
    r = table(spark, folder, "field_readings").where("code = 'tlo' and value is not null and not isnan(value)")
    return r, F.coalesce(spelled(F.lit("temperature"), F.col("unit")).isin("K", "C"), F.lit(False))


def guarded_celsius(r, key, value, unit):
    """``key, celsius`` of readings in kelvin or Celsius; any other unit, null too, raises."""
    u = spelled(F.lit("temperature"), F.col(unit))
    c = F.when(u == "K", F.col(value) - 273.15).when(u == "C", F.col(value)).otherwise(F.raise_error(F.concat(F.lit("unknown unit: "), F.coalesce(unit, F.lit("none")))).cast("double"))
    return r.select(key, F.round(c, 6).alias("celsius"))


@query("""select coalesce(unit, '') unit, count(*) n, min(reading_id) first_id from field_readings where code = 'tlo' and value is not null and not isnan(value)
 and (unit is null or unit not in ('K', 'kelvin', 'Kelvin', 'degK', 'C', 'celsius', 'degC', 'deg C', '°C')) group by 1""")
def prj_unit_quarantine(spark, folder):
    """PRJ-03: readings whose unit is neither kelvin nor Celsius, none included, by unit."""
    r, known = unit_split(spark, folder)
    return r.where(~known).groupBy(F.coalesce("unit", F.lit("")).alias("unit")).agg(F.count("*").alias("n"), F.min("reading_id").alias("first_id"))


@query("""with o as (select hour(obstime) h, t, td, qnh p from station_index where not isnan(t) and t between -60 and 55 and not isnan(td) and td between -70 and 40 and td <= t and qnh between 850 and 1100),
 a as (select *, greatest(0.622 * 6.112 * exp(17.67 * td / (td + 243.5)) / (p - 0.378 * 6.112 * exp(17.67 * td / (td + 243.5))), 1e-6) q from o), b as (select *, q / (1 - q) r from a), c as (select *, ln(p * r / (0.622 + r) / 6.112) le from b),
 d as (select *, 243.5 * le / (17.67 - le) + 273.15 dew, t + 273.15 tk from c), e as (select *, 1 / (1 / (dew - 56) + ln(tk / dew) / 800) + 56 lcl from d),
 f as (select h, tk * pow(1000 / p, 0.2854 * (1 - 0.28 * r)) * exp((3.376 / lcl - 0.00254) * r * 1000 * (1 + 0.00081 * r * 1000)) x, tk * pow(1000 / p, 0.2857) * exp(2.5e6::double * q / (1004.0 * lcl)) y from e)
 select h, count(*) n, round(avg(x - y), 5) bias, round(max(abs(x - y)), 5) worst from f group by h""")
def ver_theta_e_recheck(spark, folder):
    """R-01, R-02: equivalent potential temperature against a simpler formula: bias and worst difference per hour, over all rows."""
    o = table(spark, folder, "station_index").where("not isnan(t) and t between -60 and 55 and not isnan(td) and td between -70 and 40 and td <= t and qnh between 850 and 1100")
    q = F.greatest(humidity_from_dew(F.col("td"), F.col("qnh")), F.lit(1e-6))
    o = o.select(F.hour("obstime").alias("h"), "qnh", (F.col("t") + 273.15).alias("tk"), q.alias("q"), theta_e(F.col("t"), q, F.col("qnh")).alias("x"))
    r = F.col("q") / (1 - F.col("q"))
    le = F.ln(F.col("qnh") * r / (F.lit(0.622) + r) / 6.112)
    dew = F.lit(243.5) * le / (F.lit(17.67) - le) + 273.15
    lcl = 1 / (1 / (dew - 56) + F.ln(F.col("tk") / dew) / 800) + 56
    y = F.col("tk") * F.pow(1000 / F.col("qnh"), F.lit(0.2857)) * F.exp(F.lit(2.5e6) * F.col("q") / (F.lit(1004.0) * lcl))
    d = F.col("x") - y
    return o.groupBy("h").agg(F.count("*").alias("n"), F.round(F.avg(d), 5).alias("bias"), F.round(F.max(F.abs(d)), 5).alias("worst"))


@query(OBS + f", c as (select {CELL}, bool_or(t > 20) ever, count(*) n from good group by all) select row_no, count(*) cells, count(*) filter (ever) ever_warm, sum(n)::bigint n from c group by row_no")
def agg_ever_transect(spark, folder):
    """R-08: cells that ever passed a threshold, by row of the grid."""
    c = with_cell(good(spark, folder)).groupBy("row_no", "col_no").agg(F.bool_or(F.col("t") > 20).alias("ever"), F.count("*").alias("n"))
    return c.groupBy("row_no").agg(F.count("*").alias("cells"), F.count_if("ever").alias("ever_warm"), F.sum("n").alias("n"))


@query("""select model, count(*) n, round(max(abs(mean - median) / abs(median)), 9) worst, bool_and(abs(mean - median) / abs(median) < 0.5) all_within from plane_ceiling where model is not null and mean is not null and not isnan(mean) and median is not null and not isnan(median) and median <> 0 and abs(median) < 1e19 and median <> -9999 group by model""")
def ver_relative_recheck(spark, folder):
    """R-12, R-27, VER-11: relative difference of two published numbers, the worst, and whether all hold."""
    p = table(spark, folder, "plane_ceiling").where("model is not null and mean is not null and not isnan(mean) and median is not null and not isnan(median) and median <> 0 and abs(median) < 1e19 and median <> -9999")
    d = F.abs(F.col("mean") - F.col("median")) / F.abs("median")
    return p.groupBy("model").agg(F.count("*").alias("n"), F.round(F.max(d), 9).alias("worst"), F.bool_and(d < 0.5).alias("all_within"))


@query(OBS + f""", c as (select {CELL}, hour(obstime) // 6 q, avg(t) t, avg(elev) elev from good group by all), a as (select row_no, col_no, max(t) - min(t) amp, avg(elev) > 300 high from c group by all having count(*) >= 2 and avg(elev) is not null)
 select th threshold, count(*) n, round(avg(((amp >= th) = high)::int), 6) agreement, count(*) filter (amp >= th and not high) false_high, count(*) filter (amp < th and high) missed from a, (values (1.0::double), (2.0::double), (4.0::double)) v(th) group by th""")
def agg_amplitude_classifier(spark, folder):
    """R-26, SRC-22, AGG-13: a mask against a classifier by amplitude, at several thresholds."""
    c = with_cell(good(spark, folder)).groupBy("row_no", "col_no", F.floor(F.hour("obstime") / 6).alias("q")).agg(F.avg("t").alias("t"), F.avg("elev").alias("elev"))
    a = c.groupBy("row_no", "col_no").agg((F.max("t") - F.min("t")).alias("amp"), (F.avg("elev") > 300).alias("high"), F.count("*").alias("k")).where("k >= 2 and high is not null")
    x = a.select("amp", "high", F.explode(F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0))).alias("threshold"))
    on = F.col("amp") >= F.col("threshold")
    return x.groupBy("threshold").agg(F.count("*").alias("n"), F.round(F.avg((on == F.col("high")).cast("int")), 6).alias("agreement"), F.count_if(on & ~F.col("high")).alias("false_high"), F.count_if(~on & F.col("high")).alias("missed"))


@query(FIELD + " select hour_no, count(*) n, round(quantile_cont(abs(e), 0.5), 6) p50, round(quantile_cont(abs(e), 0.9), 6) p90, arg_max(obs_id, (abs(e), obs_id)) worst_id from err group by hour_no")
def ver_error_localisation(spark, folder):
    """R-31, R-30: percentiles of errors and where the worst one is."""
    e = written(against_field(spark, folder).select("hour_no", F.abs("e").alias("size"), "obs_id"))
    worst = e.groupBy("hour_no").agg(F.count("*").alias("n"), F.max_by("obs_id", F.struct("size", "obs_id")).alias("worst_id"))
    p = with_percentiles(worst, exact_percentiles(e, ["hour_no"], {"p50": ("size", 0.5), "p90": ("size", 0.9)}), ["hour_no"])
    return p.select("hour_no", "n", F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"), "worst_id")


@query("select event_type, count(*) n, count(distinct event_id) ids from events group by event_type")
def snk_ledger(spark, folder):
    """SNK-01, SNK-02, SNK-03: rows appended to a ledger kind by kind, a state replaced, a finished run written once, and read back."""
    e = table(spark, folder, "events")
    place = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    for late in (False, True):
        sinks.append(e.where((F.hour("ts") >= 12) == late).select("event_id", "event_type"), f"{place}/rows")
    counts = spark.read.schema("event_id long, event_type string").parquet(f"{place}/rows").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))
    sinks.replace(counts, f"{place}/state")
    sinks.write_once(counts, f"{place}/finished")
    try:
        sinks.write_once(counts, f"{place}/finished")
    except AnalysisException as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
    else:
        raise RuntimeError("a finished run was written twice")
    return spark.read.schema(counts.schema).parquet(f"{place}/state").join(spark.read.schema(counts.schema).parquet(f"{place}/finished"), counts.columns, "left_semi")


@query("select region, count(*) n, max(case when isnan(median) then null else median end) high from plane_ceiling where variable = 'mslp' group by region")
def src_partition_pruning(spark, folder):
    """SRC-10: a layout by variable, of which only one folder is read."""
    path = f"{shared_folder(spark)}/layout-{uuid.uuid4().hex}"
    p = table(spark, folder, "plane_ceiling").select("plane_id", "region", "variable", F.when(~F.isnan("median"), F.col("median")).alias("median"))
    p.write.partitionBy("variable").parquet(path)
    return spark.read.schema(p.schema).parquet(path).where("variable = 'mslp'").groupBy("region").agg(F.count("*").alias("n"), F.max("median").alias("high"))


@query(OBS + " select lat, count(*) n, row_number() over (order by lat desc) place from good where abs(lat) < 79.999 group by lat")
def src_polar_rows_dropped(spark, folder):
    """SRC-16: polar rows dropped, latitudes descending: places from the counts of coarser bands, so no sort of all latitudes in one task."""
    g = good(spark, folder).where("abs(lat) < 79.999").groupBy("lat").agg(F.count("*").alias("n")).withColumn("b", F.floor("lat"))
    before = g.groupBy("b").agg(F.count("*").alias("k"))
    before = before.select("b", (F.sum("k").over(Window.orderBy(F.desc("b"))) - F.col("k")).alias("before"))  # at most 160 bands
    return g.withColumn("rn", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("lat")))).join(before, "b").select("lat", "n", (F.col("before") + F.col("rn")).alias("place"))


@query("""with h as (select source, hex(encode(text)) x, strlen(text) n from documents where text is not null)
 select source, count(*) n, count(distinct substr(x, 1, 128) || '|' || substr(x, 2 * greatest(n - 64, 0) + 1, 128) || '|' || n) contents, sum(n)::bigint bytes from h group by source""")
def src_partial_digests(spark, folder):
    """SRC-21: contents catalogued by a digest of head, tail and size."""
    d = table(spark, folder, "documents").where("text is not null")
    content = F.col("text").cast("binary")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct(partial_digest(content, F.octet_length("text"), 64)).alias("contents"), F.sum(F.octet_length("text")).alias("bytes"))


@query("""with e as (select distinct user_id, ts::date d from events), need as (select user_id, unnest(generate_series(date '2024-01-01', date '2024-01-30', interval 1 day))::date d from (select distinct user_id from events)),
 m as (select need.user_id, need.d, row_number() over (partition by need.user_id order by need.d) rn from need left join e on need.user_id = e.user_id and need.d = e.d where e.d is null) select user_id, strftime(d, '%Y-%m-%d') d, rn from m where rn <= 3""")
def st_backfill_plan(spark, folder):
    """ST-09, SET-01: the first three missing days of each source, the bound of one backfill."""
    e = table(spark, folder, "events").select("user_id", F.to_date("ts").alias("d"))
    need = e.select("user_id").distinct().select("user_id", F.explode(F.expr("sequence(date'2024-01-01', date'2024-01-30', interval 1 day)")).alias("d"))
    m = need.join(e.distinct(), ["user_id", "d"], "left_anti").withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("d"))).where("rn <= 3")
    return m.select("user_id", F.date_format("d", "yyyy-MM-dd").alias("d"), "rn")
