"""Queries of the problems on nearest times and percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.problem_sql import ASCENT, METAR, OBSERVED
from ..plans.readings import ascents, metars, observations
from ..tables import entity, table
from .nearest import nearest_few, nearest_in_time
from .quantiles import build_sketches, merge_sketches, percentiles

SECOND = 1_000_000


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Station-index rows with their METAR (900 s) and ascents with their station-index row (2,700 s)."""
    obs = observations(spark, folder)
    near = nearest_in_time(obs, metars(spark, folder), ["obs_id"], ["hist_id", "item_no"], "icao", "at", 900 * SECOND)
    asc = nearest_few(ascents(spark, folder), obs, ["sounding_id", "item_no"], ["obs_id"], "icao", "at", 2700 * SECOND)
    return near.select("obs_id", F.lit("metar").alias("kind"), F.col("hist_id").alias("record_id"), "item_no").unionByName(
        asc.select("obs_id", F.lit("ascent").alias("kind"), F.col("sounding_id").alias("record_id"), "item_no")
    )


PROBABILITIES = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def real(col: str):
    """A number without what stands for missing: NaN, 9999 of either sign, 1e20 and beyond."""
    c = F.col(col)
    return F.when(~F.isnan(c) & (F.abs(c) != 9999) & (F.abs(c) < 1e19), c).alias(col)


def station_sketches(spark: SparkSession, folder: str, by_day: bool = False) -> DataFrame:
    """Sketches of elev and t per station (and day) of station_index."""
    s = table(spark, folder, "station_index").select(entity("icao").alias("icao"), F.to_date("obstime").alias("day"), real("elev"), real("t"))
    key = F.concat_ws("|", F.lit("station"), "icao", "day") if by_day else F.concat(F.lit("station|"), F.col("icao"))
    return build_sketches(s.where("icao is not null"), key, ["elev", "t"])


def plane_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches of median per model, variable and region of plane_ceiling, for each variable apart as their units differ."""
    p = table(spark, folder, "plane_ceiling").select("variable", "model", "region", real("median")).where("variable is not null")
    p = p.select("median", F.explode(F.array(F.concat(F.lit("variable|"), "variable"), F.concat(F.lit("model|"), "model", F.lit("|"), "variable"), F.concat(F.lit("region|"), "region", F.lit("|"), "variable"))).alias("key"))
    return build_sketches(p, F.col("key"), ["median"])


def p1_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of elev and t per station, and of median per variable, model and region, with bounded relative rank error."""
    s = station_sketches(spark, folder).unionByName(plane_sketches(spark, folder))
    out = percentiles(merge_sketches(s), PROBABILITIES)
    part = F.split("key", r"\|", 2)
    return out.withColumn("scope", part[0]).withColumn("key", part[1])


def p1_month_from_days(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of elev and t over all stations of each day, merged again into the whole period (key ``all``)."""
    s = table(spark, folder, "station_index").select(F.date_format("obstime", "yyyy-MM-dd").alias("day"), real("elev"), real("t"))
    days = merge_sketches(build_sketches(s, F.col("day"), ["elev", "t"]))
    whole = merge_sketches(days.withColumn("key", F.lit("all")))
    return percentiles(days.unionByName(whole), PROBABILITIES)


def p1_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """For each key and field of p1_percentiles the number of values, and how many of its percentiles lie further from their rank than ``rank_error`` says, by counting all values below and up to each."""
    s = table(spark, folder, "station_index").select(F.concat(F.lit("station|"), entity("icao")).alias("k"), real("elev"), real("t"))
    p = table(spark, folder, "plane_ceiling").where("variable is not null").select("variable", "model", "region", real("median"))
    keys = F.array(F.concat(F.lit("variable|"), "variable"), F.concat(F.lit("model|"), "model", F.lit("|"), "variable"), F.concat(F.lit("region|"), "region", F.lit("|"), "variable"))
    x = s.select("k", F.inline(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("x")) for f in ("elev", "t"))))).unionByName(p.select(F.explode(keys).alias("k"), F.lit("median").alias("f"), F.col("median").alias("x")))
    q = p1_percentiles(spark, folder)
    names = [c for c in q.columns if c[0] == "p" and c[1:].isdigit()]
    j = x.where("k is not null and x is not null").join(q.select(F.concat("scope", F.lit("|"), "key").alias("k2"), "field", "rank_error", *names), (F.col("k") == F.col("k2")) & (F.col("f") == F.col("field")))
    n = lambda c: F.count(F.when(c, 1))
    c = j.groupBy("k", "f").agg(F.count("*").alias("n"), F.first("rank_error").alias("e"), *(n(F.col("x") < F.col(a)).alias(f"lo_{a}") for a in names), *(n(F.col("x") <= F.col(a)).alias(f"hi_{a}") for a in names))
    off = lambda a, p: F.greatest(F.col(f"lo_{a}") - p * F.col("n"), p * F.col("n") - F.col(f"hi_{a}")) > min(p, 1 - p) * F.col("n") * F.col("e") + 1e-9
    beyond = sum((off(a, p).cast("int") for a, p in zip(names, PROBABILITIES, strict=True)), F.lit(0))
    return c.select(F.col("k").alias("key"), F.col("f").alias("field"), "n", beyond.alias("beyond"))


P2 = f"""with {METAR}, {ASCENT}, {OBSERVED},
 x as (select o.obs_id, m.hist_id record_id, m.item_no, row_number() over (partition by o.obs_id order by abs(m.us - o.us), m.us, m.hist_id, m.item_no) rn from o join metar m on m.icao = o.icao and m.us between o.us - 900000000 and o.us + 900000000),
 y as (select o.obs_id, a.sounding_id record_id, a.item_no, row_number() over (partition by a.sounding_id, a.item_no order by abs(o.us - a.us), o.us, o.obs_id) rn from ascent a join o on o.icao = a.icao and o.us between a.us - 2700000000 and a.us + 2700000000)
 select obs_id, 'metar' kind, record_id, item_no from x where rn = 1 union all select obs_id, 'ascent', record_id, item_no from y where rn = 1"""

REAL = "case when not isnan({0}) and abs({0}) <> 9999 and abs({0}) < 1e19 then {0} end"
P1_RANKS = f"""with s as (select 'station|' || nullif(upper(trim(icao)), '') k, {REAL.format('elev')} elev, {REAL.format('t')} t from station_index),
 p as (select variable v, model m, region r, {REAL.format('median')} x from plane_ceiling where variable is not null),
 x as (select k, 'elev' f, elev x from s union all select k, 't', t from s union all select 'variable|' || v, 'median', x from p union all select 'model|' || m || '|' || v, 'median', x from p union all select 'region|' || r || '|' || v, 'median', x from p)
 select k as key, f as field, count(*) n, 0 beyond from x where k is not null and x is not null group by k, f"""

QUERIES = {f.__name__: f for f in (p1_percentiles, p1_month_from_days, p1_ranks, p2_found)}

ORACLE = {"p1_ranks": P1_RANKS, "p2_found": P2}
