"""Projections, filters, scalar functions, orders, sets and key joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..functions.thermo import decibels, dequantised, humidity_from_dew, humidity_from_rh, mean_flux, normal_share, standard_height, theta_e
from ..functions.times import parse_time
from ..operators.joins import classified, corner_weights, prefix_join
from ..operators.stats import exact_percentiles, with_percentiles
from ..tables import entity, number, table
from .readings import ascents
from .registry import registry
from .verification import OBS, good

QUERIES, ORACLE, query = registry()

# --- thermodynamics and scalar functions

Q_SQL = "0.622 * 6.112 * exp(17.67 * td / (td + 243.5)) / (p - 0.378 * 6.112 * exp(17.67 * td / (td + 243.5)))"


@query(f"""with o as (select obs_id, t, td, qnh p from station_index where not isnan(t) and t between -60 and 55 and not isnan(td) and td between -70 and 40 and td <= t and qnh between 850 and 1100),
 a as (select *, greatest({Q_SQL}, 1e-6) q from o), b as (select *, q / (1 - q) r from a), c as (select *, ln(p * r / (0.622 + r) / 6.112) le from b),
 d as (select *, 243.5 * le / (17.67 - le) + 273.15 dew, t + 273.15 tk from c), e as (select *, 1 / (1 / (dew - 56) + ln(tk / dew) / 800) + 56 lcl from d)
 select obs_id, round(q * 1000, 5) q_g, round(tk * pow(1000 / p, 0.2854 * (1 - 0.28 * r)) * exp((3.376 / lcl - 0.00254) * r * 1000 * (1 + 0.00081 * r * 1000)), 4) theta_e from e""")
def fn_theta_e(spark, folder):
    """FN-01, FN-02: equivalent potential temperature from dew point and pressure."""
    o = table(spark, folder, "station_index").where("not isnan(t) and t between -60 and 55 and not isnan(td) and td between -70 and 40 and td <= t and qnh between 850 and 1100")
    q = F.greatest(humidity_from_dew(F.col("td"), F.col("qnh")), F.lit(1e-6))
    return o.select("obs_id", F.round(q * 1000, 5).alias("q_g"), F.round(theta_e(F.col("t"), q, F.col("qnh")), 4).alias("theta_e"))


@query("""with o as (select obs_id, t, 20 + obs_id % 80 rh, 6.112 * exp(17.67 * t / (t + 243.5)) * (20 + obs_id % 80) / 100.0 e from station_index where not isnan(t) and t between -60 and 55)
 select obs_id, round(1000 * 0.622 * e / (850.0 - 0.378 * e), 6) q_g from o""")
def fn_humidity_from_rh(spark, folder):
    """FN-02: specific humidity from relative humidity at 850 hPa."""
    o = table(spark, folder, "station_index").where("not isnan(t) and t between -60 and 55")
    return o.select("obs_id", F.round(1000 * humidity_from_rh(F.col("t"), 20 + F.col("obs_id") % 80, F.lit(850.0)), 6).alias("q_g"))


@query(OBS + """ select obs_id, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(0)) * pow(sin(radians(0 - lon) / 2), 2)))), 6) km from good""")
def fn_haversine(spark, folder):
    """FN-03: distance to 0/0."""
    return good(spark, folder).select("obs_id", F.round(haversine_km(F.col("lat"), F.col("lon"), F.lit(0.0), F.lit(0.0)), 6).alias("km"))


@query(OBS + """, r as (select distinct floor((90 - lat) / 5)::bigint row_no from good)
 select row_no, round(sin(radians(90 - 5 * row_no)) - sin(radians(85 - 5 * row_no)), 9) w_sin, round(cos(radians(87.5 - 5 * row_no)), 9) w_cos from r""")
def fn_cell_weights(spark, folder):
    """FN-04: area weights of grid rows by sine of edges and cosine of centres."""
    r = good(spark, folder).select(F.floor((90 - F.col("lat")) / 5).alias("row_no")).distinct()
    top = 90 - 5 * F.col("row_no")
    return r.select("row_no", F.round(F.sin(F.radians(top)) - F.sin(F.radians(top - 5)), 9).alias("w_sin"), F.round(F.cos(F.radians(top - 2.5)), 9).alias("w_cos"))


@query("""with c as (select distinct floor(clat)::double lat from area_boxes where kind = 'disc'), w as (select lat, lag(lat) over (order by lat) b, lead(lat) over (order by lat) a from c)
 select lat, greatest(-90, case when b is null then lat - (a - lat) / 2 else (lat + b) / 2 end) low, least(90, case when a is null then lat + (lat - b) / 2 else (lat + a) / 2 end) high from w""")
def fn_cell_edges(spark, folder):
    """FN-05: cell edges from centres: midpoints, half steps at the ends, clipped to the poles. One row per grid row."""
    c = table(spark, folder, "area_boxes").where("kind = 'disc'").select(F.floor("clat").cast("double").alias("lat")).distinct()
    w = Window.orderBy("lat")  # the rows of one axis
    c = c.select("lat", F.lag("lat").over(w).alias("b"), F.lead("lat").over(w).alias("a"))
    lat = F.col("lat")
    low = F.when(F.col("b").isNull(), lat - (F.col("a") - lat) / 2).otherwise((lat + F.col("b")) / 2)
    high = F.when(F.col("a").isNull(), lat + (lat - F.col("b")) / 2).otherwise((lat + F.col("a")) / 2)
    return c.select("lat", F.greatest(F.lit(-90.0), low).alias("low"), F.least(F.lit(90.0), high).alias("high"))


@query(OBS + """ select obs_id, round(cos(radians(lat)) * cos(radians(lon)), 9) x, round(cos(radians(lat)) * sin(radians(lon)), 9) y, round(sin(radians(lat)), 9) z,
 round(ws * -sin(radians(wd)), 6) + 0.0 u, round(ws * -cos(radians(wd)), 6) + 0.0 v from good where ws is not null and wd is not null""")
def fn_unit_vectors(spark, folder):
    """FN-06: unit vectors and wind components."""
    g = good(spark, folder).where("ws is not null and wd is not null")
    la, lo, d = F.radians("lat"), F.radians("lon"), F.radians("wd")
    r = lambda x, n, k=9: F.round(x, k).alias(n)
    return g.select("obs_id", r(F.cos(la) * F.cos(lo), "x"), r(F.cos(la) * F.sin(lo), "y"), r(F.sin(la), "z"), r(-F.col("ws") * F.sin(d), "u", 6), r(-F.col("ws") * F.cos(d), "v", 6))


@query("""select reading_id, round(case when accum_hours > 0 then value / (accum_hours * 3600.0) end, 6) w_m2 from field_readings where code = 'rad' and unit in ('J m-2', 'J/m2', 'J m**-2') and value is not null and value <> -9999 and abs(value) < 9e36""")
def fn_mean_flux(spark, folder):
    """FN-07: radiation sums over their declared period only."""
    r = table(spark, folder, "field_readings").where("code = 'rad' and unit in ('J m-2', 'J/m2', 'J m**-2') and value is not null and value <> -9999 and abs(value) < 9e36")
    return r.select("reading_id", F.round(mean_flux(F.col("value"), F.col("accum_hours") * 3600.0), 6).alias("w_m2"))


LEVELS = "with a as (select sounding_id, unnest(soundings) s, generate_subscripts(soundings, 1) - 1 ascent_no from soundings), l as (select sounding_id, ascent_no, unnest(s.p) p, unnest(s.t) t, unnest(s.z) z, unnest(s.sig) sig, generate_subscripts(s.p, 1) - 1 level_no from a)"


def levels(spark, folder):
    """JOIN of parallel arrays by position, one row per level, missing values null."""
    arrays = [F.coalesce(f"a.{c}", F.array().cast("array<int>")).alias(c) for c in ("p", "t", "td", "z", "sig")]  # a null array would null the whole zip
    a = ascents(spark, folder).select("sounding_id", F.col("item_no").alias("ascent_no"), F.posexplode(F.arrays_zip(*arrays)).alias("level_no", "l"))
    return a.select("sounding_id", "ascent_no", "level_no", *(F.nullif(F.col(f"l.{c}"), F.lit(-32768)).alias(c) for c in ("p", "t", "td", "z", "sig")))


@query(LEVELS + " select sounding_id, ascent_no, level_no, round(44330.0 * (1 - pow(p / 100.0 / 1013.25, 0.1903)), 4) height_m from l where p > 0 and p <> -32768")
def fn_standard_height(spark, folder):
    """FN-08, PRJ-02: pressure in Pa to height in the standard atmosphere."""
    return levels(spark, folder).where("p > 0").select("sounding_id", "ascent_no", "level_no", F.round(standard_height(F.col("p") / 100.0), 4).alias("height_m"))


@query()
def fn_normal_share(spark, folder):
    """FN-09: probability of a normal within a threshold, per variable of plane_ceiling, from median and sd. DuckDB has no erf; tested against math.erf."""
    p = table(spark, folder, "plane_ceiling").select("variable", number("median").alias("m"), number("sd").alias("s"), number("mean").alias("a")).where("abs(m) < 1e19 and m <> -9999 and s > 0")
    p = p.select("variable", (F.col("m") - F.col("a")).alias("d"))
    g = with_percentiles(p.groupBy("variable").agg(F.stddev_pop("d").alias("sd"), F.count("*").alias("n")), exact_percentiles(p, ["variable"], {"median": ("d", 0.5)}), ["variable"])
    return g.select("variable", "n", *(F.round(normal_share(F.col("median"), F.col("sd"), F.col("sd") * k), 6).alias(f"within_{k}") for k in (1, 2)))


@query("""with b as (select region, count(*) n, avg((saturated_frac > 0.1)::int) p from plane_ceiling group by region)
 select region, n, a alarm_rate, round(least(1.0, p / a), 6) best_precision, round(1 - least(1.0, p / a), 6) least_false_alarm, round(2 * p, 6) half_precision_rate from b, (values (0.5::double), (0.1::double), (0.01::double), (0.001::double)) v(a) where region is not null""")
def precision_ceiling(spark, folder):
    """FN-10: the best precision that any ranking can have at an alarm rate, from the base rate."""
    b = table(spark, folder, "plane_ceiling").where("region is not null").groupBy("region").agg(F.count("*").alias("n"), F.avg((F.col("saturated_frac") > 0.1).cast("int")).alias("p"))
    x = b.withColumn("alarm_rate", F.explode(F.array(*map(F.lit, (0.5, 0.1, 0.01, 0.001)))))
    best = F.least(F.lit(1.0), F.col("p") / F.col("alarm_rate"))
    return x.select("region", "n", "alarm_rate", F.round(best, 6).alias("best_precision"), F.round(1 - best, 6).alias("least_false_alarm"), F.round(2 * F.col("p"), 6).alias("half_precision_rate"))


@query("""with b as (select avg((saturated_frac > 0.1)::int) p from plane_ceiling), a as (select i, pow(10.0, -5 + 5 * i / 399.0) a from range(400) r(i)) select i, round(a, 9) alarm_rate, round(least(1.0, p / a), 6) best_precision from a, b""")
def precision_curve(spark, folder):
    """R-06: the same over 400 log-spaced alarm rates, exploded from a sequence."""
    b = table(spark, folder, "plane_ceiling").agg(F.avg((F.col("saturated_frac") > 0.1).cast("int")).alias("p"))
    x = b.select("p", F.explode(F.sequence(F.lit(0), F.lit(399))).alias("i")).withColumn("a", F.pow(F.lit(10.0), -5 + 5 * F.col("i") / 399.0))
    return x.select("i", F.round("a", 9).alias("alarm_rate"), F.round(F.least(F.lit(1.0), F.col("p") / F.col("a")), 6).alias("best_precision"))


@query("""select variable, count(*) n, round(sum(0.5 * n * (log2(2 * pi() * exp(1)) + log2(sd * sd))), 2) bits from plane_ceiling where variable is not null and sd > 1e-6 and n > 0 group by variable""")
def fn_code_length(spark, folder):
    """FN-11: Gaussian code length of residuals in bits."""
    p = table(spark, folder, "plane_ceiling").where("variable is not null and sd > 1e-6 and n > 0")
    return p.groupBy("variable").agg(F.count("*").alias("n"), F.round(F.sum(0.5 * F.col("n") * (F.log2(2 * F.pi() * F.exp(F.lit(1.0))) + F.log2(F.col("sd") * F.col("sd")))), 2).alias("bits"))


@query("""select obs_id, substr(sha1(concat_ws('|', upper(trim(icao)), epoch_us(obstime)::varchar, obs_id::varchar)), 1, 16) event_id, sha256(coalesce(category, '')) fingerprint from station_index""")
def fn_event_id(spark, folder):
    """FN-13: ids and fingerprints from joined parts."""
    return table(spark, folder, "station_index").select("obs_id", F.substring(F.sha1(F.concat_ws("|", F.upper(F.trim("icao")), F.unix_micros(F.col("obstime").cast("timestamp")).cast("string"), F.col("obs_id").cast("string"))), 1, 16).alias("event_id"), F.sha2(F.coalesce("category", F.lit("")), 256).alias("fingerprint"))


@query("select item_id, lower(regexp_replace(question, '\\s+', '', 'g')) canonical from eval_items")
def fn_canonical(spark, folder):
    """FN-15: text without white space, lower case."""
    return table(spark, folder, "eval_items").select("item_id", F.lower(F.regexp_replace("question", r"\s+", "")).alias("canonical"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 line_no from documents where text is not null),
 t as (select doc_id, line_no, trim(regexp_replace(line, '^[ *>.0-9-]+', '')) rule from l where contains(line, 'should have'))
 select doc_id, min(line_no) line_no, substr(rule, 1, 60) head from t where length(rule) > 10 group by doc_id, substr(rule, 1, 60)""")
def fn_rule_lines(spark, folder):
    """FN-17: lines that hold a phrase, without leading marks, the first of those that start alike in a text."""
    line = table(spark, folder, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").contains("should have"))
    rule = line.select("doc_id", "line_no", F.trim(F.regexp_replace("line", r"^[ *>.0-9-]+", "")).alias("rule")).where(F.length("rule") > 10)
    return rule.groupBy("doc_id", F.substring("rule", 1, 60).alias("head")).agg(F.min("line_no").alias("line_no"))


@query("""with u as (select doc_id, unnest(regexp_extract_all(text, 'http://[a-z]+[.]example[^ <>]*')) url from documents)
 select url, regexp_extract(url, '^http://([^/]+)', 1) host, regexp_extract(url, '([^/]*)$', 1) leaf, count(*) n from u where url not like '%' || chr(10) || '%' and not regexp_matches(url, '[^ -~]') group by url""")
def fn_url_parts(spark, folder):
    """FN-18: links in texts, their host and last segment."""
    u = table(spark, folder, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"http://[a-z]+[.]example[^ <>]*"), 0)).alias("url")).where(~F.col("url").contains("\n") & ~F.col("url").rlike("[^ -~]"))
    return u.groupBy("url").agg(F.count("*").alias("n")).select("url", F.regexp_extract("url", "^http://([^/]+)", 1).alias("host"), F.regexp_extract("url", "([^/]*)$", 1).alias("leaf"), "n")


@query("""with m as (select hist_id, unnest(metars).time x from station_history), c as (select hist_id, trim(x) x from m where x is not null),
 i as (select hist_id, case when regexp_matches(x, '^[0-9]{8}T') then substr(x,1,4)||'-'||substr(x,5,2)||'-'||substr(x,7,2)||'T'||substr(x,10,2)||':'||substr(x,12,2)||':00'||substr(x,14)
  when regexp_matches(x, '^.{16}(Z|$)') then substr(x,1,16)||':00'||coalesce(nullif(substr(x,17),''),'') else x end x from c)
 select hist_id, count(*) n, count(try_cast(case when regexp_matches(x, '(Z|[+-][0-9]{2}:[0-9]{2})$') then x else x || 'Z' end as timestamptz)) readable, max(epoch_us(try_cast(case when regexp_matches(x, '(Z|[+-][0-9]{2}:[0-9]{2})$') then x else x || 'Z' end as timestamptz))) latest from i group by hist_id""")
def fn_parse_times(spark, folder):
    """FN-19: times in several notations; unreadable ones are null."""
    m = table(spark, folder, "station_history").select("hist_id", F.explode("metars").alias("m")).where("m.time is not null")
    us = F.unix_micros(parse_time(F.col("m.time")))
    return m.groupBy("hist_id").agg(F.count("*").alias("n"), F.count(us).alias("readable"), F.max(us).alias("latest"))


@query("select epoch_us(ts) // 600000000 * 600 round_s, count(*) n from events group by 1")
def fn_cadence_floor(spark, folder):
    """FN-20: times floored to a cadence of ten minutes."""
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, folder, "events").groupBy((F.floor(s / 600) * 600).alias("round_s")).agg(F.count("*").alias("n"))


@query("select o_orderkey, strftime(date_trunc('month', o_orderdate) + interval 6 month, '%Y-%m') target, date_diff('day', date_trunc('month', o_orderdate)::date, (date_trunc('month', o_orderdate) + interval 1 month)::date) n_days, month(o_orderdate) - 1 month_no from orders")
def fn_month_labels(spark, folder):
    """PRJ-10, FN-21: month arithmetic, days of a month, month index."""
    o = table(spark, folder, "orders")
    first = F.trunc("o_orderdate", "month")
    return o.select("o_orderkey", F.date_format(F.add_months(first, 6), "yyyy-MM").alias("target"), F.dayofmonth(F.last_day("o_orderdate")).cast("long").alias("n_days"), (F.month("o_orderdate") - 1).alias("month_no"))


@query("select event_id, json_extract_string(props, '$.k')::int k, coalesce(json_extract_string(props, '$.absent'), 'none') absent from events")
def fn_json_paths(spark, folder):
    """FN-22: JSON paths with defaults."""
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.coalesce(F.get_json_object("props", "$.absent"), F.lit("none")).alias("absent"))


@query("select vec_id, round(list_sum(list_transform(embedding[1:4], lambda x: x::double)), 6) first4, len(embedding[1:64:2]) strided, round(embedding[64]::double, 6) rolled from embeddings")
def fn_array_ops(spark, folder):
    """FN-23: take first n, stride, roll."""
    e = table(spark, folder, "embeddings")
    x = F.col("embedding")
    strided = F.filter(x, lambda v, i: i % 2 == 0)
    rolled = F.concat(F.slice(x, -1, 1), F.slice(x, 1, F.size(x) - 1))
    return e.select("vec_id", F.round(F.aggregate(F.slice(x, 1, 4), F.lit(0.0), lambda a, v: a + v.cast("double")), 6).alias("first4"), F.size(strided).alias("strided"), F.round(rolled[0].cast("double"), 6).alias("rolled"))


@query(LEVELS + """ select b bit, count(*) filter (sig & b <> 0) n, count(*) filter (sig = 0) unflagged, count(*) levels from l, (values (16384), (8192), (4096), (2048), (1024), (512)) v(b) where sig <> -32768 group by b""")
def fn_flag_bits(spark, folder):
    """FN-24: bits of significance words."""
    s = levels(spark, folder).where("sig is not null").select("sig", F.explode(F.array(*[F.lit(1 << i) for i in range(9, 15)])).alias("bit"))
    return s.groupBy("bit").agg(F.count(F.when(F.col("sig").bitwiseAND(F.col("bit")) != 0, 1)).alias("n"), F.count(F.when(F.col("sig") == 0, 1)).alias("unflagged"), F.count("*").alias("levels"))


@query("select s_suppkey, (3 * (s_suppkey % 50) - 4 * (s_suppkey % 7))::bigint x_num, (4 * (s_suppkey % 50) + 3 * (s_suppkey % 7))::bigint y_num, 5 den, ((3 * (s_suppkey % 50) - 4 * (s_suppkey % 7)) * (3 * (s_suppkey % 50) - 4 * (s_suppkey % 7)) + (4 * (s_suppkey % 50) + 3 * (s_suppkey % 7)) * (4 * (s_suppkey % 50) + 3 * (s_suppkey % 7)) = 25 * ((s_suppkey % 50) * (s_suppkey % 50) + (s_suppkey % 7) * (s_suppkey % 7))) exact from supplier")
def fn_rational_rotation(spark, folder):
    """FN-25: a rational rotation (3/5, 4/5) in whole numbers keeps length exactly."""
    s = table(spark, folder, "supplier").select("s_suppkey", (F.col("s_suppkey") % 50).alias("x"), (F.col("s_suppkey") % 7).alias("y"))
    xn, yn = 3 * F.col("x") - 4 * F.col("y"), 4 * F.col("x") + 3 * F.col("y")
    return s.select("s_suppkey", xn.alias("x_num"), yn.alias("y_num"), F.lit(5).alias("den"), (xn * xn + yn * yn == 25 * (F.col("x") * F.col("x") + F.col("y") * F.col("y"))).alias("exact"))


# --- projections and filters


@query("select obs_id, case when wd <> 255 and wd <= 250 then (0.5 + wd * 0.25)::double end value from station_index where wd is not null")
def prj_dequantise(spark, folder):
    """PRJ-01: linear dequantisation with validity."""
    return table(spark, folder, "station_index").where("wd is not null").select("obs_id", dequantised(F.col("wd"), 0.5, 0.25, 255, 250).alias("value"))


@query("select obs_id, round(case when vis > 0 then 10 * log10(vis) end, 6) db from station_index")
def prj_decibels(spark, folder):
    """SRC-19: decibels of positive values."""
    return table(spark, folder, "station_index").select("obs_id", F.round(decibels(F.col("vis")), 6).alias("db"))


@query("select reading_id, case when isnan(try_cast(regexp_extract(value_text, '[-0-9.]+') as double)) then null else try_cast(regexp_extract(value_text, '[-0-9.]+') as double) end x from field_readings where value_text is not null")
def prj_safe_float(spark, folder):
    """PRJ-04: a safe cast; what isn't finite is null."""
    return table(spark, folder, "field_readings").where("value_text is not null").select("reading_id", number(F.regexp_extract("value_text", "[-0-9.]+", 0).try_cast("double")).alias("x"))


@query("select code, count(*) n, count(*) filter (value < 1e-7) floored, round(sum(ln(greatest(value, 1e-7))), 4) log_sum from field_readings where value between 0 and 9e35 and not isnan(value) group by code")
def prj_log_floor(spark, folder):
    """PRJ-05: logarithms with a floor, floored values counted."""
    r = table(spark, folder, "field_readings").where("value between 0 and 9e35 and not isnan(value)")
    return r.groupBy("code").agg(F.count("*").alias("n"), F.count_if(F.col("value") < 1e-7).alias("floored"), F.round(F.sum(F.ln(F.greatest("value", F.lit(1e-7)))), 4).alias("log_sum"))


@query("select obs_id from station_index where lat between -30.5 and 30.5 and lon between -60 and 60")
def flt_box_closed(spark, folder):
    """FLT-01: an inclusive box."""
    return table(spark, folder, "station_index").where("lat between -30.5 and 30.5 and lon between -60 and 60").select("obs_id")


@query("select obs_id from station_index where lat >= -30.5 and lat < 30.5 and lon >= -60 and lon < 60")
def flt_box_half_open(spark, folder):
    """FLT-02: a box open to the north and east."""
    return table(spark, folder, "station_index").where("lat >= -30.5 and lat < 30.5 and lon >= -60 and lon < 60").select("obs_id")


@query(OBS + """ select area_id, count(*) filter (lat >= south and lat <= north and case when west > east then lon >= west or lon <= east else lon >= west and lon <= east end) n, count(*) total,
 count(*) filter (lat >= south and lat <= north and case when west > east then lon >= west or lon <= east else lon >= west and lon <= east end) between 1 and count(*) / 2 accepted
 from good, (select area_id, case when west >= 180 then west - 360 else west end west, case when east >= 180 then east - 360 else east end east, south, north from area_boxes where kind = 'box') group by area_id""")
def flt_seam_box(spark, folder):
    """FLT-03: boxes across the seam are unions; selections of nothing or over half are refused. Rows are counted per position first, positions meet the boxes in cells of five degrees."""
    wrap = lambda c: F.when(c >= 180, c - 360).otherwise(c)
    b = table(spark, folder, "area_boxes").where("kind = 'box'").select("area_id", wrap(F.col("west")).alias("west"), wrap(F.col("east")).alias("east"), "south", "north")
    cell = lambda v, low: F.floor((v + low) / 5).cast("long")
    cells = lambda a, z: F.sequence(a, z)
    west, east, last = cell(F.col("west"), 180), cell(F.col("east"), 180), F.lit(72).cast("long")
    across = F.when(F.col("west") > F.col("east"), F.concat(cells(west, last), cells(F.lit(0).cast("long"), east))).otherwise(cells(west, east))
    cover = b.withColumn("_q", F.explode(F.array_distinct(across))).withColumn("_r", F.explode(cells(cell(F.col("south"), 90), cell(F.col("north"), 90))))
    g = good(spark, folder).groupBy("lat", "lon").agg(F.count("*").alias("k")).withColumn("_q", cell(F.col("lon"), 180)).withColumn("_r", cell(F.col("lat"), 90))
    lon, lat, w, e = F.col("lon"), F.col("lat"), F.col("west"), F.col("east")
    inside = lat.between(F.col("south"), F.col("north")) & F.when(w > e, (lon >= w) | (lon <= e)).otherwise((lon >= w) & (lon <= e))
    hit = cover.join(g, ["_q", "_r"]).where(inside).groupBy("area_id").agg(F.sum("k").alias("n"))
    total = g.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("total")).where("total > 0")  # one row
    n = F.coalesce("n", F.lit(0))
    return b.select("area_id").join(hit, "area_id", "left").crossJoin(total).select("area_id", n.alias("n"), "total", ((n >= 1) & (n <= F.col("total") / 2)).alias("accepted"))


@query("""select code, min(value) low, max(value) high, count(*) n, count(*) > 0 and min(value) >= -1e5 and max(value) <= 1.2e6 passed from field_readings where value is not null and not isnan(value) and value <> -9999 and abs(value) < 9e36 group by code""")
def flt_range_guard(spark, folder):
    """FLT-05: declared range of a column, finite values only; none is a failure."""
    r = table(spark, folder, "field_readings").select("code", number("value").alias("value")).where("value is not null and value <> -9999 and abs(value) < 9e36")
    return r.groupBy("code").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"), ((F.count("*") > 0) & (F.min("value") >= -1e5) & (F.max("value") <= 1.2e6)).alias("passed"))


@query(OBS + """ select v.code, count(*) n, count(*) filter (case domain when 'above_ground' then qnh >= level_hpa when 'land' then elev >= 50 when 'surface' then true end) applicable from good, variables v where qnh is not null and elev is not null group by v.code""")
def flt_domain_mask(spark, folder):
    """FLT-06: where a variable applies: above ground, over land, everywhere."""
    v = table(spark, folder, "variables").select("code", "domain", "level_hpa")  # 13 rows, fixed
    g = good(spark, folder).where("qnh is not null and elev is not null").groupBy("qnh", (F.col("elev") >= 50).alias("land")).agg(F.count("*").alias("k"))  # rows first become counts per pressure
    ok = F.when(F.col("domain") == "above_ground", F.col("qnh") >= F.col("level_hpa")).when(F.col("domain") == "land", F.col("land")).when(F.col("domain") == "surface", True)
    return g.crossJoin(F.broadcast(v)).groupBy("code").agg(F.sum("k").alias("n"), F.coalesce(F.sum(F.when(ok, F.col("k"))), F.lit(0)).alias("applicable"))


@query("""with d as (select region, bool_and(not isnan(median) and median < 1e19 and median <> -9999) fixed from plane_ceiling where run < '2014011500' and region is not null and median is not null group by region)
 select p.region, d.fixed, count(*) n from plane_ceiling p join d on p.region = d.region where run >= '2014011500' group by all""")
def flt_training_domain(spark, folder):
    """FLT-07: the domain is fixed by the training period and applied to later rows."""
    p = table(spark, folder, "plane_ceiling").where("region is not null")
    ok = ~F.isnan("median") & (F.col("median") < 1e19) & (F.col("median") != -9999)
    d = p.where("run < '2014011500' and median is not null").groupBy("region").agg(F.bool_and(ok).alias("fixed"))
    return p.where("run >= '2014011500'").join(d, "region").groupBy("region", "fixed").agg(F.count("*").alias("n"))


@query("""select item, case when item like '%00' then 'denied' when item like 'auster%' or variable in ('mslp') then 'allowed' else 'ignored' end policy, count(*) n from plane_ceiling where item is not null and variable is not null group by all""")
def flt_asset_policy(spark, folder):
    """FLT-08: suffix and name policies; denial wins."""
    p = table(spark, folder, "plane_ceiling").where("item is not null and variable is not null")
    policy = F.when(F.col("item").endswith("00"), "denied").when(F.col("item").startswith("auster") | F.col("variable").isin("mslp"), "allowed").otherwise("ignored")
    return p.groupBy("item", policy.alias("policy")).agg(F.count("*").alias("n"))


@query("""select variable, count(*) n, count(*) filter (vmax >= ceiling - 1e-6) at_ceiling, round(avg((vmax >= ceiling - 1e-6)::int), 6) share, round(avg((saturated_frac > 0)::int), 6) saturated from plane_ceiling where variable is not null and ceiling is not null and vmax is not null group by variable""")
def flt_saturation(spark, folder):
    """FLT-10, AGG-23: values at their ceiling."""
    p = table(spark, folder, "plane_ceiling").where("variable is not null and ceiling is not null and vmax is not null")
    top = F.col("vmax") >= F.col("ceiling") - 1e-6
    return p.groupBy("variable").agg(F.count("*").alias("n"), F.count_if(top).alias("at_ceiling"), F.round(F.avg(top.cast("int")), 6).alias("share"), F.round(F.avg((F.col("saturated_frac") > 0).cast("int")), 6).alias("saturated"))


@query("""select case when unit is null and note is null and value_text is null then 'no unit' when value is null and value_text is null then 'no value' when value in (-9999) or abs(value) > 9e36 then 'filler' else 'ok' end state, count(*) n from field_readings group by 1""")
def flt_quarantine(spark, folder):
    """FLT-11: rows that break a constraint are named, not dropped."""
    state = F.when(F.expr("unit is null and note is null and value_text is null"), "no unit").when(F.expr("value is null and value_text is null"), "no value").when(F.expr("value in (-9999) or abs(value) > 9e36"), "filler").otherwise("ok")
    return table(spark, folder, "field_readings").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query(LEVELS + """, c as (select l.*, row_number() over (partition by sounding_id, ascent_no order by p desc, level_no) rn from l join (select sounding_id, elev from soundings) s using (sounding_id) where p <> -32768 and z <> -32768 and not isnan(elev) and abs(z - elev) <= 150)
 select sounding_id, ascent_no, level_no, p from c where rn = 1""")
def flt_surface_level(spark, folder):
    """FLT-12: within a nested array, the level near the station's height with the greatest pressure, the first on ties."""
    s = table(spark, folder, "soundings").select("sounding_id", number("elev").alias("elev"), F.posexplode("soundings").alias("ascent_no", "a"))
    zipped = F.transform(F.arrays_zip("a.p", "a.z"), lambda x, i: F.struct(x["p"].alias("p"), (-i).alias("i"), x["z"].alias("z")))
    near = F.filter(zipped, lambda x: (x["p"] != -32768) & (x["z"] != -32768) & (F.abs(x["z"] - F.col("elev")) <= 150))
    return s.withColumn("m", F.array_max(near)).where("m is not null").select("sounding_id", "ascent_no", (-F.col("m.i")).alias("level_no"), F.col("m.p").alias("p"))


# --- orders and sets


@query("""with c as (select o_orderpriority run, o_orderkey, o_totalprice, row_number() over (partition by o_orderpriority order by o_totalprice, o_orderkey) lo, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey desc) hi from orders)
 select run, o_orderkey, o_totalprice from c where lo <= 4 or hi <= 4""")
def sort_extremes(spark, folder):
    """SORT-01: the four least and four greatest of each group; ranks limit each group before the shuffle."""
    o = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("run"), "o_orderkey", "o_totalprice")
    w = Window.partitionBy("run")
    pick = lambda *order: o.withColumn("rn", F.row_number().over(w.orderBy(*order))).where("rn <= 4").drop("rn")
    return pick("o_totalprice", "o_orderkey").union(pick(F.desc("o_totalprice"), F.desc("o_orderkey"))).distinct()


@query("select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 6")
def sort_top_k(spark, folder):
    """SORT-02: the strongest six."""
    return table(spark, folder, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(6).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("select event_id, epoch_us(ts) us from events order by ts desc, event_id desc limit 20")
def sort_latest_n(spark, folder):
    """SORT-03: the latest twenty."""
    return table(spark, folder, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@query("select plane_id, row_number() over (partition by run order by case when variable = 'tmp500' then 0 else 1 end, plane_id) place from plane_ceiling")
def sort_priority(spark, folder):
    """SORT-04: perishable first, else in order, within each run."""
    w = Window.partitionBy("run").orderBy(F.when(F.col("variable") == "tmp500", 0).otherwise(1), "plane_id")
    return table(spark, folder, "plane_ceiling").select("plane_id", F.row_number().over(w).alias("place"))


@query("select l_suppkey, arg_min(l_orderkey, (l_discount, l_orderkey)) best, min(l_discount) least from lineitem group by l_suppkey")
def sort_argmin(spark, folder):
    """SORT-05: argmin with the earliest on ties."""
    return table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.min_by("l_orderkey", F.struct("l_discount", "l_orderkey")).alias("best"), F.min("l_discount").alias("least"))


@query("""with f as (select run, variable, min(plane_id) first_id from plane_ceiling where variable is not null group by run, variable) select run, variable, dense_rank() over (partition by run order by first_id) label from f""")
def sort_canonical_labels(spark, folder):
    """SORT-06: labels by first occurrence, the same whatever the names."""
    f = table(spark, folder, "plane_ceiling").where("variable is not null").groupBy("run", "variable").agg(F.min("plane_id").alias("first_id"))
    return f.select("run", "variable", F.dense_rank().over(Window.partitionBy("run").orderBy("first_id")).alias("label"))


@query("""with e as (select distinct user_id, ts::date d from events), need as (select user_id, unnest(generate_series(date '2024-01-01', date '2024-01-30', interval 1 day))::date d from (select distinct user_id from events))
 select need.user_id, strftime(need.d, '%Y-%m-%d') d from need left join e on need.user_id = e.user_id and need.d = e.d where e.d is null""")
def set_missing_days(spark, folder):
    """SET-01, SET-05, JOIN-10: expected days less those there, by an anti-join."""
    e = table(spark, folder, "events").select("user_id", F.to_date("ts").alias("d"))
    need = e.select("user_id").distinct().select("user_id", F.explode(F.expr("sequence(date'2024-01-01', date'2024-01-30', interval 1 day)")).alias("d"))
    return need.join(e.distinct(), ["user_id", "d"], "left_anti").select("user_id", F.date_format("d", "yyyy-MM-dd").alias("d"))


@query("select region from (select distinct region, model from plane_ceiling where region is not null and model is not null) group by region having count(*) = (select count(distinct model) from plane_ceiling)")
def set_shared_regions(spark, folder):
    """SET-02: regions that all models have."""
    p = table(spark, folder, "plane_ceiling").where("region is not null and model is not null")
    models = p.agg(F.countDistinct("model").alias("k"))
    return p.groupBy("region").agg(F.countDistinct("model").alias("n")).join(F.broadcast(models), F.col("n") == F.col("k")).select("region")


@query("select hour(ts) h from events where event_type = 'error' union select hour(ts) from events where event_type = 'signup'")
def set_union_hours(spark, folder):
    """SET-03: a union of keys."""
    e = table(spark, folder, "events")
    return e.where("event_type = 'error'").select(F.hour("ts").alias("h")).union(e.where("event_type = 'signup'").select(F.hour("ts"))).distinct()


@query("""with a as (select distinct user_id from events where event_type = 'purchase'), b as (select distinct user_id from events where event_type = 'signup')
 select user_id, 'purchase' side from a where user_id not in (select user_id from b) union all select user_id, 'signup' from b where user_id not in (select user_id from a)""")
def set_symmetric_difference(spark, folder):
    """SET-04: keys on one side only, by anti-joins both ways."""
    e = table(spark, folder, "events")
    a, b = (e.where(F.col("event_type") == t).select("user_id").distinct() for t in ("purchase", "signup"))
    return a.join(b, "user_id", "left_anti").withColumn("side", F.lit("purchase")).union(b.join(a, "user_id", "left_anti").withColumn("side", F.lit("signup")))


@query("""select raw_id, list_sort(list_filter(['metars', 'soundings'], lambda f: not list_contains(json_keys(payload), f))) missing, len(list_filter(json_keys(payload), lambda f: f not in ('icao', 'wmo', 'lat', 'lon', 'elev', 'metars', 'soundings', 'taf'))) extra from raw_records where json_valid(payload)""")
def set_field_violations(spark, folder):
    """SET-06, VER-04: missing and extra fields of readable records."""
    r = table(spark, folder, "raw_records").select("raw_id", F.json_object_keys("payload").alias("k"), F.try_parse_json("payload").alias("v")).where("v is not null and k is not null")
    known = F.array(*map(F.lit, ("icao", "wmo", "lat", "lon", "elev", "metars", "soundings", "taf")))
    return r.select("raw_id", F.array_sort(F.array_except(F.array(F.lit("metars"), F.lit("soundings")), "k")).alias("missing"), F.size(F.array_except("k", known)).cast("long").alias("extra"))


@query("""with a as (select icao, obstime, t, count(*) n from (select upper(trim(icao)) icao, obstime, t from station_index where obs_id % 2 = 0) group by all), b as (select icao, obstime, t, count(*) n from (select upper(trim(icao)) icao, obstime, t from station_index where obs_id % 2 = 1) group by all)
 select sum(greatest(a.n - coalesce(b.n, 0), 0))::bigint only_even from a left join b on a.icao = b.icao and a.obstime = b.obstime and a.t is not distinct from b.t""")
def set_bag_difference(spark, folder):
    """SET-07, JOIN-16: difference of bags, duplicates counted, over two halves of the table."""
    s = table(spark, folder, "station_index").where("icao is not null").select("obs_id", F.upper(F.trim("icao")).alias("icao"), "obstime", "t")
    even, odd = (s.where(F.col("obs_id") % 2 == i).select("icao", "obstime", "t") for i in (0, 1))
    return even.exceptAll(odd).agg(F.count("*").alias("only_even"))


# --- key joins and audits


@query("""with a as (select coalesce(hour(ts), -1) h, count(*) n from events where event_type = 'purchase' group by 1), b as (select coalesce(hour(ts), -1) h, count(*) n from events where event_type = 'signup' group by 1)
 select coalesce(a.h, b.h) h, coalesce(a.n, 0) purchases, coalesce(b.n, 0) signups from a full join b on a.h = b.h""")
def join_full_outer_hist(spark, folder):
    """JOIN-13: two histograms, absent hours as 0."""
    e = table(spark, folder, "events").withColumn("h", F.coalesce(F.hour("ts"), F.lit(-1)))
    a, b = (e.where(F.col("event_type") == k).groupBy("h").agg(F.count("*").alias(k)) for k in ("purchase", "signup"))
    return a.join(b, "h", "full").select("h", F.coalesce("purchase", F.lit(0)).alias("purchases"), F.coalesce("signup", F.lit(0)).alias("signups"))


QUERIES["join_full_outer_hist_all"], ORACLE["join_full_outer_hist_all"] = join_full_outer_hist, ORACLE["join_full_outer_hist"]  # name of the last round, the same work


@query("""select v.code, v.name, count(r.reading_id) n, count(r.reading_id) > 0 present from variables v left join (select * from field_readings where source = 'arcus' and value is not null) r on r.code = v.code group by all""")
def join_registry_presence(spark, folder):
    """JOIN-12, SRC-17: a registry against what is there."""
    v = table(spark, folder, "variables").select("code", "name")
    n = table(spark, folder, "field_readings").where("source = 'arcus' and value is not null").groupBy("code").agg(F.count("*").alias("n"))
    return v.join(n, "code", "left").select("code", "name", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("present"))


@query("""with have as (select run, list(distinct variable) v from plane_ceiling where variable is not null group by run) select run, len(list_filter(['mslp', 'tmp500'], lambda x: not list_contains(v, x))) = 0 complete, list_sort(list_filter(['mslp', 'tmp500'], lambda x: not list_contains(v, x))) missing from have""")
def join_channel_requirements(spark, folder):
    """JOIN-14: required variables contained in those available; a missing one blocks."""
    have = table(spark, folder, "plane_ceiling").where("variable is not null").groupBy("run").agg(F.collect_set("variable").alias("v"))
    missing = F.array_sort(F.array_except(F.array(F.lit("mslp"), F.lit("tmp500")), "v"))
    return have.select("run", (F.size(missing) == 0).alias("complete"), missing.alias("missing"))


@query("""with p as (select doc_id, n_chars sz, sha256(coalesce(text, '')) h from documents), t as (select doc_id, case when doc_id % 11 = 0 then sz + 1 else sz end sz, case when doc_id % 7 = 0 then 'x' else h end h from p where doc_id % 13 <> 0)
 select p.doc_id, case when t.doc_id is null then 'missing' when p.sz is distinct from t.sz then 'size' when p.h <> t.h then 'hash' else 'ok' end state from p left join t using (doc_id)""")
def join_plan_vs_target(spark, folder):
    """JOIN-17, SNK-04, SNK-07, VER-06: a plan against a target: ok, size, hash or missing."""
    p = table(spark, folder, "documents").select("doc_id", F.col("n_chars").alias("sz"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    t = p.where("doc_id % 13 <> 0").select("doc_id", F.when(F.col("doc_id") % 11 == 0, F.col("sz") + 1).otherwise(F.col("sz")).alias("sz"), F.when(F.col("doc_id") % 7 == 0, F.lit("x")).otherwise(F.col("h")).alias("h"))
    return classified(p, t, "doc_id", "sz", "h")


TOKENS = "tok as (select obs_id, substr(sha256((obs_id % 400)::varchar), 1, case obs_id % 4 when 0 then 8 when 1 then 12 when 2 then 16 else 9 end) token from station_index)"


@query("with " + TOKENS + """, reg as (select item_id, sha256(item_id::varchar) h from eval_items), pre as (select substr(h, 1, n) p, min(item_id) item_id from reg, (values (8), (12), (16), (24), (32), (48)) v(n) group by 1)
 select obs_id, item_id from tok join pre on token = p""")
def join_prefix_registry(spark, folder):
    """JOIN-18, VER-07: truncated digests joined to a registry by its prefixes."""
    s = table(spark, folder, "station_index").select("obs_id", F.sha2((F.col("obs_id") % 400).cast("string"), 256).alias("h"), (F.col("obs_id") % 4).alias("m"))
    n = F.when(F.col("m") == 0, 8).when(F.col("m") == 1, 12).when(F.col("m") == 2, 16).otherwise(9)
    tokens = s.select("obs_id", F.substring("h", F.lit(1), n).alias("token"))
    reg = table(spark, folder, "eval_items").select("item_id", F.sha2(F.col("item_id").cast("string"), 256).alias("h"))
    return prefix_join(tokens, "token", reg, "h", "item_id", [8, 12, 16, 24, 32, 48]).select("obs_id", "item_id")


@query("""with m as (select hour(ts) h, count(*) filter (event_type = 'view') a, count(*) filter (event_type = 'click') b from events group by 1),
 s as (select o.off, sg.sign, sum(abs(x.a - sg.sign * y.b)) loss from (values (0), (1), (2), (3), (6)) o(off), (values (1), (-1)) sg(sign), m x, m y where y.h = (x.h + o.off) % 24 group by all),
 r as (select *, row_number() over (order by loss, off, sign) rn from s)
 select count(*) hypotheses, max(off) filter (rn = 1) best_off, max(sign) filter (rn = 1) best_sign, max(loss) filter (rn = 1)::bigint best_loss, (min(loss) filter (off <> (select off from r where rn = 1)) - max(loss) filter (rn = 1))::bigint margin from r""")
def join_hypothesis_sweep(spark, folder):
    """JOIN-21: offsets and signs scored over hourly profiles; the best against the best of another offset. 24 rows by 10 literals."""
    e = table(spark, folder, "events")
    m = e.groupBy(F.hour("ts").alias("h")).agg(F.count_if(F.col("event_type") == "view").alias("a"), F.count_if(F.col("event_type") == "click").alias("b"))
    x = m.select("h", "a", F.explode(F.array(*map(F.lit, (0, 1, 2, 3, 6)))).alias("off")).select("*", F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign"))
    s = x.withColumn("k", (F.col("h") + F.col("off")) % 24).join(m.select(F.col("h").alias("k"), "b"), "k").groupBy("off", "sign").agg(F.sum(F.abs(F.col("a") - F.col("sign") * F.col("b"))).alias("loss"))
    best = s.agg(F.count("*").alias("hypotheses"), F.min(F.struct("loss", "off", "sign")).alias("m"))
    rival = s.join(F.broadcast(best)).where(F.col("off") != F.col("m.off")).agg(F.min("loss").alias("rival"))
    return best.join(F.broadcast(rival)).select("hypotheses", F.col("m.off").alias("best_off"), F.col("m.sign").alias("best_sign"), F.col("m.loss").alias("best_loss"), (F.col("rival") - F.col("m.loss")).alias("margin"))


@query(OBS + """, f as (select floor((lat + 90) / 10)::bigint i, floor((lon + 180) / 10)::bigint j, avg(t) v from good group by all),
 c as (select obs_id, (lat + 90) / 10 y, (lon + 180) / 10 x from good), k as (select obs_id, floor(y)::bigint + a i, floor(x)::bigint + b j, (case a when 1 then y - floor(y) else 1 - (y - floor(y)) end) * (case b when 1 then x - floor(x) else 1 - (x - floor(x)) end) w from c, (values (0), (1)) p(a), (values (0), (1)) q(b))
 select obs_id, count(*) corners, round(sum(v * w) / nullif(sum(w), 0), 5) value from k join f on k.i = f.i and k.j % 36 = f.j group by obs_id having sum(w) > 1e-9""")
def join_bilinear(spark, folder):
    """JOIN-22: bilinear sampling of a grid: four corner keys per point joined by equality; longitude wraps, absent corners are left out."""
    g = good(spark, folder)
    f = g.groupBy(F.floor((F.col("lat") + 90) / 10).alias("i"), F.floor((F.col("lon") + 180) / 10).alias("j")).agg(F.avg("t").alias("v"))
    k = g.select("obs_id", F.explode(corner_weights((F.col("lat") + 90) / 10, (F.col("lon") + 180) / 10)).alias("c")).select("obs_id", F.col("c.i").alias("i"), F.pmod(F.col("c.j"), F.lit(36)).alias("j"), F.col("c.w").alias("w"))
    s = k.join(f, ["i", "j"]).groupBy("obs_id").agg(F.count("*").alias("corners"), F.sum(F.col("v") * F.col("w")).alias("s"), F.sum("w").alias("w"))
    return s.where("w > 1e-9").select("obs_id", "corners", F.round(F.col("s") / F.col("w"), 5).alias("value"))


@query("""with a as (select icao, obstime, t from (select upper(trim(icao)) icao, obstime, t, obs_id from station_index) where obs_id % 3 < 2), b as (select upper(trim(icao)) icao, obstime, t from station_index where obs_id % 3 > 0), u as (select * from a union all select * from b)
 select count(*) keys, count(*) filter (lo is distinct from hi or (nn > 0 and nn < n)) conflicts from (select icao, obstime, min(t) lo, max(t) hi, count(*) n, count(t) nn from u group by icao, obstime)""")
def join_window_merge(spark, folder):
    """JOIN-06, ST-07: overlapping windows merged on their key, with agreement audited."""
    s = table(spark, folder, "station_index").select(entity("icao").alias("icao"), "obstime", "t", "obs_id")
    u = s.where("obs_id % 3 < 2").unionByName(s.where("obs_id % 3 > 0"))
    k = u.groupBy("icao", "obstime").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n"), F.count("t").alias("nn"))
    return k.agg(F.count("*").alias("keys"), F.count_if(~F.col("lo").eqNullSafe(F.col("hi")) | ((F.col("nn") > 0) & (F.col("nn") < F.col("n")))).alias("conflicts"))


@query("""select icao, n, bytes, spans, round(bytes / nullif(total, 0), 6) share from (select upper(trim(icao)) icao, count(*) n, sum(byte_length)::bigint bytes, count(distinct byte_offset) spans, max(byte_offset + byte_length) total from station_index where byte_length is not null group by 1)""")
def ver_read_cost(spark, folder):
    """JOIN-11, VER-13: bytes that an index sends a reader to, against the whole."""
    s = table(spark, folder, "station_index").where("byte_length is not null").groupBy(F.upper(F.trim("icao")).alias("icao"))
    a = s.agg(F.count("*").alias("n"), F.sum("byte_length").alias("bytes"), F.countDistinct("byte_offset").alias("spans"), F.max(F.col("byte_offset") + F.col("byte_length")).alias("total"))
    return a.select("icao", "n", "bytes", "spans", F.round(F.try_divide("bytes", "total"), 6).alias("share"))
