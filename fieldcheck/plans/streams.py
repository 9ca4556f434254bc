"""Streaming queries; each has the batch query that it must equal as its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import flows
from ..tables import entity, table
from .registry import registry

QUERIES, ORACLE, query = registry()


def place(spark) -> str:
    return f"{shared_folder(spark)}/flow-{uuid.uuid4().hex}"


def events(spark, folder):
    return flows.table_stream(spark, folder, "events").withColumn("at", F.col("ts").cast("timestamp"))


@query("select epoch(date_trunc('hour', ts))::bigint start_s, event_type, count(*) n, round(sum(value), 4) total from events group by all")
def stream_tumbling(spark, folder):
    """ST-12: hourly counts."""
    w = flows.windowed(events(spark, folder), "at", ["event_type"], "1 hour", None, "value", "2 days")
    return flows.latest(flows.appended(w, place(spark), "update"), ["start", "event_type"]).select(F.unix_seconds("start").alias("start_s"), "event_type", "n", F.round("total", 4).alias("total"))


@query("select (epoch(date_trunc('hour', ts))::bigint - k * 3600) start_s, count(*) n, round(sum(value), 4) total from events, range(24) r(k) group by 1")
def stream_sliding(spark, folder):
    """ST-13: windows of 24 hours that slide by one."""
    w = flows.windowed(events(spark, folder), "at", [], "24 hours", "1 hour", "value", "2 days")
    return flows.latest(flows.appended(w, place(spark), "update"), ["start"]).select(F.unix_seconds("start").alias("start_s"), "n", F.round("total", 4).alias("total"))


@query("""with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hour then 0 else 1 end fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts) k from e)
 select user_id, epoch_us(min(ts)) start_us, epoch_us(max(ts)) + 7200000000 end_us, count(*) n from s group by user_id, k""")
def stream_sessions(spark, folder):
    """ST-14: sessions with a gap of two hours; the whole result of the last batch."""
    s = flows.appended(flows.sessions(events(spark, folder), "at", ["user_id"], "2 hours", "2 days"), place(spark), "complete")
    return s.join(F.broadcast(s.agg(F.max("batch").alias("batch"))), "batch").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("select event_type, count(distinct (user_id, date_trunc('hour', ts))) n from events group by event_type")
def stream_dedupe(spark, folder):
    """ST-02: one row per user, kind and hour, whatever comes again."""
    e = events(spark, folder).withColumn("h", F.date_trunc("hour", "at"))
    d = flows.deduplicated(e, ["user_id", "event_type", "h"], "at", "60 days")
    return flows.appended(d.select("event_type", "user_id", "h"), place(spark)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""with r as (select model || '|' || variable || '|' || region k, plane_id, case when median is null or isnan(median) then null else median end v from plane_ceiling where model is not null and variable is not null and region is not null),
 g as (select *, v between 200 and 120000 ok from r), s as (select *, sum(coalesce(ok, false)::int) over (partition by k order by plane_id) before from g)
 select k, plane_id, case when not coalesce(ok, false) then 'refused_range_failure' when before = 1 then 'written' else 'duplicate_skipped' end status from s""")
def stream_freeze_states(spark, folder):
    """ST-03, ST-05: a run is frozen once; refused runs may be tried again."""
    p = flows.table_stream(spark, folder, "plane_ceiling").where("model is not null and variable is not null and region is not null")
    p = p.select(F.concat_ws("|", "model", "variable", "region").alias("k"), "plane_id", F.when(~F.isnan("median"), F.col("median")).alias("v"))
    return flows.frozen(p, "k", "plane_id", "v", 200.0, 120000.0, place(spark)).select("k", "plane_id", "status")


@query("""with r as (select model || '|' || variable || '|' || region k, plane_id, case when median is null or isnan(median) then null else median end v from plane_ceiling where model is not null and variable is not null and region is not null),
 g as (select *, coalesce(v between 200 and 120000, false) ok from r) select count(*) probed, count(distinct case when ok then k end) written, count(*) filter (ok) - count(distinct case when ok then k end) skipped, count(*) filter (not ok) refused, true gates_held, 0 exit_state from g""")
def stream_cycle(spark, folder):
    """ST-04: cycles of probing, freezing and verifying under a digest gate on all that was frozen before; totals over the batches, and the state of the first."""
    p = flows.table_stream(spark, folder, "plane_ceiling").where("model is not null and variable is not null and region is not null")
    p = p.select(F.concat_ws("|", "model", "variable", "region").alias("k"), "plane_id", F.when(~F.isnan("median"), F.col("median")).alias("v"))
    s = flows.cycle(p, "k", "plane_id", "v", 200.0, 120000.0, place(spark))
    return s.agg(*(F.sum(c).alias(c) for c in ("probed", "written", "skipped", "refused")), F.bool_and("gate_ok").alias("gates_held"), F.min_by("exit_state", "batch").alias("exit_state"))


@query("""with k as (select upper(trim(icao)) icao, obstime, count(*) n, max(t) > min(t) off from station_index where trim(icao) <> '' and obstime is not null and not isnan(t) group by all)
 select icao, count(*) times, sum(n - 1)::bigint copies, count(*) filter (off) conflicts from k group by icao""")
def stream_window_merge(spark, folder):
    """ST-07: overlapping rebuilds of a station's series merged in a stream, with the copies that agree and the times at which they don't."""
    s = flows.table_stream(spark, folder, "station_index").select(entity("icao").alias("icao"), F.col("obstime").cast("timestamp").alias("at"), "t").where("icao is not null and at is not null and t is not null and not isnan(t)")
    k = flows.latest(flows.appended(flows.agreed(s, ["icao"], "at", "t", "60 days"), place(spark), "update"), ["icao", "at"])
    return k.groupBy("icao").agg(F.count("*").alias("times"), F.sum(F.col("copies") - 1).alias("copies"), F.count_if(F.col("high") > F.col("low")).alias("conflicts"))


@query("""with f as (select user_id, arg_min(value, (ts, value)) forecast from events where event_type = 'view' group by user_id), t as (select user_id, arg_min(value, (ts, value)) truth from events where event_type = 'signup' group by user_id)
 select user_id, forecast, truth, round(forecast - truth, 6) err from f join t using (user_id)""")
def stream_pending_scored(spark, folder):
    """ST-06, JOIN-10: forecasts wait for their truth and are scored once."""
    s = flows.scored_when_due(events(spark, folder), "user_id", F.col("event_type") == "view", F.col("event_type") == "signup", "value", "at", place(spark))
    return s.select("user_id", "forecast", "truth", F.round("error", 6).alias("err"))


@query("select 'good' side, count(*) n from events where value >= 5 and user_id is not null union all select 'quarantined', count(*) from events where not (value >= 5 and user_id is not null)")
def stream_quarantine(spark, folder):
    """ST-11, FLT-11: rows that break a constraint go to their own table."""
    good, bad = flows.split(events(spark, folder), F.expr("value >= 5 and user_id is not null"), place(spark), place(spark))
    return good.agg(F.lit("good").alias("side"), F.count("*").alias("n")).unionByName(bad.agg(F.lit("quarantined").alias("side"), F.count("*").alias("n")))


@query("select strftime(ts, '%Y-%m-%d') slot, 144 expected, count(distinct epoch_us(ts) // 600000000) served from events group by 1")
def stream_presence(spark, folder):
    """ST-08: rounds served against rounds expected."""
    return flows.presence(table(spark, folder, "events"), "ts", 600).withColumn("slot", F.date_format("slot", "yyyy-MM-dd"))
