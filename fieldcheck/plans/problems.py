"""Queries of the general problems: units, places, nested records, spikes, regular series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import located
from ..functions.units import SUMS, number_in, quantity_of, scale_of, spelled, unit_after_number, unit_in_note, unit_in_remarks
from ..operators.regular import regular_series
from ..operators.shred import any_leaf, pivoted, shred
from ..operators.spatial import memberships, near_pairs
from ..operators.spikes import profile_residuals, residual_sizes, series_residuals, spikes_in_series, tail_cutoffs, wrong_in_profiles
from ..operators.units import unit_history, with_units
from ..session import written
from ..tables import entity, micros, table
from .problem_sql import ORACLE as ORACLE
from .readings import metars, observations

DAY = 86_400_000_000
LEVEL_ARRAYS = ["p", "t", "td", "z", "sig"]
REPEATED = ("soundings", "levels", "metars", "periods")


# --- p3: units


def readings_in_units(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """field_readings with number, stated and recorded unit; and the unit histories behind it."""
    v = table(spark, folder, "variables").select("code", "training_units", quantity_of(F.col("training_units")).alias("quantity"))
    v = v.withColumn("target", spelled(F.col("quantity"), F.col("training_units")))
    r = table(spark, folder, "field_readings").join(F.broadcast(v), "code")  # variables has one row per code, 13 in all
    number = F.coalesce(F.when(~F.isnan("value"), F.col("value")), number_in(F.col("value_text")))
    said = F.coalesce("unit", unit_after_number(F.col("value_text")), unit_in_note(F.col("note"), F.col("code")))
    r = r.withColumn("number", number).withColumn("said", said)  # each worked out once, used below
    r = r.where("number is not null and number <> -9999 and abs(number) < 9e36").select("reading_id", "code", "source", "quantity", "target", "number", "accum_hours", (F.floor(micros("valid_time") / DAY)).cast("long").alias("day"), spelled(F.col("quantity"), F.col("said")).alias("stated"))
    r = r.withColumn("day", F.coalesce("day", F.lit(-1)))
    history = unit_history(r, "source", "code", "quantity", "day", "number", "stated")
    return with_units(r, history, "source", "code", "day", "stated"), history


def soundings_in_units(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``sounding_id`` with the number of non-missing t and the recorded unit of t; and the unit histories behind it."""
    a = table(spark, folder, "soundings").select("sounding_id", F.coalesce("source", F.lit("?")).alias("source"), F.lit("t").alias("code"), F.lit("temperature").alias("quantity"), unit_in_remarks(F.col("remarks")).alias("stated"), "soundings")
    real = F.filter(F.flatten(F.transform(F.filter("soundings", lambda x: x["t"].isNotNull()), lambda x: x["t"])), lambda t: t.isNotNull() & (t != -32768))
    day = F.coalesce(F.unix_date(F.substring(F.get("soundings", F.lit(0))["time"], 1, 10).try_cast("date")), F.lit(-1)).cast("long")
    a = a.withColumn("_t", real).where(F.size("_t") > 0)
    mean = F.aggregate("_t", F.lit(0.0), lambda s, t: s + t, lambda s: s / F.size("_t"))
    a = a.select("sounding_id", "source", "code", "quantity", "stated", F.size("_t").alias("n"), mean.alias("number"), day.alias("day"))
    history = written(unit_history(a, "source", "code", "quantity", "day", "number", "stated", default={"temperature": "cK"}))
    return with_units(a, history, "source", "code", "day", "stated"), history


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Readings and soundings whose values must be changed."""
    r, _ = readings_in_units(spark, folder)
    s, _ = soundings_in_units(spark, folder)
    return (
        r.where("recorded_unit <> target").select(F.lit("reading").alias("src"), F.col("reading_id").alias("record_id"))
        .unionByName(s.where("recorded_unit <> 'cK'").select(F.lit("sounding").alias("src"), F.col("sounding_id").alias("record_id")))
    )


def p3_converted(spark: SparkSession, folder: str) -> DataFrame:
    """Every reading in the training unit of its variable (sums of radiation over their period)."""
    r, _ = readings_in_units(spark, folder)
    f, o = scale_of(F.col("quantity"), F.col("recorded_unit"))
    ft, ot = scale_of(F.col("quantity"), F.col("target"))
    rate = F.when(F.col("recorded_unit").isin(*SUMS) & ~F.col("target").isin(*SUMS), F.col("accum_hours") * 3600.0).otherwise(F.lit(1.0))
    return r.select("reading_id", "code", "source", "recorded_unit", F.col("target").alias("unit"), ((((F.col("number") * f + o) / rate) - ot) / ft).alias("value"))


def p3_converted_all(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of both tables: readings as ``p3_converted`` has them (positions -1), and each t of a level in kelvin (``ascent_no, level_no`` 0-based). A source without name is ``?``."""
    none = F.lit(-1)
    readings = p3_converted(spark, folder).select(F.lit("reading").alias("src"), F.col("reading_id").alias("record_id"), none.alias("ascent_no"), none.alias("level_no"), "code", F.coalesce("source", F.lit("?")).alias("source"), "recorded_unit", "unit", "value")
    levels = profiles(spark, folder).select("*", F.posexplode("t").alias("level_no", "v")).where("v is not null and v <> -32768")
    kelvin = (F.col("v") * F.col("factor") + F.col("offset")).alias("value")
    return readings.unionByName(levels.select(F.lit("sounding").alias("src"), "record_id", "ascent_no", "level_no", F.lit("t").alias("code"), "source", "recorded_unit", F.lit("K").alias("unit"), kelvin))


def p3_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The segments of each source history of readings without stated unit."""
    _, h = readings_in_units(spark, folder)
    return h.groupBy("source", "code", "segment").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.min("resolved").alias("unit"), F.round(F.min("level"), 6).alias("level"), F.round(F.min("shift"), 6).alias("shift"))


def switched_feed(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """One feed per code that takes its readings from one source before the middle day and from another one after it, units withheld; the first source's own stated readings stay stated.

    The two are the sources with the most readings in a unit of their own: the first, and the one with most readings in any other unit. ``was``: the unit withheld.
    """
    r, _ = readings_in_units(spark, folder)
    r = written(r.where("number <> 0 and day >= 0").select("reading_id", "code", "source", "quantity", "day", "number", "stated", F.col("recorded_unit").alias("was")))
    n = r.groupBy("code", "source", "was").agg(F.count("*").alias("n"))  # codes, sources and units are few
    first = n.groupBy("code").agg(F.max(F.struct("n", "source", "was")).alias("a"))
    other = n.join(first, "code").where("was <> a.was").groupBy("code").agg(F.first("a").alias("a"), F.max(F.struct("n", "source", "was")).alias("b"))
    middle = r.agg(F.percentile_approx("day", 0.5)).first()[0] or 0
    x = r.join(other, "code")
    early = (F.col("source") == F.col("a.source")) & (F.col("was") == F.col("a.was")) & (F.col("day") < middle)
    late = (F.col("source") == F.col("b.source")) & (F.col("was") == F.col("b.was")) & (F.col("day") >= middle)
    x = x.where(early | late)
    kept = early & F.col("stated").isNotNull() & (F.pmod(F.xxhash64("reading_id"), F.lit(4)) == 0)
    return x.select("reading_id", F.lit("feed").alias("source"), "code", "quantity", "day", "number", F.when(kept, F.col("stated")).alias("stated"), "was"), middle


def p3_switched(spark: SparkSession, folder: str) -> DataFrame:
    """Feeds that change their source, and so their unit, in mid-history, without a word about it: per code and half the unit withheld, the one found, and how many days."""
    x, middle = switched_feed(spark, folder)
    h = unit_history(x, "source", "code", "quantity", "day", "number", "stated")
    w = with_units(x, h, "source", "code", "day", "stated").where("stated is null")
    return w.groupBy("code", (F.col("day") >= middle).alias("late"), "was", F.col("recorded_unit").alias("found")).agg(F.count("*").alias("n"), F.countDistinct("day").alias("days"))


# --- p4: places


def located_stations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "stations").where(located(F.col("lat"), F.col("lon"))).select(entity("icao").alias("icao"), "lat", "lon").where("icao is not null")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Stations within 3 km of each other, and stations inside areas."""
    s = located_stations(spark, folder)
    near = near_pairs(s, "icao", "lat", "lon", 3.0)
    inside = memberships(s, "icao", "lat", "lon", table(spark, folder, "area_boxes"), "area_id")
    return near.select(F.lit("near").alias("kind"), "key_a", "key_b").unionByName(inside.select(F.lit("inside").alias("kind"), "key_a", "key_b"))


# --- p5: nested records


def shredded(spark: SparkSession, folder: str) -> DataFrame:
    """The records that are text, shredded: ``src`` and the columns of ``shred``."""
    return shred(table(spark, folder, "raw_records"), "raw_id", "payload", REPEATED, ("data", "station")).withColumn("src", F.lit("raw_records"))


LEVELS, METARS, ASCENTS = ["soundings[].levels[]", "soundings[]#"], ["metars[]"], ["soundings[]"]
METAR_LEAVES = {"time": "string", "t": "double", "td": "double", "qnh": "double", "slp": "double"}


def level_rows(rows: DataFrame) -> DataFrame:
    """Of the shredded rows, those that are levels: objects of ``levels``, or positions of the level arrays."""
    return rows.where((F.col("ancestor") == LEVELS[0]) | ((F.col("ancestor") == LEVELS[1]) & any_leaf(LEVEL_ARRAYS)))


def typed_ascents(spark: SparkSession, folder: str) -> DataFrame:
    """The ascents of the table that is already typed, which needs no parsing: ``src, record_id, ascent_no, a``."""
    s = table(spark, folder, "soundings").select(F.lit("soundings").alias("src"), F.col("sounding_id").alias("record_id"), F.posexplode("soundings").alias("ascent_no", "a"))
    return s.where("a is not null")


def typed_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Its levels by position, as many as the longest array has, the others padded with null."""
    none = F.array().cast("array<int>")
    zipped = F.arrays_zip(*(F.coalesce(F.col(f"a.{c}"), none).alias(c) for c in LEVEL_ARRAYS))
    return typed_ascents(spark, folder).select("src", "record_id", "ascent_no", F.posexplode(zipped).alias("level_no", "v")).select("src", "record_id", "ascent_no", "level_no", "v.*")


def typed_metars(spark: SparkSession, folder: str) -> DataFrame:
    h = table(spark, folder, "station_history").select(F.lit("station_history").alias("src"), F.col("hist_id").alias("record_id"), F.posexplode("metars").alias("item_no", "m"))
    return h.where("m is not null").select("src", "record_id", "item_no", *(F.col(f"m.{c}").alias(c) for c in METAR_LEAVES))


def table_of(rows: DataFrame, ancestors: list[str], names: list[str], columns: dict[str, str]) -> DataFrame:
    p = pivoted(rows.withColumn("record_id", F.struct("src", "record_id")), ancestors, names, columns)
    return p.select("record_id.src", F.col("record_id.record_id").alias("record_id"), *names, *columns)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every level and METAR with its parent and position."""
    rows = shredded(spark, folder)
    level = (F.col("ancestor") == LEVELS[0]) | ((F.col("ancestor") == LEVELS[1]) & any_leaf(LEVEL_ARRAYS))
    metar = F.col("ancestor") == METARS[0]
    found = rows.where(level | metar).select(
        "src", "record_id", F.when(metar, -1).otherwise(F.get("ordinals", F.lit(0))).alias("ascent_no"), F.get("ordinals", F.when(metar, 0).otherwise(1)).alias("item_no")
    )
    levels = typed_levels(spark, folder).select("src", "record_id", "ascent_no", F.col("level_no").alias("item_no"))
    return found.unionByName(levels).unionByName(typed_metars(spark, folder).select("src", "record_id", F.lit(-1).alias("ascent_no"), "item_no"))


def p5_levels(spark: SparkSession, folder: str) -> DataFrame:
    """The table of levels."""
    return table_of(level_rows(shredded(spark, folder)), LEVELS, ["ascent_no", "level_no"], {c: "int" for c in LEVEL_ARRAYS}).unionByName(typed_levels(spark, folder))


def p5_ascents(spark: SparkSession, folder: str) -> DataFrame:
    """The table of ascents."""
    return table_of(shredded(spark, folder), ASCENTS, ["ascent_no"], {"time": "string", "n": "int"}).unionByName(typed_ascents(spark, folder).select("src", "record_id", "ascent_no", "a.time", "a.n"))


def p5_metars(spark: SparkSession, folder: str) -> DataFrame:
    """The table of METARs."""
    return table_of(shredded(spark, folder), METARS, ["item_no"], METAR_LEAVES).unionByName(typed_metars(spark, folder))


# --- p6: spikes

#: Risk at which an honest level passes its source's cutoff.
LEVEL_RISK = 1e-8


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Ascents with the recorded unit of t and its scale to kelvin, one row per ascent."""
    _, history = soundings_in_units(spark, folder)
    day = F.coalesce(F.unix_date(F.substring(F.get("soundings", F.lit(0))["time"], 1, 10).try_cast("date")), F.lit(-1)).cast("long")
    levels = F.transform("soundings", lambda x: F.struct(x["p"].alias("p"), x["t"].alias("t"), x["z"].alias("z")))
    s = table(spark, folder, "soundings").select("sounding_id", F.coalesce("source", F.lit("?")).alias("source"), F.lit("t").alias("code"), day.alias("day"), unit_in_remarks(F.col("remarks")).alias("stated"), levels.alias("levels"))
    s = with_units(s, history, "source", "code", "day", "stated").withColumn("recorded_unit", F.coalesce("recorded_unit", F.lit("cK")))
    factor, offset = scale_of(F.lit("temperature"), F.col("recorded_unit"))
    return s.select(F.col("sounding_id").alias("record_id"), "source", "recorded_unit", factor.alias("factor"), offset.alias("offset"), F.posexplode("levels").alias("ascent_no", "a")).select(
        "record_id", "ascent_no", "source", "recorded_unit", "factor", "offset", "a.p", "a.t", "a.z"
    )


def level_cutoffs(a: DataFrame) -> DataFrame:
    """``source, field`` and the tail of its levels' departures, with the cutoff at LEVEL_RISK."""
    return tail_cutoffs(profile_residuals(a), ["source", "field"], "size", "n", LEVEL_RISK, near="near")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Readings and levels that are impossible, stuck or spikes."""
    obs = observations(spark, folder)
    bad = spikes_in_series(obs, "icao", "at", "t", DAY, -90.0, 60.0)
    hits = obs.join(bad, (F.col("icao") == F.col("key")) & (F.col("at") == F.col("time")) & (F.col("t") == F.col("value")), "left_semi")
    a = profiles(spark, folder)
    cut = level_cutoffs(a).groupBy("source").agg(F.max(F.when(F.col("field") == "t", F.col("cutoff"))).alias("cut_t"), F.max(F.when(F.col("field") == "z", F.col("cutoff"))).alias("cut_z"))
    a = a.join(cut, "source", "left")
    levels = wrong_in_profiles(a, (150.0, 340.0), (-1000.0, 60000.0))
    none = F.lit(-1)
    return hits.select(F.lit("obs").alias("src"), F.col("obs_id").alias("record_id"), none.alias("ascent_no"), none.alias("level_no")).unionByName(levels.withColumn("src", F.lit("level")))


def p6_tails(spark: SparkSession, folder: str) -> DataFrame:
    """The tail of each station's and source's departures: threshold, number of peaks, shape, scale, and the cutoff at its fixed risk."""
    obs = residual_sizes(series_residuals(observations(spark, folder), "icao", "at", "t", DAY))
    of_obs = tail_cutoffs(obs, ["key"], "size", "n", 1e-3).withColumnRenamed("key", "source").withColumn("field", F.lit("t")).withColumn("src", F.lit("obs"))
    of_levels = level_cutoffs(profiles(spark, folder)).withColumn("src", F.lit("level"))
    return of_obs.unionByName(of_levels).select("src", "source", "field", "peaks", *(F.round(c, 6).alias(c) for c in ("usual", "threshold", "shape", "scale", "cutoff")))


# --- p7: regular series


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    m = metars(spark, folder).where("icao is not null and at is not null and t is not null and not isnan(t)")
    return regular_series(m.withColumn("s", F.floor(F.col("at") / 1_000_000).cast("long")), "icao", "s", "t")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The missing hours of each station and date with a usable METAR."""
    h = hourly(spark, folder).where("state <> 'observed'")
    return h.select(F.col("key").alias("icao"), F.date_format(F.timestamp_seconds("slot"), "yyyy-MM-dd'T'HH").alias("hour"))


def p7_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """The hourly series of t per station, with missing hours filled or marked."""
    return hourly(spark, folder).select(F.col("key").alias("icao"), F.date_format(F.timestamp_seconds("slot"), "yyyy-MM-dd'T'HH").alias("hour"), F.round("value", 4).alias("t"), "state")


QUERIES = {f.__name__: f for f in (p3_found, p3_converted, p3_converted_all, p3_segments, p3_switched, p4_found, p5_found, p5_levels, p5_ascents, p5_metars, p6_found, p6_tails, p7_found, p7_hourly)}
