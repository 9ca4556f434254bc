"""Shared views of the weather tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import parse_time
from ..tables import entity, micros, table


def metars(spark: SparkSession, folder: str) -> DataFrame:
    """One row per METAR of station_history: ``hist_id, icao, item_no, at`` (microseconds, null if unreadable), ``t``."""
    h = table(spark, folder, "station_history").select("hist_id", entity("icao").alias("icao"), F.posexplode("metars").alias("item_no", "m"))
    return h.select("hist_id", "icao", "item_no", F.unix_micros(parse_time(F.col("m.time"))).alias("at"), F.col("m.t").alias("t"))


def ascents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per ascent: ``sounding_id, icao, item_no, at, source, remarks, a``."""
    s = table(spark, folder, "soundings").select("sounding_id", entity("icao").alias("icao"), "source", "remarks", F.posexplode("soundings").alias("item_no", "a"))
    return s.select("sounding_id", "icao", "item_no", F.unix_micros(parse_time(F.col("a.time"))).alias("at"), "source", "remarks", "a")


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """One row per station_index row: ``obs_id, icao, at, t``."""
    return table(spark, folder, "station_index").select("obs_id", entity("icao").alias("icao"), micros("obstime").alias("at"), F.when(~F.isnan("t"), F.col("t")).alias("t"))
