"""Reading the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder. Times without zone are UTC, so the session's zone is set to it."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def entity(col: Column | str) -> Column:
    """An entity code trimmed and upper-cased; blank codes are null."""
    c = F.upper(F.trim(F.col(col) if isinstance(col, str) else col))
    return F.when(c != "", c)


def micros(col: Column | str) -> Column:
    """Microseconds since 1970 of a time with or without zone."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(c.cast("timestamp"))


def number(col: Column | str) -> Column:
    """A number with NaN and infinities as null."""
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
