"""Irregular readings onto a regular grid of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def regular_series(df: DataFrame, key: str, time: str, value: str, step_s: int = 3600, fill_up_to: int = 3, period_s: int = 86400) -> DataFrame:
    """``key, slot`` (epoch seconds), ``value, state``: a row for each step of each period that has a reading.

    Readings are first merged to one mean per slot, so a window over a key holds at most one row per slot of the calendar,
    however many readings a key has. ``lead`` pairs each slot with the next one that has readings; only the
    slots between them are exploded, and only those in the periods of either end: periods without any reading get no
    row. The first and last slot of a key are extended to the bounds of their periods. ``state`` is ``observed``,
    ``interpolated`` (linear, for gaps of at most ``fill_up_to`` slots between two readings) or ``missing`` (value null).
    Null keys, times and values are ignored; repeated readings count in the mean as often as they come.
    """
    slot = (F.floor(F.col(time) / step_s) * step_s).cast("long")
    hours = df.select(F.col(key).alias("key"), slot.alias("slot"), F.col(value).cast("double").alias("value")).dropna().groupBy("key", "slot").agg(F.avg("value").alias("value"))
    w = Window.partitionBy("key").orderBy("slot")
    day = lambda c: (F.floor(c / period_s) * period_s).cast("long")
    n = hours.select("key", "slot", "value", F.lag("slot").over(w).alias("before"), F.lead("slot").over(w).alias("after"), F.lead("value").over(w).alias("next"))
    upto = lambda a, b: F.when(b >= a, F.sequence(a, b, F.lit(step_s).cast("long"))).otherwise(F.array().cast("array<long>"))
    here, end = F.col("slot"), day(F.col("slot")) + (period_s - step_s)
    inside = upto(here + step_s, F.least(end, F.coalesce(F.col("after") - step_s, end)))
    onward = F.when(F.col("after").isNotNull() & (day(F.col("after")) > day(here)), upto(day(F.col("after")), F.col("after") - step_s)).otherwise(F.array().cast("array<long>"))
    ahead = F.when(F.col("before").isNull(), upto(day(here), here - step_s)).otherwise(F.array().cast("array<long>"))
    x = n.withColumn("at", F.explode(F.concat(ahead, F.array(here), inside, onward)))
    gap = (F.col("after") - here) / step_s - 1
    short = F.col("after").isNotNull() & (gap <= fill_up_to) & (F.col("at") > here)
    return x.select(
        "key", F.col("at").alias("slot"),
        F.when(F.col("at") == here, F.col("value")).when(short, F.col("value") + (F.col("next") - F.col("value")) * (F.col("at") - here) / (F.col("after") - here)).alias("value"),
        F.when(F.col("at") == here, "observed").when(short, "interpolated").otherwise("missing").alias("state"),
    )
