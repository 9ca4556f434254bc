"""Sequence operators. Where a series may be long, totals of blocks are carried, so no task sorts a whole long series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, keys: list[str], order: str, value: str, block: int, name: str = "total") -> DataFrame:
    """``name``: the sum of ``value`` up to and with each row, in order of an integer unique within the keys.

    Sums within blocks of ``block`` order values are added to the sums of earlier blocks, of which there is one row each.
    """
    x = df.withColumn("_blk", F.floor(F.col(order) / block))
    before = x.groupBy(*keys, "_blk").agg(F.sum(value).alias("_s"))
    before = before.withColumn("_before", F.sum("_s").over(Window.partitionBy(*keys).orderBy("_blk")) - F.col("_s")).drop("_s")
    within = F.sum(value).over(Window.partitionBy(*keys, "_blk").orderBy(order))
    return x.withColumn("_w", within).join(before, [*keys, "_blk"]).withColumn(name, F.col("_w") + F.col("_before")).drop("_w", "_before", "_blk")


def islands(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """``keys, first, last, length``: maximal runs of consecutive integers of ``index`` (distinct per key) — days, frames, positions."""
    w = Window.partitionBy(*keys).orderBy(index)
    x = df.select(*keys, index).distinct().withColumn("_g", F.col(index) - F.row_number().over(w))
    return x.groupBy(*keys, "_g").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("length")).drop("_g")


def longest_run(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """``keys, longest``: the longest run of consecutive indices."""
    return islands(df, keys, index).groupBy(*keys).agg(F.max("length").alias("longest"))


def seasonal_anomaly(df: DataFrame, keys: list[str], month: str, value: str, train: Column, name: str = "anomaly") -> DataFrame:
    """``value`` less the mean of its key and calendar month over training rows only; later rows can't move it. Months without training rows give null."""
    clim = df.where(train).groupBy(*keys, month).agg(F.avg(value).alias("_clim"))
    return df.join(clim, [*keys, month], "left").withColumn(name, F.col(value) - F.col("_clim")).drop("_clim")


def detrended(df: DataFrame, keys: list[str], at: str, value: str, train: Column, name: str = "detrended") -> DataFrame:
    """``value`` less the line fitted on training rows only, applied everywhere; a constant if the line is undefined."""
    y, x = F.when(train, F.col(value)), F.when(train, F.col(at).cast("double"))
    fit = df.groupBy(*keys).agg(F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("_b"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    return df.join(fit, keys).withColumn(name, F.col(value) - F.col("_my") - F.col("_b") * (F.col(at) - F.col("_mx"))).drop("_b", "_mx", "_my")


def neighbours(df: DataFrame, row: str, col: str, reach_r: int, reach_c: int, columns: int | None = None) -> DataFrame:
    """Each row repeated for the cells of the window round it (``to_row, to_col``), columns wrapping if their number is given."""
    r = F.explode(F.sequence(F.col(row) - reach_r, F.col(row) + reach_r)).alias("to_row")
    x = df.select("*", r).select("*", F.explode(F.sequence(F.col(col) - reach_c, F.col(col) + reach_c)).alias("to_col"))
    return x.withColumn("to_col", F.pmod("to_col", F.lit(columns))) if columns else x


def uniform_filter(df: DataFrame, by: list[str], row: str, col: str, value: str, reach: int, columns: int | None = None) -> DataFrame:
    """``by, row, col, mean``: the mean of present values in the window round each present cell."""
    n = neighbours(df.where(F.col(value).isNotNull()), row, col, reach, reach, columns)
    m = n.groupBy(*by, F.col("to_row").alias(row), F.col("to_col").alias(col)).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return df.select(*by, row, col).distinct().join(m, [*by, row, col])
