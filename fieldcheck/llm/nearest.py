"""Records of two tables paired by nearest time within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_in_time(left: DataFrame, right: DataFrame, left_id: list[str], right_id: list[str], entity: str, time: str, tolerance: int) -> DataFrame:
    """``left_id`` columns, ``right_id`` columns and ``distance``: each left row with its nearest right row of the entity.

    Times are integers of one unit (seconds, microseconds); ``tolerance`` is inclusive. Right rows of one entity and time
    are first merged to the smallest ``right_id``. Times fall into buckets as wide as the tolerance; each right row goes
    to its own and the two adjacent buckets, where one array per entity and bucket is made. Its length is bounded by
    the distinct times in three tolerances, not by the rows of an entity, and left rows meet exactly one array, so
    an entity with a third of all rows is spread over its buckets and no pair is ever stored. Then the least
    (distance, time, right_id) within the tolerance is kept: at equal distance the earlier. Rows with
    null entity or time, and rows without counterpart, pair with nothing and don't come out. Repeated left rows
    each come out. Column names of the two sides may clash.
    """
    r = right.select(F.col(entity).alias("_e"), F.col(time).cast("long").alias("_t"), F.struct(*right_id).alias("_r")).where("_e is not null and _t is not null")
    r = r.groupBy("_e", "_t").agg(F.min("_r").alias("_r"))
    b = F.floor(F.col("_t") / tolerance).cast("long")
    r = r.withColumn("_b", F.explode(F.array(b - 1, b, b + 1))).groupBy("_e", "_b").agg(F.collect_list(F.struct("_t", "_r")).alias("_all"))
    m = left.select(*left_id, F.col(entity).alias("_e2"), F.col(time).cast("long").alias("_t2")).where("_e2 is not null and _t2 is not null").withColumn("_b2", F.floor(F.col("_t2") / tolerance).cast("long"))
    j = m.join(r, (F.col("_e2") == F.col("_e")) & (F.col("_b2") == F.col("_b")))
    least = F.array_min(F.transform("_all", lambda x: F.struct(F.abs(x["_t"] - F.col("_t2")).alias("d"), x["_t"].alias("t"), x["_r"].alias("r"))))
    return j.withColumn("_m", least).where(F.col("_m.d") <= tolerance).select(*left_id, *(F.col(f"_m.r.{c}").alias(f"right_{c}" if c in left_id else c) for c in right_id), F.col("_m.d").alias("distance"))


def nearest_few(left: DataFrame, right: DataFrame, left_id: list[str], right_id: list[str], entity: str, time: str, tolerance: int) -> DataFrame:
    """The same result where the left table is much the smaller one: its rows, not the right ones, go to three buckets.

    The joined rows are reduced to the least (distance, time, right_id) per left row, first within each task.
    """
    b = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    m = left.select(*left_id, F.col(entity).alias("_e2"), F.col(time).cast("long").alias("_t2")).where("_e2 is not null and _t2 is not null").withColumn("_b2", F.explode(F.array(b("_t2") - 1, b("_t2"), b("_t2") + 1)))
    r = right.select(F.col(entity).alias("_e"), F.col(time).cast("long").alias("_t"), F.struct(*right_id).alias("_r")).where("_e is not null and _t is not null").withColumn("_b", b("_t"))
    d = F.abs(F.col("_t") - F.col("_t2"))
    j = m.join(r, (F.col("_e2") == F.col("_e")) & (F.col("_b2") == F.col("_b")) & (d <= tolerance))
    least = j.groupBy(*left_id, "_t2").agg(F.min(F.struct(d.alias("d"), F.col("_t").alias("t"), F.col("_r").alias("r"))).alias("_m"))
    return least.select(*left_id, *(F.col(f"_m.r.{c}").alias(f"right_{c}" if c in left_id else c) for c in right_id), F.col("_m.d").alias("distance"))
