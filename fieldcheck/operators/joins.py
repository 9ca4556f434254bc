"""Joins on time, place, intervals and keys, all planned as equalities with residual conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, key: str, time: str, tolerance: int) -> DataFrame:
    """``left_id, right_id, distance``: the right row of the key nearest in time, at most ``tolerance`` (inclusive) away; ties go to the earlier, then the smaller id.

    Left rows go to three tolerance-wide buckets and meet right rows by equality; the least candidate is kept with partial aggregation.
    Nulls in key or time pair with nothing.
    """
    b = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    le = left.select(F.col(left_id), F.col(key).alias("_k1"), F.col(time).alias("_t1")).withColumn("_b1", F.explode(F.array(b("_t1") - 1, b("_t1"), b("_t1") + 1)))
    r = right.select(F.col(right_id).alias("_r"), F.col(key).alias("_k2"), F.col(time).alias("_t2")).withColumn("_b2", b("_t2"))
    d = F.abs(F.col("_t2") - F.col("_t1"))
    j = le.join(r, (F.col("_k1") == F.col("_k2")) & (F.col("_b1") == F.col("_b2")) & (d <= tolerance))
    m = j.groupBy(left_id).agg(F.min(F.struct(d.alias("d"), F.col("_t2").alias("t"), F.col("_r").alias("r"))).alias("m"))
    return m.select(left_id, F.col("m.r").alias(right_id), F.col("m.d").alias("distance"))


def asof_backward(left: DataFrame, right: DataFrame, left_id: str, right_id: str, key: str, time: str, slice_len: int) -> DataFrame:
    """``left_id, right_id``: the last right row of the key at or before the left row's time (the greatest id on ties), null if there is none.

    Rows are cut into time slices, so a long key isn't sorted in one task: within a slice a running last value
    serves; where the slice has none yet, the last row of earlier slices is carried over by a window over one row per key and slice.
    """
    sl = lambda c: F.floor(F.col(c) / slice_len).cast("long")
    le = left.select(F.col(key).alias("k"), F.col(time).alias("t"), F.lit(1).alias("side"), F.col(left_id).alias("lid"), F.lit(None).cast("long").alias("rid"))
    r = right.select(F.col(key).alias("k"), F.col(time).alias("t"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("lid"), F.col(right_id).cast("long").alias("rid"))
    u = le.unionByName(r).where("k is not null and t is not null").withColumn("s", sl("t"))
    within = F.last("rid", ignorenulls=True).over(Window.partitionBy("k", "s").orderBy("t", "side", "rid").rowsBetween(Window.unboundedPreceding, 0))
    carried = u.groupBy("k", "s").agg(F.max(F.when(F.col("side") == 0, F.struct("t", "rid"))).alias("m"))
    carried = carried.select("k", "s", F.last("m", ignorenulls=True).over(Window.partitionBy("k").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)).alias("c"))
    x = u.withColumn("w", within).where("side = 1").join(carried, ["k", "s"])
    return x.select(F.col("lid").alias(left_id), F.coalesce("w", "c.rid").alias(right_id))


def interval_join(points: DataFrame, at: str, spans: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """Points joined to the spans with ``low <= at <= high`` by bins of ``width``; a span is repeated for each bin it touches."""
    p = points.withColumn("_bin", F.floor(F.col(at) / width).cast("long"))
    s = spans.where(F.col(low) <= F.col(high)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long"))))
    return p.join(s, (p["_bin"] == s["_bin"]) & p[at].between(s[low], s[high])).drop("_bin")


def pairs_in_group(df: DataFrame, by: list[str], key: str, values: list[str], crowded: int = 2000) -> DataFrame:
    """Pairs ``key_a < key_b`` of the rows of groups (cell and hour), with the values of both.

    The rows of a group of more than ``crowded`` are split into parts by key, each paired with the whole group by a task of its own.
    """
    parts = df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > crowded).select(*by, F.ceil(F.col("_n") / crowded).cast("int").alias("_parts"))
    split = df.select(*by, key, *values).join(parts, by, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    a = split.select(*by, F.pmod(F.xxhash64(key), F.col("_parts")).cast("int").alias("_part"), F.col(key).alias("key_a"), *(F.col(v).alias(f"{v}_a") for v in values))
    b = split.select(*(F.col(c).alias(f"_{c}") for c in by), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part_b"), F.col(key).alias("key_b"), *(F.col(v).alias(f"{v}_b") for v in values))
    on = (F.col("key_a") < F.col("key_b")) & (F.col("_part") == F.col("_part_b"))
    for c in by:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return a.join(b, on).drop("_part", "_part_b", *(f"_{c}" for c in by))


def overlap_weights(source: DataFrame, target: DataFrame, width: int) -> DataFrame:
    """``source_no, target_no, weight``: lengths of the overlaps of source and target intervals (columns no, lo, hi), joined by bins."""
    cut = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in ("no", "lo", "hi"))).withColumn(f"{p}_bin", F.explode(F.sequence(F.floor(F.col(f"{p}_lo") / width).cast("long"), F.floor(F.col(f"{p}_hi") / width).cast("long"))))
    s, t = cut(source, "s"), cut(target, "t")
    j = s.join(t, (F.col("s_bin") == F.col("t_bin")) & (F.col("s_lo") < F.col("t_hi")) & (F.col("s_hi") > F.col("t_lo")))
    return j.select(F.col("s_no").alias("source_no"), F.col("t_no").alias("target_no"), (F.least("s_hi", "t_hi") - F.greatest("s_lo", "t_lo")).alias("weight")).distinct()


def conserved(values: DataFrame, no: str, value: str, weights: DataFrame, by: list[str]) -> DataFrame:
    """Conservative means on the target intervals: sum(v w) / sum(w) over present values."""
    j = values.join(weights, values[no] == weights["source_no"]).where(F.col(value).isNotNull())
    return j.groupBy(*by, "target_no").agg((F.sum(F.col(value) * F.col("weight")) / F.sum("weight")).alias("mean"), F.sum("weight").alias("covered"))


def classified(plan: DataFrame, target: DataFrame, key: str, size: str, digest: str) -> DataFrame:
    """``key, state``: the plan's rows against the target: ok, size, hash or missing."""
    t = target.select(F.col(key).alias("_k"), F.col(size).alias("_s"), F.col(digest).alias("_d"))
    j = plan.join(t, plan[key] == F.col("_k"), "left")
    state = F.when(F.col("_k").isNull(), "missing").when(~F.col(size).eqNullSafe(F.col("_s")), "size").when(~F.col(digest).eqNullSafe(F.col("_d")), "hash").otherwise("ok")
    return j.select(key, state.alias("state"))


def prefix_join(tokens: DataFrame, token: str, registry: DataFrame, digest: str, name: str, lengths: list[int]) -> DataFrame:
    """Tokens joined to a registry of digests by prefixes of the given lengths; of registrations with one prefix the first name wins."""
    p = registry.select(F.col(name).alias("_n"), F.explode(F.array(*[F.substring(digest, 1, n) for n in lengths])).alias("_p")).groupBy("_p").agg(F.min("_n").alias(name))
    return tokens.join(p, tokens[token] == p["_p"]).drop("_p")


def corner_weights(x: Column, y: Column) -> Column:
    """The four grid corners of a point with their bilinear weights, as an array of (i, j, w)."""
    i, j = F.floor(x), F.floor(y)
    fx, fy = x - i, y - j
    c = lambda a, b, w: F.struct(a.cast("long").alias("i"), b.cast("long").alias("j"), w.alias("w"))
    return F.array(c(i, j, (1 - fx) * (1 - fy)), c(i + 1, j, fx * (1 - fy)), c(i, j + 1, (1 - fx) * fy), c(i + 1, j + 1, fx * fy))
