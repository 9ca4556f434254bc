import numpy as np
from pyspark.sql import functions as F

from fieldcheck.llm.quantiles import Sketch, build_sketches, merge_sketches, percentiles

PROBS = [0.0005, 0.01, 0.25, 0.5, 0.75, 0.99, 0.9995]


def error(x, q, p):
    """Distance of p from the ranks that q has among x, as a share of the nearer tail."""
    lo, hi = np.searchsorted(x, q, "left") / len(x), np.searchsorted(x, q, "right") / len(x)
    return max(lo - p, p - hi, 0) / min(p, 1 - p)


def test_relative_error_holds_in_both_tails_and_after_merging():
    rng = np.random.default_rng(5)
    x = rng.lognormal(0, 3, 400_000)
    one, merged = Sketch(64), Sketch(64)
    one.add(x)
    for part in np.array_split(x, 37):
        s = Sketch(64)
        s.add(part)
        merged.merge(Sketch.unpack(s.pack()))
    x = np.sort(x)
    for s in (one, merged):
        assert s.n == len(x) and (s.low, s.high) == (x[0], x[-1]) and len(s.pack()) < 300_000
        for p, q in zip(PROBS, s.quantiles(PROBS), strict=True):
            assert error(x, q, p) < 0.05
        assert error(x, s.quantiles([0.5])[0], 0.5) <= s.rank_error() * 2


def test_sorted_reversed_and_tied_input():
    for x in (np.arange(100_000.0), np.arange(100_000.0)[::-1], np.repeat([1.0, 2.0, 2.0, 9.0], 30_000)):
        s = Sketch(64)
        for part in np.array_split(x, 11):
            s.add(part)
        assert all(error(np.sort(x), q, p) < 0.05 for p, q in zip(PROBS, s.quantiles(PROBS), strict=True))


def test_small_groups_are_exact_and_edges(spark):
    data = [("a", float(i), None) for i in range(100)] + [("b", None, 5.0), ("b", float("nan"), 5.0), (None, 1.0, 1.0), ("c", 3.0, float("inf"))]
    df = spark.createDataFrame(data, "key string, n double, m double").repartition(5).withColumn("field", F.lit("clash")).withColumn("sketch", F.lit(0))
    got = {(r.key, r.field): r for r in percentiles(merge_sketches(build_sketches(df, F.col("key"), ["n", "m"]), salts=3), [0.1, 0.5, 0.999]).collect()}
    assert set(got) == {("a", "n"), ("b", "m"), ("c", "n"), ("c", "m")}
    assert (got["a", "n"].n, got["a", "n"].p10, got["a", "n"].p50, got["a", "n"].p99_9, got["a", "n"].rank_error) == (100, 9.0, 49.0, 99.0, 0.0)
    assert percentiles(merge_sketches(build_sketches(df.where("false"), F.col("key"), ["n"])), [0.5]).count() == 0


def test_pieces_combine_to_the_whole(spark):
    df = spark.range(200_000).select((F.col("id") % 10).cast("string").alias("day"), F.randn(3).alias("v")).repartition(6)
    days = merge_sketches(build_sketches(df, F.col("day"), ["v"], rows=7000), salts=4)
    whole = percentiles(merge_sketches(days.withColumn("key", F.lit("all"))), [0.001, 0.5, 0.999]).first()
    x = np.sort(np.array([r.v for r in df.select("v").collect()]))
    assert whole.n == len(x) and all(error(x, whole[c], p) < 0.06 for c, p in (("p0_1", 0.001), ("p50", 0.5), ("p99_9", 0.999)))


def test_rank_error_holds_after_many_merges():
    probs = [0.01, 0.05, 0.1, 0.25, 0.4, 0.5, 0.75, 0.9, 0.95, 0.99]
    off = []
    for run in range(6):
        rng = np.random.default_rng(run)
        x = rng.standard_normal((1500, 400))
        whole = Sketch(64, run)
        for i, part in enumerate(x):
            s = Sketch(64, 10_000 * run + i)
            s.add(part)
            whole.merge(Sketch.unpack(s.pack()))
        x = np.sort(x.ravel())
        off += [error(x, q, p) / whole.rank_error() for p, q in zip(probs, whole.quantiles(probs), strict=True)]
    assert np.mean(np.array(off) > 1) <= 0.003
