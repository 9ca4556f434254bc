import numpy as np
from pyspark.sql import functions as F

from fieldcheck.llm.nearest import nearest_few, nearest_in_time


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(7)
    le = [(i, int(e), int(t)) for i, (e, t) in enumerate(zip(rng.choice(5, 400, p=[0.6, 0.1, 0.1, 0.1, 0.1]), rng.integers(-500, 20000, 400), strict=True))]
    ri = [(i // 4, i % 4, int(e), int(t)) for i, (e, t) in enumerate(zip(rng.choice(5, 600), rng.integers(-500, 20000, 600), strict=True))]
    le += [(400, 0, le[0][2]), (401, None, 5), (402, 1, None)]
    ri += [(998, 0, 0, ri[0][3]), (999, 0, None, 5), (999, 1, 1, None)]
    truth = set()
    for i, e, t in le:
        c = [(abs(u - t), u, a, b) for a, b, f, u in ri if e is not None and t is not None and f == e and u is not None and abs(u - t) <= 90]
        if c:
            truth.add((i, *min(c)[2:], min(c)[0]))
    a = spark.createDataFrame(le, "id long, e int, t long").withColumn("distance", F.lit("clash")).withColumn("_b", F.lit(1))
    b = spark.createDataFrame(ri, "r long, n int, e int, t long").withColumn("id", F.lit(1))
    for f in (nearest_in_time, nearest_few):
        assert set(map(tuple, f(a, b, ["id"], ["r", "n"], "e", "t", 90).collect())) == truth
        assert f(a.where("false"), b, ["id"], ["r", "n"], "e", "t", 90).count() == f(a, b.where("false"), ["id"], ["r", "n"], "e", "t", 90).count() == 0


def test_ties(spark):
    a = spark.createDataFrame([(1, 1, 100), (2, 1, 1000)], "l long, e int, t long")
    b = spark.createDataFrame([(5, 1, 110), (6, 1, 90), (7, 1, 90), (8, 1, 1091), (9, 1, 910)], "r long, e int, t long")
    for f in (nearest_in_time, nearest_few):
        assert sorted(map(tuple, f(a, b, ["l"], ["r"], "e", "t", 90).collect())) == [(1, 6, 10), (2, 9, 90)]
