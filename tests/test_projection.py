import numpy as np

from fieldcheck.plans.learning import QUERIES, projected


def test_masked_projection_against_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(v, f"r{k}", f"A{i}", i / 26 - 1, float(rng.normal())) for v in "ab" for k in range(6) for i in range(30) if (i + k % 2) % 3 or k == 5]
    rows += [("a", "short", f"A{i}", i / 26 - 1, 1.0) for i in (1, 2)] + [("b", "near", f"A{i}", x, 1.0) for i, x in ((91, 1.0), (92, 1.0001), (93, 1.0002))]
    got = {(r.variable, r.run): r for r in projected(spark.createDataFrame(rows, "variable string, run string, region string, x double, y double")).collect()}
    assert len(got) == 14
    for (v, k), r in got.items():
        x, y = np.array([(q[3], q[4]) for q in rows if q[:2] == (v, k)]).T
        if k in ("short", "near"):
            assert r.c0 is r.c1 is r.c2 is None and (r.rank < 3 or r.cond > 1e8)
        else:
            assert np.allclose([r.c2, r.c1, r.c0], np.polyfit(x, y, 2)) and r.n == len(x)
    assert got["a", "r0"].mask == got["b", "r2"].mask != got["a", "r1"].mask and got["a", "r0"].runs == 6


def test_every_variable_is_projected(spark, data):
    got = QUERIES["mat_masked_projection"](spark, data)
    assert got.select("variable").distinct().count() > 1 and got.where("c0 is not null").count() > 0
