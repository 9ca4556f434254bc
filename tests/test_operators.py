"""Operators of the reference's own kind: numpy twins, invariants, guards in both directions."""

import math
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldcheck.functions.hashes import crc32c, crc32c_of
from fieldcheck.functions.thermo import erf, normal_share
from fieldcheck.operators import grid, joins, learn, stats, windows
from fieldcheck.sources import container, records, sinks
from fieldcheck.streaming import flows


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_crc32c(spark):
    assert crc32c_of([b"123456789", b"", None, b"a" * 5000]) [:3] == [0xE3069283, 0, None]
    df = spark.createDataFrame([(bytearray(b"123456789"),), (None,)], "b binary")
    assert [r[0] for r in df.select(crc32c("b")).collect()] == [0xE3069283, None]


def test_erf(spark):
    x = [-3.0, -0.5, 0.0, 0.1, 1.0, 2.5]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(erf(F.col("x"))).collect()]
    assert np.allclose(got, [math.erf(v) for v in x], atol=2e-7)
    assert abs(spark.range(1).select(normal_share(F.lit(0.0), F.lit(1.0), F.lit(1.0))).first()[0] - 68.268949) < 1e-3


def test_error_summary_and_gate(spark):
    rng = np.random.default_rng(2)
    d = pd.DataFrame({"g": rng.integers(0, 3, 300), "e": rng.normal(1, 2, 300)})
    df = spark.createDataFrame(d)
    for pop in (True, False):
        for r in stats.error_summary(df, ["g"], "e", pop).collect():
            e = d.e[d.g == r.g]
            assert np.allclose([r.n, r.median_bias, r.mean_bias, r.mae, r[-1]], [len(e), e.median(), e.mean(), e.abs().mean(), e.std(ddof=0 if pop else 1)], atol=1e-5)
    g = stats.gated(spark.createDataFrame([(1, 5, 2.0), (2, 50, 3.0)], "k int, n int, v double"), "n", 30, ["v"])
    assert rows(g) == [(1, 5, None, "insufficient"), (2, 50, 3.0, "ok")]


def test_index_percentiles(spark):
    x = sorted([3.0, 1.0, 1.0, 7.0, 9.0, 2.0, 2.0, 8.0, 4.0, 6.0])
    got = stats.index_percentiles(spark.createDataFrame([("a", v) for v in x] + [("a", None)], "k string, v double"), ["k"], "v", {"p90": 0.9, "mid": 0.5, "p05": 0.05}).first()
    assert (got.n, got.p90, got.mid, got.p05) == (10, x[9], x[5], x[0])


def test_guarded_corr(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 2.0, 5.0), ("a", 3.0, 5.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0), ("b", 3.0, 6.5), ("c", 1.0, 1.0)], "k string, x double, y double")
    got = dict(rows(df.groupBy("k").agg(stats.guarded_corr(F.col("x"), F.col("y")))))
    assert got["a"] is None and got["c"] is None and abs(got["b"] - np.corrcoef([1, 2, 3], [2, 4, 6.5])[0, 1]) < 1e-12


def test_asof(spark):
    rng = np.random.default_rng(4)
    le = [(i, int(k), int(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 4, 200), rng.integers(0, 5000, 200), strict=True))]
    ri = [(i, int(k), int(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 4, 150), rng.integers(0, 5000, 150), strict=True))]
    a, b = spark.createDataFrame([*le, (900, None, 5), (901, 1, None)], "l long, k int, t long"), spark.createDataFrame([*ri, (990, None, 5)], "r long, k int, t long")
    near = {}
    for i, k, t in le:
        c = [(abs(u - t), u, j) for j, q, u in ri if q == k and abs(u - t) <= 60]
        if c:
            near[i] = (min(c)[2], min(c)[0])
    assert {r[0]: (r[1], r[2]) for r in joins.asof_nearest(a, b, "l", "r", "k", "t", 60).collect()} == near
    back = {i: max(((u, j) for j, q, u in ri if q == k and u <= t), default=(None, None))[1] for i, k, t in le}
    assert dict(rows(joins.asof_backward(a, b, "l", "r", "k", "t", 500))) == back


def test_interval_and_overlap(spark):
    p = spark.createDataFrame([(i,) for i in range(0, 100, 3)], "x long")
    s = spark.createDataFrame([(1, 5, 40), (2, 90, 95), (3, 50, 10), (4, None, 7)], "no int, lo long, hi long")
    assert rows(joins.interval_join(p, "x", s, "lo", "hi", 16).select("x", "no")) == sorted([(x, n) for x in range(0, 100, 3) for n, lo, hi in ((1, 5, 40), (2, 90, 95)) if lo <= x <= hi], key=str)
    w = joins.overlap_weights(spark.createDataFrame([(0, 0, 7), (1, 7, 14)], "no int, lo int, hi int"), spark.createDataFrame([(0, 0, 10), (1, 10, 20)], "no int, lo int, hi int"), 5)
    assert rows(w) == [(0, 0, 7), (1, 0, 3), (1, 1, 4)]
    v = spark.createDataFrame([("a", 0, 5.0), ("a", 1, 5.0)], "k string, no int, v double")
    assert {r.mean for r in joins.conserved(v, "no", "v", w, ["k"]).collect()} == {5.0}


def test_running_total_and_islands(spark):
    rng = np.random.default_rng(6)
    v = rng.integers(0, 9, 300)
    got = windows.running_total(spark.createDataFrame([("a", i, int(x)) for i, x in enumerate(v)], "k string, i long, x long"), ["k"], "i", "x", 37).orderBy("i").collect()
    assert [r.total for r in got] == np.cumsum(v).tolist()
    assert rows(windows.longest_run(spark.createDataFrame([(1, d) for d in (1, 2, 3, 7, 8, 8, 20)] + [(2, 5)], "k int, d int"), ["k"], "d")) == [(1, 3), (2, 1)]


def test_future_rows_do_not_move_the_climatology(spark):
    base = [("a", i, i % 12, float(i)) for i in range(60)]
    bad = [("a", i, i % 12, 1e9) for i in range(60, 72)]
    f = lambda d: windows.seasonal_anomaly(spark.createDataFrame(d, "k string, i int, mo int, v double"), ["k"], "mo", "v", F.col("i") < 48).where("i < 60").select("i", "anomaly")
    assert rows(f(base)) == rows(f(base + bad))


def test_components(spark):
    rng = np.random.default_rng(8)
    m = rng.random((25, 30)) < 0.55
    cells = [(1, int(r), int(c)) for r, c in zip(*np.nonzero(m), strict=True)]
    parent = {x: x for x in cells}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, r, c in cells:
        for q in ((1, r + 1, c), (1, r, c + 1)):
            if q in parent:
                parent[find(q)] = find((1, r, c))
    groups = {}
    for x in cells:
        groups.setdefault(find(x), set()).add(x[1:])
    got = {}
    for d, r, c, label in grid.components(spark.createDataFrame(cells, "d int, r int, c int"), ["d"], "r", "c").collect():
        got.setdefault(tuple(label), set()).add((r, c))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values())) and all(min(v) == k for k, v in got.items())
    assert grid.components(spark.createDataFrame([], "d int, r int, c int"), ["d"], "r", "c").count() == 0


def test_regrid_conserves(spark):
    src = [(0, i, j, 7.5) for i in range(36) for j in range(72)]
    r = grid.axis_weights(spark, [-90.0 + 5 * i for i in range(37)], [-90.0 + 9 * i for i in range(21)], True)
    c = grid.axis_weights(spark, [5.0 * i for i in range(73)], [12.0 * i for i in range(31)], False)
    got = grid.regridded(spark.createDataFrame(src, "t int, r long, c long, v double"), ["t"], "r", "c", "v", r, c).collect()
    assert len(got) == 600 and all(abs(x["mean"] - 7.5) < 1e-12 for x in got) and abs(sum(x.area for x in got) - 2 * 360) < 1e-9
    wrap = grid.axis_weights(spark, [-10.0, 10.0, 350.0], [0.0, 180.0, 360.0], False, 360.0)
    assert abs(wrap.agg(F.sum("w")).first()[0] - 360) < 1e-9


def test_local_maxima(spark):
    rng = np.random.default_rng(2)
    v = rng.random((20, 36))
    df = spark.createDataFrame([(1, i, j, float(v[i, j])) for i in range(20) for j in range(36)], "g int, r int, c int, v double")
    best = [(v[i, j], i, j) for i in range(20) for j in range(36) if v[i, j] >= max(v[a, b % 36] for a in range(max(0, i - 1), min(20, i + 2)) for b in range(j - 2, j + 3))]
    kept = []
    for x in sorted(best, key=lambda x: (-x[0], x[1], x[2])):
        if all(max(abs(x[1] - k[1]), min(abs(x[2] - k[2]), 36 - abs(x[2] - k[2]))) >= 6 for k in kept):
            kept.append(x)
    got = grid.local_maxima(df, ["g"], "r", "c", "v", 1, 2, 36, 6, 4).orderBy("place").collect()
    assert [(x.r, x.c) for x in got] == [(i, j) for _, i, j in kept[:4]]


@pytest.mark.parametrize("shift", [(0, 0), (3, 0), (0, -3), (2, 1), (-3, 2)])
def test_patch_offset(shift):
    a = np.random.default_rng(7).random((40, 40))
    d = grid.patch_offset(a, np.roll(a, shift, (0, 1)), 4)
    assert np.allclose(d[:2], shift, atol=0.1) and d[2] > 0.99


def test_harmonics():
    x, w = np.polynomial.legendre.leggauss(24)
    lat, lon = np.degrees(np.arcsin(x)), np.arange(48) * 7.5
    la, lo = (g.ravel() for g in np.meshgrid(lat, lon, indexing="ij"))
    weights = np.repeat(w, 48) / 96
    y, e, n = learn.harmonics(la, lo, 6)
    assert np.allclose((y * weights[:, None]).T @ y, np.eye(49), atol=1e-12)
    ll = np.array([k[0] for k in learn.harmonic_labels(6)])
    assert np.allclose((e * weights[:, None]).T @ e + (n * weights[:, None]).T @ n, np.diag(ll * (ll + 1)), atol=1e-10)
    h = 1e-5
    up, down = learn.harmonics(la + h, lo, 6)[0], learn.harmonics(la - h, lo, 6)[0]
    assert np.allclose((up - down) / np.radians(2 * h), n, atol=1e-4)


def test_least_squares(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 3))
    y = x @ [1.0, -2.0, 0.5] + 0.01 * rng.normal(size=400)
    d = spark.createDataFrame(pd.DataFrame({"g": 1, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": np.where(np.arange(400) % 50 == 0, np.nan, y)}))

    def features(b):
        z = b[["a", "b", "c", "y"]].to_numpy()
        return z, z, np.ones(len(b))

    got = learn.least_squares(learn.cross_sums(d, ["g"], features), ["g"], 3).orderBy("k").collect()
    ok = np.arange(400) % 50 != 0
    assert np.allclose([r.coef for r in got], np.linalg.lstsq(x[ok], y[ok], rcond=None)[0], atol=1e-9) and got[0]["rank"] == 3
    double = spark.createDataFrame(pd.DataFrame({"g": 1, "a": x[:, 0], "b": x[:, 0], "c": x[:, 2], "y": y}))
    assert {r.coef for r in learn.least_squares(learn.cross_sums(double, ["g"], features), ["g"], 3).collect()} == {None}


def test_eof_and_ridge():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(500, 4)) @ np.diag([3, 2, 1, 0.1])
    v, s = learn.eof(x.T @ x, 2)
    assert np.allclose(np.abs(v[:, 0]), np.abs(np.linalg.svd(x)[2][0]), atol=1e-9) and s[0] > s[1] and all(v[np.abs(v).argmax(0), range(2)] > 0)
    y = np.roll(x, -1, 0)
    sums = {1: (x.T @ x, x.T @ y, 500)}
    r = learn.ridge_ladder(sums, {1: (x.T @ x, x.T @ y, float((y * y).sum()), 500)}, x.T @ x, [4], [0.1])[0]
    w = np.linalg.solve((v4 := learn.eof(x.T @ x, 4)[0]).T @ x.T @ x @ v4 / 500 + 0.1 * np.eye(4), v4.T @ x.T @ y / 500)
    assert abs(r["loss"] - np.mean(((x @ v4 @ w - y) ** 2).sum(1))) < 1e-9


def test_spectrum(spark):
    t = np.arange(96)
    d = [("even", int(i), float(np.cos(2 * np.pi * i / 12))) for i in t] + [("gap", int(i), float(i)) for i in t if i != 40] + [("short", 0, 1.0), ("short", 1, 2.0)]
    got = learn.spectrum(spark.createDataFrame(d, "code string, t int, v double"), "code", "t", "v", taper=False).toPandas()
    assert set(got.code) == {"even"} and got.frequency[got.power.idxmax()] == pytest.approx(1 / 12)


def test_surrogates_keep_power_and_draws_are_stable(spark):
    x = np.random.default_rng(3).normal(size=(60, 2)).cumsum(0)
    a, b = (rows(learn.surrogate_correlations(spark.newSession() if i else spark, x, 50, 7)) for i in range(2))
    assert a == b and len(a) == 50 and all(-1 <= r[2] <= 1 for r in a)


def test_records(spark):
    lines = spark.createDataFrame([('["A", "1.5", null, "x"]',), ('["B"]',), ("not json",), (None,)], "l string")
    assert rows(records.positional_rows(lines, "l", [("c", "string"), ("v", "double"), ("n", "int"), ("m", "int")])) == [("A", 1.5, None, None), ("B", None, None, None)]
    spans = records.index_spans(spark.createDataFrame([("f", 0, 30), ("f", 10, 30), ("g", 5, None)], "f string, o long, s long"), ["f"], "o", "s").select("f", "first", "last")
    assert rows(spans) == [("f", 0, 9), ("f", 10, 29), ("g", 5, None)]


def test_container(spark, tmp_path):
    chunks = [b"abc", b"", bytes(range(256)) * 40]
    for i in range(2):
        (tmp_path / f"{i}.fcb").write_bytes(container.pack(chunks))
    spark.dataSource.register(container.ContainerSource)
    got = spark.read.format("container").load(str(tmp_path))
    assert got.rdd.getNumPartitions() == 6 and sorted((r.chunk_no, bytes(r.content)) for r in got.collect()) == sorted(list(enumerate(chunks)) * 2)
    raw = container.pack(chunks)
    at, n, crc = container.index(raw)[2]
    assert at % 8 == 0
    with pytest.raises(ValueError):
        container.chunk(raw[at : at + n - 1] + b"?", crc)
    with pytest.raises(ValueError):
        container.index(struct.pack("<4sI", b"NOPE", 0))
    plane = np.random.default_rng(1).integers(0, 256, (9, 7)).astype(np.uint8)
    assert (container.decode_plane(container.encode_plane(plane), 7, 9) == plane).all()
    with pytest.raises(ValueError):
        container.decode_plane(container.encode_plane(plane), 7, 8)


def test_sinks(spark, tmp_path):
    a, b = spark.range(3), spark.range(5)
    sinks.write_once(a, f"{tmp_path}/once")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        sinks.write_once(b, f"{tmp_path}/once")
    for df in (a, b):
        sinks.replace(df, f"{tmp_path}/state")
    assert spark.read.parquet(f"{tmp_path}/state").count() == 5
    sinks.append(a, f"{tmp_path}/ledger")
    sinks.append(b, f"{tmp_path}/ledger")
    assert spark.read.parquet(f"{tmp_path}/ledger").count() == 8
    sinks.report_json(spark.createDataFrame([(1, float("nan"))], "k int, x double"), f"{tmp_path}/report")
    assert spark.read.schema("k int, x double").json(f"{tmp_path}/report").first().x is None


SCHEMA = "id long, k long, kind string, v double, at timestamp"


def feed(spark, path, *batches):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, "id long, k long, kind string, v double, s long").select("id", "k", "kind", "v", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(f"{path}/part={i}")


def stream(spark, path):
    return flows.files_stream(spark, f"{path}/*", SCHEMA, 1)


def test_stream_forecasts_are_scored_once(spark, tmp_path):
    p = f"{tmp_path}/in"
    feed(spark, p, [(1, 1, "f", 5.0, 10), (2, 2, "f", 6.0, 11)], [(3, 2, "t", 4.0, 20)], [(4, 2, "t", 9.0, 30), (5, 1, "t", 5.5, 31), (6, 3, "t", 1.0, 32)])
    got = flows.scored_when_due(stream(spark, p), "k", F.col("kind") == "f", F.col("kind") == "t", "v", "at", f"{tmp_path}/ledger")
    assert rows(got) == [(1, 5.0, 5.5, -0.5), (2, 6.0, 4.0, 2.0)]


def test_stream_freeze_goes_on_across_batches(spark, tmp_path):
    p = f"{tmp_path}/in"
    feed(spark, p, [(1, 1, "x", -5.0, 1), (2, 2, "x", 5.0, 2)], [(3, 1, "x", 5.0, 3), (4, 2, "x", 6.0, 4), (5, 2, "x", None, 5)])
    got = flows.frozen(stream(spark, p).select("k", "id", "v"), "k", "id", "v", 0.0, 10.0, f"{tmp_path}/out")
    assert rows(got.select("id", "status")) == [(1, "refused_range_failure"), (2, "written"), (3, "written"), (4, "duplicate_skipped"), (5, "refused_range_failure")]


def test_stream_cycle_and_gate(spark, tmp_path, monkeypatch):
    p = f"{tmp_path}/in"
    feed(spark, p, [(1, 1, "x", 5.0, 1), (2, 2, "x", None, 2)], [(3, 1, "x", 6.0, 3)], [(4, 2, "x", 7.0, 4)])
    s = lambda: stream(spark, p).select("k", "id", "v")
    got = flows.cycle(s(), "k", "id", "v", 0.0, 10.0, f"{tmp_path}/out").orderBy("batch").collect()
    assert [tuple(r)[:6] for r in got] == [(2, 1, 0, 1, True, 0), (1, 0, 1, 0, True, 1), (1, 1, 0, 0, True, 0)]
    tells = iter(range(100))
    monkeypatch.setattr(flows, "digest", lambda df: (next(tells), 0))  # the frozen part changes under the batch
    assert {r.exit_state for r in flows.cycle(s(), "k", "id", "v", 0.0, 10.0, f"{tmp_path}/other").collect()} == {2}


def test_stream_dedupe_and_split(spark, tmp_path):
    p = f"{tmp_path}/in"
    feed(spark, p, [(1, 1, "x", 1.0, 1), (1, 1, "x", 1.0, 2)], [(1, 1, "x", 1.0, 3), (2, 1, "x", None, 4)])
    assert rows(flows.appended(flows.deduplicated(stream(spark, p), ["id"], "at", "1 day"), f"{tmp_path}/d").select("id")) == [(1,), (2,)]
    good, bad = flows.split(stream(spark, p), F.col("v") > 0, f"{tmp_path}/g", f"{tmp_path}/b")
    assert good.count() == 3 and rows(bad.select("id")) == [(2,)]


@pytest.mark.parametrize("few", [50_000, 50, 1])
def test_exact_percentiles(spark, few):
    rng = np.random.default_rng(1)
    data = [(k, float(v)) for k in ("a", None, "b") for v in np.r_[rng.standard_normal(3000) * 10.0 ** rng.integers(-8, 8, 3000), np.zeros(500), -np.ones(200)]]
    df = spark.createDataFrame([*data, ("c", None), ("d", float("nan")), ("e", 5.0)], "k string, v double").withColumn("g", F.lit(1)).withColumn("b", F.lit("clash"))
    shares = {"p1": 0.01, "p50": 0.5, "p99": 0.99, "least": 0.0, "most": 1.0}
    got = {r.k: r for r in stats.exact_percentiles(df, ["k"], {n: ("v", s) for n, s in shares.items()}, few=few).collect()}
    assert set(got) == {"a", "b", None, "e"} and got["e"].p1 == got["e"].most == 5.0
    for k in ("a", None, "b"):
        x = np.array([v for g, v in data if g == k])
        assert all(np.isclose(got[k][n], np.quantile(x, s), rtol=1e-12, atol=0) for n, s in shares.items())
        at = {r.k: r.p for r in stats.exact_percentiles(df, ["k"], {"p": ("v", 0.9)}, index=True, few=few).collect()}
        assert at[k] == np.sort(x)[int(len(x) * 0.9)]
    assert stats.exact_percentiles(df.where("false"), ["k"], {"p": ("v", 0.5)}).count() == 0
    twice = df.unionByName(df)
    assert stats.exact_percentiles(twice, ["k"], {"p": ("v", 0.3)}).where("k = 'a'").first() == stats.exact_percentiles(df.withColumn("w", F.lit(2)), ["k"], {"p": ("v", 0.3)}, weight="w").where("k = 'a'").first()


def test_unit_guard_raises(spark):
    from fieldcheck.plans.remaining import guarded_celsius

    df = spark.createDataFrame([(1, 300.0, "K"), (2, 20.0, "deg C")], "id long, v double, u string")
    assert rows(guarded_celsius(df, "id", "v", "u")) == [(1, 26.85), (2, 20.0)]
    with pytest.raises(Exception, match="unknown unit"):
        guarded_celsius(df.unionByName(spark.createDataFrame([(3, 70.0, "F")], df.schema)), "id", "v", "u").collect()


def test_crowded_groups_pair_the_same(spark):
    df = spark.createDataFrame([(g, f"k{i}", float(i)) for g in (1, 2) for i in range(25)] + [(None, "x", 1.0), (3, "y", 2.0)], "g int, k string, v double")
    want = rows(joins.pairs_in_group(df, ["g"], "k", ["v"]))
    assert len(want) == 2 * 25 * 24 // 2 and rows(joins.pairs_in_group(df, ["g"], "k", ["v"], crowded=4)) == want
