"""The general problems' operators against brute force, and their edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcheck.functions.times import parse_time
from fieldcheck.functions.units import number_in, spelled, unit_in_note, unit_in_remarks
from fieldcheck.operators import spikes
from fieldcheck.operators.regular import regular_series
from fieldcheck.operators.shred import pivoted, shred
from fieldcheck.operators.spatial import memberships, near_pairs
from fieldcheck.operators.units import segments, unit_history, with_units


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- units


def test_segments_are_exact():
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 0.1, 20), rng.normal(5, 0.1, 15), rng.normal(0, 0.1, 10)]
    w = rng.uniform(1, 3, len(x))

    def cost(a, b):
        m = np.average(x[a:b], weights=w[a:b])
        return (w[a:b] * (x[a:b] - m) ** 2).sum()

    best, last = [-2.0], [0]
    for j in range(1, len(x) + 1):
        c = [best[i] + cost(i, j) + 2.0 for i in range(j)]
        best.append(min(c))
        last.append(int(np.argmin(c)))
    starts, j = [], len(x)
    while j:
        j = last[j]
        starts.append(j)
    assert segments(x, w, 2.0) == starts[::-1] == [0, 20, 35]
    assert segments(np.empty(0), np.empty(0), 1.0) == []


UNIT_ROWS = "id long, source string, code string, q string, day long, v double, unit string, resolved string, _fc string"


def test_unit_history_and_edges(spark):
    data = [(i, "a", "t", "temperature", i, 280.0 + i % 3, "K", "x", None) for i in range(20)]
    data += [(100 + i, "a", "t", "temperature", i, 281.0, None, "x", None) for i in range(20)]
    data += [(200 + i, "b", "t", "temperature", i, 28000.0 if i >= 10 else 280.0, None, None, None) for i in range(20)]
    data += [(250 + i, "b", "t", "temperature", i, 280.0, "K", None, None) for i in range(5)] + [(260 + i, "b", "t", "temperature", i, 28000.0, "cK", None, None) for i in range(5)]
    data += [(300, None, "t", "temperature", 3, 0.0, None, None, None), (301, "c", "t", "temperature", 3, None, None, None, None), (302, "z", "t", "temperature", 1, 1.0, None, None, None)]
    df = spark.createDataFrame(data, UNIT_ROWS)
    h = unit_history(df, "source", "code", "q", "day", "v", "unit", default={"temperature": "cK"})
    got = {r.id: r.recorded_unit for r in with_units(df, h, "source", "code", "day", "unit").collect()}
    assert len(got) == len(data)
    assert all(got[100 + i] == "K" for i in range(20))
    assert [got[200 + i] for i in range(20)] == ["K"] * 10 + ["cK"] * 10  # the level shift is a change of unit
    assert got[300] == got[301] == got[302] == "cK"
    empty = df.where("false")
    assert with_units(empty, unit_history(empty, "source", "code", "q", "day", "v", "unit"), "source", "code", "day", "unit").count() == 0


@pytest.mark.parametrize("one_segment", [False, True])
def test_changepoints_decide_units(spark, monkeypatch, one_segment):
    """Sources that change their unit in mid-history, stating the first one elsewhere; a real change of level is none; without changepoints the second half is lost."""
    from fieldcheck.operators import units

    if one_segment:
        monkeypatch.setattr(units, "segments", lambda x, w, penalty: [0])
    rng = np.random.default_rng(5)
    data, truth = [], {}
    for source, quantity, first, then, base in (("a", "speed", "m s-1", "kt", 8.0), ("b", "temperature", "C", "K", 12.0), ("c", "pressure", "hPa", "Pa", 1000.0), ("d", "speed", "m s-1", "m s-1", 8.0), ("e", "length", "km", "mi", 9.0)):
        for day in range(120):
            for k in range(3):
                v, u = base * (1 + rng.normal(0, 0.03)) * (1.4 if source == "d" and day >= 60 else 1), first if day < 60 else then
                v = v if u == first else {"kt": v / 0.514444, "K": v + 273.15, "Pa": v * 100, "mi": v / 1.609344}[u]
                i = len(data)
                stated = u if day < 60 and k == 0 else None
                truth[i] = u
                data.append((i, source, "x", quantity, day, float(v), stated, None, None))
    df = spark.createDataFrame(data, UNIT_ROWS)
    h = units.unit_history(df, "source", "code", "q", "day", "v", "unit")
    wrong = {r.source for r in with_units(df, h, "source", "code", "day", "unit").collect() if r.recorded_unit != truth[r.id]}
    assert wrong == ({"a", "b", "c", "e"} if one_segment else set())


def test_both_tables_are_converted(spark, tmp_path):
    """Levels come out in kelvin beside the readings: by their remarks, by what the source states elsewhere, or as kelvin x 100; missing ones don't."""
    from fieldcheck.plans.problems import QUERIES

    spark.createDataFrame([("tsf", "K", "K")], "code string, units string, training_units string").write.parquet(f"{tmp_path}/variables.parquet")
    reading = "reading_id long, code string, source string, icao string, valid_time timestamp, value double, value_text string, unit string, note string, accum_hours int"
    spark.createDataFrame([(1, "tsf", "a", "X", None, 10.0, None, "degC", None, None)], reading).write.parquet(f"{tmp_path}/field_readings.parquet")
    ascent = lambda t: ("2014-01-08T00:00:00Z", None, [90000, 80000], t, [0, 900])
    data = [
        (1, "far", "T: C*10", [ascent([100, -32768, None]), None, ascent([-50])]), (2, "far", None, [ascent([20])]), (3, "plain", None, [ascent([28000, 27000])]), (4, None, "t 0.1 K", [ascent([2700])]),
        (5, "plain", None, [ascent([None]), ascent(None), ascent([])]), (6, "plain", None, None),
    ]
    spark.createDataFrame(data, "sounding_id long, source string, remarks string, soundings array<struct<time string, n int, p array<int>, t array<int>, z array<int>>>").write.parquet(f"{tmp_path}/soundings.parquet")
    df = QUERIES["p3_converted_all"](spark, str(tmp_path))
    got = {(r.src, r.record_id, r.ascent_no, r.level_no): (r.code, r.source, r.recorded_unit, r.unit, round(r.value, 6)) for r in df.collect()}
    assert got == {
        ("reading", 1, -1, -1): ("tsf", "a", "C", "K", 283.15), ("sounding", 1, 0, 0): ("t", "far", "dC", "K", 283.15), ("sounding", 1, 2, 0): ("t", "far", "dC", "K", 268.15), ("sounding", 2, 0, 0): ("t", "far", "dC", "K", 275.15),
        ("sounding", 3, 0, 0): ("t", "plain", "cK", "K", 280.0), ("sounding", 3, 0, 1): ("t", "plain", "cK", "K", 270.0), ("sounding", 4, 0, 0): ("t", "?", "dK", "K", 270.0),
    } and df.count() == len(got)


def test_unit_text(spark):
    df = spark.createDataFrame([("about 27561,6 cK", "log sheet 4, in Hg", "x; T: 0.1 deg F"), ("-1.5e-3m/s", "tsf in K", "operator change"), (None, None, None), ("", "ok", "t 0.1 K")], "a string, b string, c string")
    got = df.select(number_in(F.col("a")), unit_in_note(F.col("b"), F.lit("tsf")), unit_in_remarks(F.col("c")), spelled(F.lit("pressure"), F.lit("IN Hg"))).collect()
    assert [tuple(r) for r in got] == [(27561.6, "in Hg", "dF", "inHg"), (-0.0015, "K", None, "inHg"), (None, None, None, "inHg"), (None, None, "dK", "inHg")]


def test_times(spark):
    texts = ["2014-01-08T00:18:00Z", "20140113T0210Z", "2014-01-13 12:42", "2014-01-13T01:07:00-08:00", "2014-01-13T01:07+0530", "0000-00-00T00:00Z", "n/a", "", None, "2014-01-13", "x" * 5000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.date_format(parse_time(F.col("t")), "yyyyMMddHHmm")).collect()]
    assert got == ["201401080018", "201401130210", "201401131242", "201401130907", "201401121937", None, None, None, None, None, None]


# --- places


def km(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1, h)))


def test_near_pairs(spark):
    rng = random.Random(5)
    pts = []
    for i, (la, lo) in enumerate([(0, 0.5), (89.99, 10), (-89.98, -170), (45, 179.99), (45, -179.99), (60, 0)] * 8):
        pts.append((f"P{i:02d}", la + rng.uniform(-0.03, 0.03) if abs(la) < 89 else la, lo + rng.uniform(-0.03, 0.03), 1))
    pts += [("P00", pts[0][1], pts[0][2], 2)] * 3 + [(None, 0.0, 0.5, 1), ("N1", None, 3.0, 1)]
    df = spark.createDataFrame(pts, "k string, la double, lo double, key_a int")
    real = [(k, (la, lo)) for k, la, lo, _ in pts if k and la is not None]
    truth = {tuple(sorted((a, b))) for a, p in real for b, q in real if a != b and km(p, q) <= 3.0}
    assert set(rows(near_pairs(df, "k", "la", "lo", 3.0))) == truth and truth
    assert near_pairs(df.where("false"), "k", "la", "lo", 3.0).count() == 0


def test_memberships(spark):
    ring = [(10.0, 10.0), (20.0, 10.0), (20.0, 20.0), (15.0, 12.0), (10.0, 20.0)]
    areas = [
        ("box", "box", 350.0, 10.0, -5.0, 5.0, None, None, None, None), ("date", "box", 170.0, -170.0, -5.0, 5.0, None, None, None, None), ("globe", "box", -180.0, 180.0, 80.0, 90.0, None, None, None, None),
        ("pole", "disc", None, None, None, None, 89.0, 0.0, 300.0, None), ("poly", "polygon", None, None, None, None, None, None, None, ring), ("bad", "box", None, None, None, None, None, None, None, None),
    ]
    a = spark.createDataFrame(areas, "area string, kind string, west double, east double, south double, north double, clat double, clon double, radius_km double, ring array<struct<lon:double,lat:double>>").withColumn("_la", F.lit(1))
    pts = [("W", 0.0, 350.0), ("E", 0.0, 10.0), ("S", -5.0, 0.5), ("N", 5.0, 0.5), ("D", 1.0, 180.0), ("D2", 1.0, -171.0), ("P", 89.5, 180.0), ("I", 11.0, 15.0), ("O", 18.0, 15.0), ("I", 11.0, 15.0), ("X", None, 1.0)]
    got = set(rows(memberships(spark.createDataFrame(pts, "k string, lat double, lon double"), "k", "lat", "lon", a, "area")))
    assert got == {("W", "box"), ("S", "box"), ("D", "date"), ("D2", "date"), ("P", "globe"), ("P", "pole"), ("I", "poly")}


# --- nested records


def test_shred(spark):
    texts = [
        '{"wmo":"1","soundings":{"time":"a","n":9,"p":[1,2,3],"t":[1,null]}}',
        '{"station":{"icao":"X"},"data":{"soundings":[{"levels":[{"p":1},{},{"p":3,"deep":{"q":7}}]},{"p":[],"t":null}]}}',
        '{"metars":[{"t":1.5},null,{"t":"?"}],"taf":{"periods":[{"from":"06Z"}]}}', '{"metars":[{"t":1', "", None, "[1,2]", "{}", '{"metars":{"t":-1}}', '{"a":"' + "x" * 300000 + '"}',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "record_id long, ancestor string")
    s = shred(df, "record_id", "ancestor", ("soundings", "levels", "metars", "periods"), ("data", "station"))
    got = {(r.record_id, r.ancestor, tuple(r.ordinals)): r.leaves for r in s.collect()}
    assert {k[1:] for k in got if k[0] == 0} == {("", ()), ("soundings[]", (0,)), ("soundings[]#", (0, 0)), ("soundings[]#", (0, 1)), ("soundings[]#", (0, 2))}
    assert got[0, "soundings[]#", (0, 1)] == {"p": "2", "t": None} and got[0, "soundings[]#", (0, 2)] == {"p": "3"}
    assert got[1, "", ()] == {"icao": "X"} and got[1, "soundings[].levels[]", (0, 1)] == {} and got[1, "soundings[].levels[]", (0, 2)] == {"p": "3", "deep.q": "7"}
    assert (1, "soundings[]", (1,)) in got and {k[2] for k in got if k[:2] == (2, "metars[]")} == {(0,), (2,)} and got[2, "periods[]", (0,)] == {"from": "06Z"}
    assert not [k for k in got if k[0] in (3, 4, 5, 6)] and got[7, "", ()] == {} and got[8, "metars[]", (0,)] == {"t": "-1"} and len(got[9, "", ()]["a"]) == 300000
    assert rows(pivoted(s, ["metars[]"], ["item_no"], {"t": "double"})) == [(2, 0, 1.5), (2, 2, None), (8, 0, -1.0)]
    assert shred(df.where("false"), "record_id", "ancestor").count() == 0


# --- spikes


def brute(series):
    """Flags of one station's sorted distinct (time, t)."""
    t = np.array([v for _, v in series])
    n = len(t)
    whole = (t == np.round(t)).mean() >= 0.9
    dep = np.full(n, np.nan)
    for i in range(3, n - 3):
        dep[i] = abs(t[i] - np.median(t[i - 3 : i + 4]))
    usual = max(1.4826 * np.nanmedian(np.round(dep, 4)), 0.74 if whole else 0.3)
    edge = np.flatnonzero(np.r_[True, t[1:] != t[:-1], True])
    run = np.repeat(np.diff(edge), np.diff(edge))
    return {x for x, d, r in zip(series, dep, run, strict=True) if not -90 <= x[1] <= 60 or d > 8 * usual or r >= (48 if whole else 12)}


def test_spikes_in_series(spark):
    rng = np.random.default_rng(9)
    data, truth = [], set()
    for k, n in (("HOT", 9000), ("A", 120), ("W", 400), ("FEW", 20)):
        at = np.sort(rng.choice(40 * 86400, n, replace=False))
        t = np.round(10 + 5 * np.sin(at / 86400 * 2 * np.pi) + rng.normal(0, 0.4, n), 0 if k == "W" else 1)
        for i in rng.choice(np.arange(5, n - 5), max(2, n // 200), replace=False):
            t[i] += 25
        t[n // 2 : n // 2 + 14] = 3.0
        if n > 4100:
            t[3990:4060] = 7.7  # a stuck run across blocks
        t[1] = 999.0
        series = sorted({(int(a), float(v)) for a, v in zip(at, t, strict=True)})
        data += [(k, a, v) for a, v in series] + [(k, *series[1])] * 3
        truth |= {(k, *x) for x in brute(series)} if n >= 40 else set()
    data += [(None, 1, 2.0), ("A", None, 2.0), ("A", 5, None)]
    df = spark.createDataFrame(data, "key string, time long, value double").withColumn("rank", F.lit(1))
    got = set(rows(spikes.spikes_in_series(df, "key", "time", "value", 86400, -90, 60)))
    assert got == truth and len(truth) > 100
    assert spikes.spikes_in_series(df.where("false"), "key", "time", "value", 86400, -90, 60).count() == 0


def test_rule_alone_decides_series(spark):
    """A seventh of the readings lie just within the limit of 8 usual departures, one just beyond it; what the usual ones are like mustn't hide that one."""
    values = [0.0, 0.2096, -0.2096, 0.2096, -0.2096, 2.4859, -0.2096] * 20  # the limit is 8 * 1.4826 * 0.2096 = 2.48602
    values[75] = 2.488
    series = [(3600 * i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame([("A", *x) for x in series], "key string, time long, value double")
    got = rows(spikes.spikes_in_series(df, "key", "time", "value", 86400, -90, 60))
    assert got == [("A", *x) for x in brute(series)] == [("A", 3600 * 75, 2.488)]


def test_tail_cutoffs(spark):
    rng = np.random.default_rng(1)
    x = np.round(np.abs(rng.exponential(1.0, 200_000)), 3)
    v, n = np.unique(x, return_counts=True)
    h = spark.createDataFrame([("a", float(s), int(c)) for s, c in zip(v, n, strict=True)] + [("a", 500.0, 900), ("b", 1.0, 5), (None, 0.0, 7)], "k string, s double, n long").withColumn("usual", F.lit(1))
    got = {r.k: r for r in spikes.tail_cutoffs(h, ["k"], "s", "n", 1e-3).collect()}
    whole = {r.k: r for r in spikes.tail_cutoffs(h.where("s < 500"), ["k"], "s", "n", 1e-3, trim=None).collect()}
    assert abs(whole["a"].cutoff - math.log(1000)) < 0.3 and abs(got["a"].cutoff - math.log(1000)) < 0.6 and abs(got["a"].usual - 1.4826 * math.log(2)) < 0.02 and got["b"].cutoff > 0
    assert spikes.tail_cutoffs(h.where("false"), ["k"], "s", "n", 1e-3).count() == 0


def test_the_tail_decides_profiles(spark):
    """Two sources of unlike scatter, whose names say nothing: the same departure is wrong in one and usual in the other."""
    rng = np.random.default_rng(6)
    data = []
    for source, scatter in (("calm", 0.3), ("rough", 2.0)):
        for i in range(150):
            p = np.round(np.exp(np.linspace(11.4, 8.0, 30))).astype(int)
            t = 22000 + 2000 * (np.log(p) - 8) + 100 * rng.normal(0, scatter, 30)
            t[15] += 900 if i == 7 else 0
            data.append((i if source == "calm" else 1000 + i, 0, source, p.tolist(), [int(v) for v in t], None, 0.01, 0.0))
    df = spark.createDataFrame(data, "record_id long, ascent_no int, source string, p array<int>, t array<int>, z array<int>, factor double, offset double")
    cut = spikes.tail_cutoffs(spikes.profile_residuals(df), ["source", "field"], "size", "n", 1e-8, near="near").where("field = 't'").selectExpr("source", "cutoff cut_t", "cast(null as double) cut_z")
    full = df.join(cut, "source").select(*df.columns, "cut_t", "cut_z")
    assert rows(spikes.wrong_in_profiles(full, (150, 340), (-1000, 60000))) == [(7, 0, 15)]
    assert spikes.wrong_in_profiles(full.withColumn("cut_t", F.lit(0.0)), (150, 340), (-1000, 60000)).count() > 1000


def test_wrong_levels():
    x = np.log(np.linspace(90000, 2000, 30))
    y = 220 + 70 * (x - x[-1]) / (x[0] - x[-1])
    z = y.copy()
    for i, d in ((5, 20), (6, 22), (15, -9), (24, 40)):
        z[i] += d
    assert np.flatnonzero(spikes.wrong_levels(x, z, np.ones(30, bool), 6.0)).tolist() == [5, 6, 15, 24]
    assert not spikes.wrong_levels(x, y, np.ones(30, bool), 6.0).any()
    assert not spikes.wrong_levels(x[:2], z[:2], np.ones(2, bool), 6.0).any()
    two = 200.0 + np.arange(20.0)
    two[[8, 9]] += 8  # equally wrong neighbours, each 4 off the line between the other and an honest one
    assert np.flatnonzero(spikes.wrong_levels(np.arange(20.0), two, np.ones(20, bool), 6.0)).tolist() == [8, 9]


def test_wrong_in_profiles(spark):
    n = 12
    p = [90000 - 6000 * i for i in range(n)]
    t = [28000 - 400 * i for i in range(n)]
    t2 = [*t[:3], *[27000] * 6, *t[9:]]
    lim = (0.01, 0.0, 6.0, 150.0)
    data = [
        (1, 0, "s", p, [*t[:5], 32000, *t[6:]], None, *lim), (1, 1, "s", p, t2, None, *lim), (2, 0, "s", p, [*t[:4], 40000, -32768, *t[6:]], [100 * i for i in range(n - 2)], *lim),
        (3, 0, "s", None, None, None, *lim), (4, 0, None, [], [], [], *lim), (5, 0, "s", p, t, [0, 900, 1800, 90000, 3600], *lim), (6, 0, "s", [None] * n, t, None, *lim),
    ]
    schema = "record_id long, ascent_no int, source string, p array<int>, t array<int>, z array<int>, factor double, offset double, cut_t double, cut_z double"
    df = spark.createDataFrame(data, schema)
    assert rows(spikes.wrong_in_profiles(df, (150, 340), (-1000, 60000))) == sorted([(1, 0, 5), *[(1, 1, i) for i in range(3, 9)], (2, 0, 4), (5, 0, 3)], key=str)
    assert spikes.profile_residuals(df).count() > 0 and spikes.wrong_in_profiles(df.where("false"), (150, 340), (-1000, 60000)).count() == 0


# --- regular series


def test_regular_series(spark):
    H = 3600
    data = [("A", 2 * H + 5, 1.0), ("A", 2 * H + 9, 3.0), ("A", 5 * H, 8.0), ("A", 12 * H, 1.0), ("A", 50 * H, 4.0), ("B", 23 * H, 1.0), (None, 1, 1.0), ("A", None, 1.0), ("A", 7, None)]
    df = spark.createDataFrame(data, "key string, slot long, value double")
    got = {(r.key, r.slot // H): (r.value, r.state) for r in regular_series(df, "key", "slot", "value").collect()}
    assert {k[1] for k in got if k[0] == "A"} == {*range(24), *range(48, 72)} and {k[1] for k in got if k[0] == "B"} == set(range(24))
    assert got["A", 2] == (2.0, "observed") and got["A", 3] == (4.0, "interpolated") and got["A", 6] == (None, "missing") and got["A", 0] == (None, "missing") and got["A", 71] == (None, "missing")
    assert sum(s == "observed" for _, s in got.values()) == 5 and len(got) == regular_series(df, "key", "slot", "value").count()
    assert regular_series(df.where("false"), "key", "slot", "value").count() == 0


@pytest.mark.parametrize("name", ["p3_found", "p4_found", "p5_found", "p6_found", "p7_found"])
def test_found_rows_are_distinct(spark, data, name):
    from fieldcheck.plans.problems import QUERIES

    df = QUERIES[name](spark, data)
    assert df.count() == df.distinct().count()


def test_triples_stream():
    """The reader accepts what a JSON parser accepts, keeps arrays in arrays, and yields before the end of the text."""
    import json

    from fieldcheck.operators.shred import triples

    got = list(triples('{"x":[[1,2],[{"q":1.50},"s"]],"y":{"z":[3],"w":true}}', frozenset()))
    assert got == [("x[]#", (0, 0), "x", "1"), ("x[]#", (0, 1), "x", "2"), ("x[][]", (1, 0), None, None), ("x[][]", (1, 0), "q", "1.50"), ("x[]#", (1, 1), "x", "s"), ("#", (0,), "z", "3"), ("", (), "y.w", "true")]
    first = triples('{"a":1,"b":', frozenset())
    assert next(first) == ("", (), "a", "1")
    deep = '{"a":' + "[" * 5000 + "]" * 5000 + "}"
    assert list(triples(deep, frozenset())) == []
    for text in ('{"a":1,}', '{"a" 1}', '{"a":[1,]}', '{"a":01}', '{"a":1}}', '{"a":"\n"}', "[1]", '{"a":tru}', '{"a":[1 2]}', "{,}", '{"a":{"b":1]}'):
        with pytest.raises(ValueError):
            list(triples(text, frozenset()))
        assert text == "[1]" or pytest.raises(ValueError, json.loads, text)


def test_crowded_cell(spark, monkeypatch):
    from fieldcheck.operators import spatial

    pts = [(f"K{i:03d}", 10 + i * 1e-4, 20.0) for i in range(60)]
    df = spark.createDataFrame(pts, "k string, la double, lo double")
    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and km(a[1:], b[1:]) <= 3.0}
    monkeypatch.setattr(spatial, "CROWDED", 7)
    assert set(rows(spatial.near_pairs(df, "k", "la", "lo", 3.0))) == want
