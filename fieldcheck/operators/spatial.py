"""Points near other points and inside regions, by cell codes along a space-filling curve.

Discs and regions are covered with ranges of cell codes, points are joined to the ranges by their code, and
an exact test follows. Nothing is compared outside a shared cell, so no cross join is ever planned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, grid_index, haversine_km, morton, unit_xyz, wrap_lon

#: Depth of the longitude-latitude quadtree that covers regions (cells of 0.02 by 0.01 degrees), and by how many bits its codes are cut to the blocks of the join (cells of 1.4 by 0.7 degrees).
DEPTH, BLOCK = 14, 12
#: A cell with more positions than this is split among several tasks.
CROWDED = 2000


def range_join(points: DataFrame, code: str, ranges: DataFrame, low: str, high: str, shift: int, salts: int = 4) -> DataFrame:
    """Rows of ``points`` joined to the rows of ``ranges`` with ``low <= code <= high``.

    The sorted codes are cut into aligned blocks of ``2**shift``; a range is cut at each block it touches, so the
    join is an equality on the block with what the range has of it as a residual condition. The points of a block are spread over ``salts`` keys, for each of which
    the ranges, the smaller side, are repeated. Null codes and bounds join nothing.
    """
    left = points.withColumn("_block", F.shiftright(F.col(code), shift)).withColumn("_salt", F.pmod(F.xxhash64(*points.columns), F.lit(salts)).cast("int"))
    right = ranges.withColumn("_block", F.explode(F.sequence(F.shiftright(F.col(low), shift), F.shiftright(F.col(high), shift)))).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, (left["_block"] == right["_block"]) & (left["_salt"] == right["_salt"]) & left[code].between(right[low], right[high])).drop("_block", "_salt")


def near_pairs(points: DataFrame, key: str, lat: str, lon: str, radius_km: float) -> DataFrame:
    """Pairs ``key_a < key_b`` of different keys of which any two positions lie at most ``radius_km`` apart.

    Positions become cells of a cubic grid over the unit sphere with an edge of twice the radius (no seam, no
    poles), coded in Z-order; the disc round a point touches at most 8 cells. Repeated positions of a key are
    merged first. Rows without key or usable position must be filtered by the caller; nulls give no pair.
    An area with many keys yields its true pairs only: the distance is a condition of the join itself. The positions of a crowded cell are
    split into parts of about CROWDED by key, each joined by a task of its own with the discs that touch the cell.
    """
    chord = 2 * math.sin(min(radius_km / (2 * EARTH_KM), math.pi / 2)) * (1 + 1e-9) + 1e-12
    bits = max(1, min(20, math.ceil(math.log2(2 / (2 * chord) + 1))))
    step = max(2 * chord, 2 / (2**bits - 1))
    p = points.select(F.col(key).alias("_k"), F.col(lat).alias("_la"), F.col(lon).alias("_lo")).dropna().distinct()
    xyz = unit_xyz(F.col("_la"), F.col("_lo"))
    home = p.withColumn("_c", morton([grid_index(x, -1.0, step, bits) for x in xyz], bits))
    ends = [F.array_distinct(F.array(grid_index(x - chord, -1.0, step, bits), grid_index(x + chord, -1.0, step, bits))) for x in xyz]
    cover = p.select("*", ends[0].alias("_x"), ends[1].alias("_y"), ends[2].alias("_z"))
    for c in ("_x", "_y", "_z"):
        cover = cover.withColumn(c, F.explode(c))
    cover = cover.select(F.col("_k").alias("_k2"), F.col("_la").alias("_la2"), F.col("_lo").alias("_lo2"), morton([F.col("_x"), F.col("_y"), F.col("_z")], bits).alias("_c2"))
    near = haversine_km(F.col("_la"), F.col("_lo"), F.col("_la2"), F.col("_lo2")) <= radius_km
    crowded = home.groupBy("_c").agg(F.count("*").alias("_n")).where(F.col("_n") > CROWDED).select("_c", F.ceil(F.col("_n") / CROWDED).cast("int").alias("_parts"))
    home = home.join(crowded, "_c", "left").withColumn("_part", F.pmod(F.xxhash64("_k"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    cover = cover.join(crowded.withColumnRenamed("_c", "_c2"), "_c2", "left").withColumn("_part2", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return home.join(cover, (F.col("_c") == F.col("_c2")) & (F.col("_part") == F.col("_part2")) & (F.col("_k") < F.col("_k2")) & near).select(F.col("_k").alias("key_a"), F.col("_k2").alias("key_b")).distinct()


def _boxes(r) -> list[tuple[float, float, float, float]]:
    """The bounding boxes (west, east, south, north) of a region, split at the date line."""
    wrap = lambda x: (x + 180) % 360 - 180
    pad = 1e-6
    if r.kind == "box":
        whole = r.east - r.west >= 360
        w, e, s, n = wrap(r.west), wrap(r.east), r.south, r.north
    elif r.kind == "disc":
        d = r.radius_km / EARTH_KM
        s, n = r.clat - math.degrees(d), r.clat + math.degrees(d)
        c = math.cos(math.radians(r.clat))
        whole = s <= -90 or n >= 90 or d >= math.pi / 2 or math.sin(d) >= c
        half = 180.0 if whole else math.degrees(math.asin(math.sin(d) / c))
        w, e = wrap(r.clon - half - pad), wrap(r.clon + half + pad)
    else:
        lons, lats = [p["lon"] for p in r.ring], [p["lat"] for p in r.ring]
        whole = max(lons) > 180 or min(lons) < -180
        w, e, s, n = min(lons), max(lons), min(lats), max(lats)
    s, n = s - pad, n + pad
    if whole:
        return [(-180.0, 180.0, s, n)]
    return [(w - pad, e + pad, s, n)] if w <= e else [(w - pad, 180.0, s, n), (-180.0, e + pad, s, n)]


def _cover(boxes: list[tuple[float, float, float, float]]) -> list[tuple[int, int]]:
    """Ranges of codes at DEPTH whose cells cover the boxes. Cells at the edges are a sixty-fourth of the wider side or less, so small regions have small cells."""
    wide = max((max(b[1] - b[0], b[3] - b[2]) for b in boxes), default=360.0)
    deepest = max(1, min(DEPTH, math.ceil(math.log2(360 / max(wide, 1e-9))) + 6))
    found: list[tuple[int, int]] = []
    stack = [(0, 0, 0, 0)]
    while stack:
        level, code, ix, iy = stack.pop()
        n = 2**level
        w, e, s, t = -180 + 360 * ix / n, -180 + 360 * (ix + 1) / n, -90 + 180 * iy / n, -90 + 180 * (iy + 1) / n
        hit = [b for b in boxes if b[0] <= e and b[1] >= w and b[2] <= t and b[3] >= s]
        if not hit:
            continue
        if level == deepest or any(b[0] <= w and b[1] >= e and b[2] <= s and b[3] >= t for b in hit):
            size = 4 ** (DEPTH - level)
            found.append((code * size, (code + 1) * size - 1))
        else:
            stack += [(level + 1, code * 4 + dy * 2 + dx, ix * 2 + dx, iy * 2 + dy) for dx in (0, 1) for dy in (0, 1)]
    merged: list[tuple[int, int]] = []
    for lo, hi in sorted(found):
        if merged and lo <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
        else:
            merged.append((lo, hi))
    return merged


def cover_regions(regions: DataFrame) -> DataFrame:
    """``region_no`` with the code ranges ``low..high`` that cover each region; a region with missing bounds gets none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                try:
                    rows += [(r.region_no, lo, hi) for lo, hi in _cover(_boxes(r))]
                except (TypeError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=["region_no", "low", "high"])

    return regions.mapInPandas(run, "region_no string, low long, high long")


def _inside(lat: Column, lon: Column) -> Column:
    """The exact test of a position (lon in [-180, 180)) against the region columns."""
    west, east = wrap_lon(F.col("west")), wrap_lon(F.col("east"))
    across = F.when(F.col("east") - F.col("west") >= 360, F.lit(True)).when(west <= east, (lon >= west) & (lon < east)).otherwise((lon >= west) | (lon < east))
    box = (lat >= F.col("south")) & (lat < F.col("north")) & across
    disc = haversine_km(lat, lon, F.col("clat"), F.col("clon")) <= F.col("radius_km")
    n = F.size("ring")

    def odd(x: Column) -> Column:
        def crosses(i: Column) -> Column:
            a, b = F.get(F.col("ring"), i), F.get(F.col("ring"), F.pmod(i + 1, n))
            at = a["lon"] + (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"])
            return ((a["lat"] > lat) != (b["lat"] > lat)) & (x < at)

        return F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses)) % 2 == 1

    polygon = (n >= 3) & (odd(lon) | odd(lon + 360) | odd(lon - 360))
    return F.coalesce(F.when(F.col("kind") == "box", box).when(F.col("kind") == "disc", disc).when(F.col("kind") == "polygon", polygon), F.lit(False))


def memberships(points: DataFrame, key: str, lat: str, lon: str, regions: DataFrame, region: str) -> DataFrame:
    """Pairs (key, region) of which any position of the key lies in the region, as ``key_a, key_b``.

    Boxes are closed to the south and west and open to the north and east, and cross the date line if west > east
    after wrapping to -180..180; discs are closed; polygons are even-odd with straight edges in lon/lat.
    Positions are coded in a lon/lat quadtree, regions covered by code ranges; the range join is refined exactly.
    The regions are joined, not broadcast by hand: Spark does that itself if they are small.
    """
    step_x, step_y = 360.0 / 2**DEPTH, 180.0 / 2**DEPTH
    x, y = grid_index(F.col("_lo"), -180.0, step_x, DEPTH), grid_index(F.col("_la"), -90.0, step_y, DEPTH)
    p = points.select(F.col(key).alias("key_a"), F.col(lat).alias("_la"), wrap_lon(F.col(lon)).alias("_lo")).dropna().distinct().withColumn("_code", morton([x, y], DEPTH))
    r = regions.select(F.col(region).cast("string").alias("region_no"), "kind", "west", "east", "south", "north", "clat", "clon", "radius_km", "ring")
    near = range_join(p, "_code", cover_regions(r), "low", "high", BLOCK)
    return near.join(r, "region_no").where(_inside(F.col("_la"), F.col("_lo"))).select("key_a", F.col("region_no").alias("key_b")).distinct()
