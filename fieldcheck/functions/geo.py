"""Positions on the sphere and codes along space-filling curves, all as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def wrap_lon(lon: Column) -> Column:
    """A longitude of any convention in [-180, 180)."""
    return F.pmod(lon + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km with R = 6371 km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def located(lat: Column, lon: Column) -> Column:
    """True for a usable position: no null, lat in -90..90, lon in -180..360, not 0/0."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 360) & ~((lat == 0) & (lon == 0)), F.lit(False))


def unit_xyz(lat: Column, lon: Column) -> list[Column]:
    """The unit vector of a position."""
    la, lo = F.radians(lat), F.radians(lon)
    return [F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)]


def _spread(x: Column, gaps: int, bits: int) -> Column:
    """The bits of a non-negative integer with ``gaps`` zeros after each."""
    return reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(F.shiftright(x, i).bitwiseAND(F.lit(1).cast("long")), i * (gaps + 1)) for i in range(bits)))


def morton(parts: list[Column], bits: int) -> Column:
    """The Z-order code of integer coordinates of ``bits`` bits each (at most 62 bits in all)."""
    n = len(parts)
    assert n * bits <= 62
    return reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(_spread(p.cast("long"), n - 1, bits), i) for i, p in enumerate(parts)))


def grid_index(x: Column, low: float, step: float, bits: int) -> Column:
    """The cell of ``x`` on a line of 2**bits cells, clipped to it."""
    return F.greatest(F.lit(0), F.least(F.lit(2**bits - 1), F.floor((x - F.lit(low)) / F.lit(step)))).cast("long")
