"""Moist thermodynamics and related closed forms as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_C = 273.15


def vapour_pressure(dew_c: Column) -> Column:
    """Saturation vapour pressure in hPa at a temperature in Celsius (Magnus, 6.112 / 17.67 / 243.5)."""
    return F.lit(6.112) * F.exp(F.lit(17.67) * dew_c / (dew_c + 243.5))


def humidity_from_dew(dew_c: Column, pressure_hpa: Column) -> Column:
    """Specific humidity in kg/kg from the dew point."""
    e = vapour_pressure(dew_c)
    return F.lit(0.622) * e / (pressure_hpa - F.lit(0.378) * e)


def humidity_from_rh(t_c: Column, rh: Column, pressure_hpa: Column) -> Column:
    """Specific humidity in kg/kg from temperature and relative humidity in per cent."""
    e = vapour_pressure(t_c) * rh / 100.0
    return F.lit(0.622) * e / (pressure_hpa - F.lit(0.378) * e)


def theta_e(t_c: Column, q: Column, pressure_hpa: Column) -> Column:
    """Equivalent potential temperature in K by Bolton (1980), equations 10, 15 and 43; q is floored at 1e-6."""
    t = t_c + ZERO_C
    qf = F.greatest(q, F.lit(1e-6))
    ratio = qf / (1.0 - qf)
    log_e = F.ln(pressure_hpa * ratio / (F.lit(0.622) + ratio) / 6.112)
    dew = F.lit(243.5) * log_e / (F.lit(17.67) - log_e) + ZERO_C
    lcl = 1.0 / (1.0 / (dew - 56.0) + F.ln(t / dew) / 800.0) + 56.0
    grams = ratio * 1000.0
    return t * F.pow(F.lit(1000.0) / pressure_hpa, F.lit(0.2854) * (1.0 - F.lit(0.28) * ratio)) * F.exp((F.lit(3.376) / lcl - 0.00254) * grams * (1.0 + F.lit(0.00081) * grams))


def standard_height(pressure_hpa: Column) -> Column:
    """Height in metres of a pressure in the standard atmosphere."""
    return F.lit(44330.0) * (1.0 - F.pow(pressure_hpa / 1013.25, F.lit(0.1903)))


def mean_flux(joules: Column, seconds: Column) -> Column:
    """W/m2 from a sum in J/m2 over a declared period; a period that isn't positive gives null rather than a guess."""
    return F.when(seconds > 0, joules / seconds)


def erf(x: Column) -> Column:
    """The error function by Abramowitz and Stegun 7.1.26 (absolute error below 1.5e-7)."""
    t = 1.0 / (1.0 + F.lit(0.3275911) * F.abs(x))
    poly = F.lit(0.0)
    for a in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = (poly + a) * t
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def normal_share(median: Column, sd: Column, threshold: Column) -> Column:
    """P(|d| < threshold) in per cent for a normal of this median and sd."""
    cdf = lambda v: 0.5 * (1.0 + erf((v - median) / (sd * math.sqrt(2.0))))
    return 100.0 * (cdf(threshold) - cdf(-threshold))


def decibels(x: Column) -> Column:
    """10 log10 of positive values; others give null."""
    return F.when(x > 0, 10.0 * F.log10(x))


def dequantised(code: Column, offset: float, scale: float, nodata: int, largest: int) -> Column:
    """offset + code * scale where the code is valid, else null."""
    return F.when((code != nodata) & (code <= largest), F.lit(offset) + code * F.lit(scale))
