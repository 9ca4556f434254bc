"""Units as they are spelled in data, and the way to common units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quantity, canonical unit, factor and offset to the quantity's base unit, spellings (as ``plain`` leaves them).
UNITS: list[tuple[str, str, float, float, str]] = [
    ("temperature", "K", 1.0, 0.0, "k kelvin kelvins degk degkelvin °k"),
    ("temperature", "cK", 0.01, 0.0, "ck kx100 k*100 100*k 0.01k centikelvin hundredthsofkelvin"),
    ("temperature", "dK", 0.1, 0.0, "kx10 k*10 0.1k dk tenthsofkelvin"),
    ("temperature", "C", 1.0, 273.15, "c degc °c celsius degcelsius"),
    ("temperature", "dC", 0.1, 273.15, "0.1degc 0.1c degcx10 cx10 c*10 tenthsofadegreecelsius tenthscelsius"),
    ("temperature", "F", 5 / 9, 459.67 * 5 / 9, "f degf °f fahrenheit degfahrenheit"),
    ("temperature", "dF", 0.5 / 9, 459.67 * 5 / 9, "0.1degf 0.1f degfx10 fx10 f*10 tenthsfahrenheit"),
    ("pressure", "Pa", 1.0, 0.0, "pa pascal pascals"),
    ("pressure", "hPa", 100.0, 0.0, "hpa hectopascal hectopascals mb mbar millibar millibars"),
    ("pressure", "kPa", 1000.0, 0.0, "kpa kilopascal"),
    ("pressure", "mmHg", 133.322387415, 0.0, "mmhg torr"),
    ("pressure", "inHg", 3386.389, 0.0, "inhg inchesofmercury"),
    ("geopotential", "m2 s-2", 1.0, 0.0, "m2s-2 m2/s2 j/kg jkg-1"),
    ("geopotential", "gpm", 9.80665, 0.0, "gpm mgeopotential geopotentialmetres geopotentialmeters m metres meters"),
    ("geopotential", "gpdam", 98.0665, 0.0, "gpdam dam"),
    ("mixing", "kg kg-1", 1.0, 0.0, "kgkg-1 kg/kg"),
    ("mixing", "g kg-1", 0.001, 0.0, "gkg-1 g/kg"),
    ("speed", "m s-1", 1.0, 0.0, "ms-1 m/s mps"),
    ("speed", "kt", 1852 / 3600, 0.0, "kt kts knot knots"),
    ("speed", "km h-1", 1 / 3.6, 0.0, "kmh-1 km/h kph"),
    ("speed", "mph", 0.44704, 0.0, "mph mi/h"),
    ("water", "m w.e.", 1.0, 0.0, "mw.e. mwaterequivalent m"),
    ("water", "mm", 0.001, 0.0, "mm mmw.e. kgm-2 kg/m2"),
    ("water", "in", 0.0254, 0.0, "in inch inches"),
    ("length", "m", 1.0, 0.0, "m meter meters metre metres"),
    ("length", "cm", 0.01, 0.0, "cm centimetres centimeters"),
    ("length", "mm", 0.001, 0.0, "mm"),
    ("length", "in", 0.0254, 0.0, "in inch inches"),
    ("length", "km", 1000.0, 0.0, "km kilometre kilometres kilometers"),
    ("length", "mi", 1609.344, 0.0, "mi sm statutemiles miles"),
    ("flux", "W m-2", 1.0, 0.0, "wm-2 w/m2"),
    ("flux", "J m-2", 1.0, 0.0, "jm-2 j/m2"),
    ("flux", "kJ m-2", 1000.0, 0.0, "kjm-2 kj/m2"),
    ("share", "1", 1.0, 0.0, "1 0-1 fraction"),
    ("share", "%", 0.01, 0.0, "% percent pct"),
    ("share", "okta", 0.125, 0.0, "okta oktas eighths"),
    ("vertical", "Pa s-1", 1.0, 0.0, "pas-1 pa/s"),
    ("vertical", "hPa h-1", 100 / 3600, 0.0, "hpah-1 hpa/h mb/hr"),
]
# The quantity of each known training unit; lengths named as water equivalent are water.
QUANTITY_OF = {"K": "temperature", "Pa": "pressure", "m2 s-2": "geopotential", "kg kg-1": "mixing", "m s-1": "speed", "m water equivalent": "water",
               "m": "length", "W m-2": "flux", "%": "share", "1": "share", "Pa s-1": "vertical"}
#: Sums over a period rather than rates: divided by the period's seconds.
SUMS = ("J m-2", "kJ m-2")

# How remarks on ascents name the unit of t, as patterns, the first that matches holding.
SOUNDING_REMARKS: list[tuple[str, str]] = [
    (r"hundredths of kelvin|\[cK\]|K ?x ?100\b|K\*100|0\.01 ?K", "cK"),
    (r"tenths of kelvin|0\.1 ?K\b|K ?x ?10\b|K\*10\b", "dK"),
    (r"tenths,? (of a degree )?Fahrenheit|0\.1 ?deg ?F|degF ?x ?10|F\*10", "dF"),
    (r"tenths,? (of a degree )?Celsius|0\.1 ?deg ?C|deg ?C ?x ?10|C\*10", "dC"),
]

NUMBER = r"[-+]?\d+(?:[.,]\d+)*(?:[eE][-+]?\d+)?"


def plain(text: Column) -> Column:
    """A unit without what is only spelling: case, blanks, ``**`` and ``^``, superscripts."""
    t = F.lower(F.translate(text, "²³⁻¹º", "23-1°"))
    return F.regexp_replace(t, r"\s+|\*\*|\^", "")


def spelled(quantity: Column, text: Column) -> Column:
    """The canonical unit of a spelling for a quantity; null for null, blank and unknown text."""
    words = [(f"{q}|{w}", u) for q, u, _, _, ws in UNITS for w in ws.split(" ")]
    known = F.create_map(*[F.lit(x) for pair in words for x in pair])
    return known[F.concat_ws("|", quantity, plain(text))]


def scale_of(quantity: Column, unit: Column) -> tuple[Column, Column]:
    """Factor and offset of a canonical unit to the base unit of its quantity."""
    key = F.concat_ws("|", quantity, unit)
    factor = F.create_map(*[F.lit(x) for q, u, f, _, _ in UNITS for x in (f"{q}|{u}", f)])
    offset = F.create_map(*[F.lit(x) for q, u, _, o, _ in UNITS for x in (f"{q}|{u}", o)])
    return factor[key], offset[key]


def quantity_of(training_unit: Column) -> Column:
    """The quantity that a variable's training unit measures."""
    return F.create_map(*[F.lit(x) for pair in QUANTITY_OF.items() for x in pair])[training_unit]


def number_in(text: Column) -> Column:
    """The first number in a text, with a decimal comma or point; of several marks the last one is decimal."""
    raw = F.regexp_extract(text, NUMBER, 0)
    raw = F.regexp_replace(F.regexp_replace(raw, r"[.,](?=\d+[.,])", ""), ",", ".")
    return raw.try_cast("double")


def unit_after_number(text: Column) -> Column:
    """What follows the first number in a text; null if nothing does."""
    return F.nullif(F.trim(F.regexp_extract(text, NUMBER + r"(.*)$", 1)), F.lit(""))


def unit_in_note(note: Column, code: Column) -> Column:
    """The unit that a free note states: after ``units:``, ``given as`` or ``in``, in brackets, or after a logbook's mark; else null."""
    found = [
        F.regexp_extract(note, r"units?:\s*(.+?)\s*$", 1),
        F.regexp_extract(note, r"given as\s+(.+?)(?:,\s*checked)?\s*$", 1),
        F.regexp_extract(note, r"^log sheet \d+,\s*(.+?)\s*$", 1),
        F.regexp_extract(note, r"\[(.+?)\]", 1),
        F.regexp_extract(note, r"^\((.+?)\)\s*$", 1),
        F.when(note.startswith(F.concat(code, F.lit(" in "))), F.regexp_extract(note, r"^\w+ in (.+?)\s*$", 1)).otherwise(""),
    ]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found])


def unit_in_remarks(remarks: Column) -> Column:
    """The canonical unit of t that an ascent's remarks state; null if they don't."""
    out = F.lit(None).cast("string")
    for pattern, unit in reversed(SOUNDING_REMARKS):
        out = F.when(remarks.rlike("(?i)" + pattern), unit).otherwise(out)
    return out
