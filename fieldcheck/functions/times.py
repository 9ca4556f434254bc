"""Times in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The compact notation, its seconds, a time of day without seconds, and an offset without colon.
COMPACT = r"^(\d{4})(\d{2})(\d{2})[T ](\d{2}):?(\d{2})(.*)$"
SECONDS = r"^(.{16})(\d{2})"
MINUTES = r"^(.{10}[T ]\d{2}:\d{2})(?!:)"
OFFSET = r"(:\d{2})([+-]\d{2})(\d{2})$"


def parse_time(text: Column) -> Column:
    """The instant named by ISO text, extended or compact, with ``Z``, an offset or no zone (then UTC, the session's zone).

    Null, unreadable text, text without a time of day and impossible dates give null. Each pattern leaves what it doesn't match as it is, so they
    are applied one after the other, once each.
    """
    t = F.trim(text)
    for pattern, to in ((COMPACT, "$1-$2-$3T$4:$5$6"), (SECONDS, "$1:$2"), (MINUTES, "$1:00"), (OFFSET, "$1$2:$3")):
        t = F.regexp_replace(t, pattern, to)
    return F.when(F.length(F.trim(text)) >= 12, t.try_cast("timestamp"))
