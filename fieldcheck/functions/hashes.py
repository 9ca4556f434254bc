"""Digests that Spark has no function for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def crc32c_table() -> np.ndarray:
    """The byte table of the Castagnoli polynomial, reflected."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1)
    return t


def crc32c_of(values: list[bytes | None]) -> list[int | None]:
    """CRC-32C of each value, one byte position of all values at a time."""
    table, n = crc32c_table(), len(values)
    lengths = np.array([len(v) if v is not None else 0 for v in values])
    order = np.argsort(-lengths, kind="stable")
    crc = np.full(n, 0xFFFFFFFF, np.uint32)
    longest = int(lengths.max(initial=0))
    block = np.zeros((n, longest), np.uint8)
    for k, i in enumerate(order):
        if values[i]:
            block[k, : lengths[i]] = np.frombuffer(values[i], np.uint8)
    alive = n
    for j in range(longest):
        while alive and lengths[order[alive - 1]] <= j:
            alive -= 1
        c = crc[:alive]
        crc[:alive] = table[(c ^ block[:alive, j]) & 0xFF] ^ (c >> 8)
    out: list[int | None] = [None] * n
    for k, i in enumerate(order):
        if values[i] is not None:
            out[i] = int(crc[k] ^ 0xFFFFFFFF)
    return out


@F.pandas_udf(LongType())
def crc32c(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """CRC-32C of a binary column; null stays null."""
    for s in batches:
        parts = [pd.Series(crc32c_of(list(s.iloc[i : i + 500])), dtype="Int64") for i in range(0, len(s), 500)]
        yield pd.concat(parts, ignore_index=True) if parts else pd.Series([], dtype="Int64")
