"""Percentiles of very large columns from mergeable sketches with relative rank error.

A sketch is a ladder of relative compactors: each level keeps its largest items untouched and, when full, compacts
sections of the rest, sending every other item up with double weight. So the rank error shrinks towards the
protected tail. Two ladders, one of them over negated values, protect both tails. Sketches of partitions, days or
any other pieces merge level by level into one with the same bound.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECTIONS = 3
WORD = (1 << 64) - 1


def mixed(x: int) -> int:
    """A 64-bit number scrambled (the finaliser of SplitMix64, Steele et al. 2014)."""
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & WORD
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & WORD
    return x ^ (x >> 31)


class Ladder:
    """Relative compactors that protect the largest items.

    Each compaction tosses a coin of its own. The coins follow from the seed, so a task that runs again builds the same sketch, but ladders of
    different seeds, and merged ones, toss independently; else all pieces would err to one side.
    """

    def __init__(self, k: int, seed: int = 0):
        self.k, self.items, self.state, self.sections, self.width, self.coin = k, [np.empty(0)], [0], [SECTIONS], [float(k)], mixed(seed & WORD)

    def _toss(self) -> int:
        self.coin = (self.coin + 0x9E3779B97F4A7C15) & WORD
        return mixed(self.coin) >> 63

    def _room(self, h: int) -> int:
        return 2 * self.sections[h] * self._step(h)

    def _step(self, h: int) -> int:
        return max(4, 2 * round(self.width[h] / 2))

    def add(self, x: np.ndarray) -> None:
        self.items[0] = np.concatenate([self.items[0], x])
        self.compress()

    def merge(self, other: Ladder) -> None:
        self.coin = mixed(self.coin ^ mixed((other.coin + 1) & WORD))
        while len(self.items) < len(other.items):
            self._grow()
        for h, x in enumerate(other.items):
            self.items[h] = np.concatenate([self.items[h], x])
            self.state[h] |= other.state[h]
            if other.sections[h] > self.sections[h]:
                self.sections[h], self.width[h] = other.sections[h], other.width[h]
        self.compress()

    def _grow(self) -> None:
        self.items.append(np.empty(0))
        self.state.append(0)
        self.sections.append(SECTIONS)
        self.width.append(float(self.k))

    def compress(self) -> None:
        h = 0
        while h < len(self.items):
            while len(self.items[h]) >= self._room(h):
                if h + 1 == len(self.items):
                    self._grow()
                x = np.sort(self.items[h])
                part = min(self.sections[h], (~self.state[h] & (self.state[h] + 1)).bit_length())
                keep = self._room(h) // 2 + (self.sections[h] - part) * self._step(h)
                m = (len(x) - keep) // 2 * 2
                first = self._toss()
                self.items[h + 1] = np.concatenate([self.items[h + 1], x[first:m:2]])
                self.items[h] = x[m:]
                self.state[h] += 1
                if self.state[h] >= 1 << (self.sections[h] - 1) and self.width[h] / math.sqrt(2) >= 4:
                    self.sections[h], self.width[h] = 2 * self.sections[h], self.width[h] / math.sqrt(2)
            h += 1

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        x = np.concatenate(self.items)
        w = np.concatenate([np.full(len(v), 2.0**h) for h, v in enumerate(self.items)])
        o = np.argsort(x, kind="stable")
        return x[o], w[o]


HEAD = "<HqddQQQHH"


class Sketch:
    """Both ladders, the exact count, least and greatest value; while small, just the values."""

    def __init__(self, k: int, seed: int = 0):
        self.k, self.n, self.low, self.high, self.raw, self.ladders, self.seed = k, 0, math.inf, -math.inf, np.empty(0), None, seed & WORD

    def add(self, x: np.ndarray) -> None:
        if not len(x):
            return
        self.n, self.low, self.high = self.n + len(x), min(self.low, float(x.min())), max(self.high, float(x.max()))
        if self.ladders is None and len(self.raw) + len(x) < 2 * SECTIONS * self.k:
            self.raw = np.concatenate([self.raw, x])
            return
        self._lift()
        self.ladders[0].add(x)
        self.ladders[1].add(-x)

    def _lift(self) -> None:
        if self.ladders is None:
            self.ladders = (Ladder(self.k, self.seed), Ladder(self.k, self.seed ^ 0x5555555555555555))
            self.ladders[0].add(self.raw)
            self.ladders[1].add(-self.raw)
            self.raw = np.empty(0)

    def merge(self, other: Sketch) -> None:
        if other.ladders is None:
            self.add(other.raw)
            return
        self._lift()
        self.n, self.low, self.high = self.n + other.n, min(self.low, other.low), max(self.high, other.high)
        for a, b in zip(self.ladders, other.ladders, strict=True):
            a.merge(b)

    def quantiles(self, probabilities: list[float]) -> list[float]:
        """The value of rank ceil(p n); below the middle from the ladder that protects the low tail, else from the other."""
        if self.ladders is None:
            x = np.sort(self.raw)
            return [float(x[min(len(x) - 1, max(0, math.ceil(p * len(x)) - 1))]) for p in probabilities]
        out = []
        hx, hw = self.ladders[0].weighted()
        lx, lw = self.ladders[1].weighted()
        above, below = np.cumsum(hw[::-1]), np.cumsum(lw[::-1])
        for p in probabilities:
            if p <= 0 or p >= 1:
                out.append(self.low if p <= 0 else self.high)
            elif p < 0.5:
                i = int(np.searchsorted(below, max(1, math.ceil(p * self.n))))
                out.append(-float(lx[::-1][min(i, len(lx) - 1)]))
            else:
                i = int(np.searchsorted(above, max(1, self.n - math.ceil(p * self.n) + 1)))
                out.append(float(hx[::-1][min(i, len(hx) - 1)]))
        return out

    def rank_error(self) -> float:
        """The bound of the rank error as a share of the mass of the nearer tail, at three standard errors; 0 if exact."""
        return 0.0 if self.ladders is None else 3 * math.sqrt(0.0512 / SECTIONS) / self.k

    def pack(self) -> bytes:
        levels = [(0, 0, 0.0, self.raw)] if self.ladders is None else [(s, c, w, x) for one in self.ladders for s, c, w, x in zip(one.state, one.sections, one.width, one.items, strict=True)]
        split = 0 if self.ladders is None else len(self.ladders[0].items)
        coins = (0, 0) if self.ladders is None else tuple(one.coin for one in self.ladders)
        head = struct.pack(HEAD, self.k, self.n, self.low, self.high, self.seed, *coins, split, len(levels))
        return head + b"".join(struct.pack("<qqdI", s, c, w, len(x)) + x.astype("<f8").tobytes() for s, c, w, x in levels)

    @staticmethod
    def unpack(b: bytes) -> Sketch:
        k, n, low, high, seed, *coins, split, count = struct.unpack_from(HEAD, b)
        at, out, levels = struct.calcsize(HEAD), Sketch(k, seed), []
        for _ in range(count):
            s, c, w, m = struct.unpack_from("<qqdI", b, at)
            at += struct.calcsize("<qqdI")
            levels.append((s, c, w, np.frombuffer(b, "<f8", m, at)))
            at += 8 * m
        out.n, out.low, out.high = n, low, high
        if not split:
            out.raw = levels[0][3]
            return out
        out.ladders = (Ladder(k), Ladder(k))
        for one, part, coin in zip(out.ladders, (levels[:split], levels[split:]), coins, strict=True):
            one.coin = coin
            one.state, one.sections, one.width, one.items = ([x[i] for x in part] for i in range(4))
        return out


SKETCHES = "key string, field string, piece long, n long, sketch binary"
KIND = pa.schema([("key", pa.string()), ("field", pa.string()), ("piece", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])


def build_sketches(df: DataFrame, key: Column, fields: list[str], k: int = 64, rows: int = 1_000_000) -> DataFrame:
    """``key, field, piece, n, sketch``: sketches of each numeric field per key, made where the rows lie, without a shuffle.

    Each task sketches blocks of at most ``rows`` rows, one sketch per key and field in the block, so memory is bounded whatever the
    number of rows or keys. Null and NaN values are left out, as are rows with null key; the caller nulls fillers. Infinite values count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = piece = 0
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count >= rows:
                yield block(held, piece)
                held, count, piece = [], 0, piece + 1
        if count:
            yield block(held, piece)

    def block(held: list[pa.RecordBatch], piece: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        codes = pc.dictionary_encode(t.column(0)).combine_chunks()
        names = codes.dictionary
        idx = codes.indices.to_numpy(zero_copy_only=False)
        task = TaskContext.get().partitionId()
        named = names.to_pylist()
        keys, what, ns, blobs = [], [], [], []
        for f, field in enumerate(fields):
            x = t.column(f + 1).to_numpy()
            ok = ~np.isnan(x)
            i, v = idx[ok], x[ok]
            o = np.argsort(i, kind="stable")
            i, v = i[o], v[o]
            edge = np.flatnonzero(np.r_[True, i[1:] != i[:-1], True]) if len(i) else np.zeros(1, int)
            for a, e in zip(edge[:-1], edge[1:], strict=True):
                s = Sketch(k, int.from_bytes(hashlib.blake2b(f"{task}|{piece}|{field}|{named[i[a]]}".encode(), digest_size=8).digest(), "little"))
                s.add(v[a:e])
                keys.append(i[a])
                what.append(field)
                ns.append(s.n)
                blobs.append(s.pack())
        return pa.RecordBatch.from_arrays([names.take(pa.array(keys, pa.int32())), pa.array(what, pa.string()), pa.array([piece] * len(keys), pa.int64()), pa.array(ns, pa.int64()), pa.array(blobs, pa.binary())], schema=KIND)

    return df.select(key.alias("key"), *(F.col(f).cast("double") for f in fields)).where("key is not null").mapInArrow(run, SKETCHES)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches sorted by key and field, merged one after the other; one sketch is held at a time."""
    last, now, out = None, None, []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*[(a, b, 0, s.n, s.pack()) for (a, b), s in out], strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, KIND, strict=True)], schema=KIND)

    for b in batches:
        for key, field, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if (key, field) != last:
                if last:
                    out.append((last, now))
                last, now = (key, field), Sketch.unpack(blob)
            else:
                now.merge(Sketch.unpack(blob))
        if len(out) >= 2000:
            yield flush()
            out = []
    if last:
        out.append((last, now))
    yield flush()


def merge_sketches(sketches: DataFrame, salts: int = 64) -> DataFrame:
    """One sketch per key and field from the sketches of any pieces: partitions, days, earlier merges.

    The sketches of one key are first folded in ``salts`` groups, spread over tasks, then these are folded; one sketch is held at
    a time, so a key that every one of a million tasks has costs each group some thousand merges and no memory.
    """
    s = sketches.select("key", "field", "sketch")
    if salts:
        s = s.withColumn("salt", F.pmod(F.xxhash64("sketch"), F.lit(salts))).repartition("key", "field", "salt").sortWithinPartitions("key", "field", "salt").mapInArrow(_fold, SKETCHES).select("key", "field", "sketch")
    return s.repartition("key", "field").sortWithinPartitions("key", "field").mapInArrow(_fold, SKETCHES)


def percentiles(sketches: DataFrame, probabilities: list[float], prefix: str = "p") -> DataFrame:
    """``key, field, n, low, high, rank_error`` and a column per probability, such as ``p05``, of merged sketches."""
    names = [f"{prefix}{round(100 * p):02d}" if abs(100 * p - round(100 * p)) < 1e-9 else f"{prefix}{100 * p:g}".replace(".", "_") for p in probabilities]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                s = Sketch.unpack(r.sketch)
                rows.append((r.key, r.field, s.n, s.low, s.high, s.rank_error(), *s.quantiles(probabilities)))
            yield pd.DataFrame(rows, columns=["key", "field", "n", "low", "high", "rank_error", *names])

    return sketches.mapInPandas(run, "key string, field string, n long, low double, high double, rank_error double, " + ", ".join(f"{n} double" for n in names))
