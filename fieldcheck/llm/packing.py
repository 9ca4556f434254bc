"""Items of varying length packed into containers of fixed capacity along a space-filling curve."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the byte-level vocabulary splits text into pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Buckets of the hashed document vectors, dimensions they are projected to, bits of the curve per dimension.
BUCKETS, DIMENSIONS, BITS = 1024, 3, 16


def hilbert(axes: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of points with integer coordinates (rows of ``axes``) of ``bits`` bits."""
    x = axes.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def sized(texts: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, tokens, place``: the number of tokens of each text, and its place on the curve.

    Token counts are hashed into a vector, damped by a logarithm, scaled to length one and projected to a few dimensions by a
    fixed random matrix, the same in every task. Null and empty texts have no tokens and stand at the origin.
    """
    kind = pa.schema([("doc_id", pa.int64()), ("tokens", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        code = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        matrix = np.random.default_rng(20240101).standard_normal((BUCKETS, DIMENSIONS))
        signs = np.random.default_rng(7).integers(0, 2, len(ranks) + 1) * 2 - 1
        for batch in batches:
            ids = batch.column(0)
            counts, points = [], np.zeros((len(ids), DIMENSIONS))
            for i, t in enumerate(batch.column(1).to_pylist()):
                tokens = np.asarray(code.encode_ordinary(t), np.int64) if t else np.empty(0, np.int64)
                counts.append(len(tokens))
                if len(tokens):
                    u, c = np.unique(tokens, return_counts=True)
                    v = np.bincount((u * 2654435761 >> 7) % BUCKETS, np.log1p(c) * signs[u], BUCKETS)
                    points[i] = v @ matrix / max(np.sqrt(v @ v), 1e-12)
            cells = np.clip((points + 4) / 8 * 2**BITS, 0, 2**BITS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(hilbert(cells, BITS), pa.int64())], schema=kind)

    return texts.select(F.col(key).cast("long"), text).mapInArrow(run, "doc_id long, tokens long, place long")


PACKED = "doc_id long, piece int, tokens long, place long, container string, start long, filled long"


def _pack(items: DataFrame, capacity: int, tag: str, open_at_once: int, tasks: int) -> DataFrame:
    """Items packed within the tasks of a range-partitioned, sorted table: best fit among a few open containers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number = TaskContext.get().partitionId(), 0
        used: list[int] = []
        held: list[list] = []
        done: list[tuple] = []

        def close(k: int) -> None:
            nonlocal number
            start = 0
            for d, p, t, at in held[k]:
                done.append((d, p, t, at, f"{tag}{task}-{number}", start, used[k]))
                start += t
            number += 1
            del held[k], used[k]

        for b in batches:
            for d, p, t, at in zip(b["doc_id"].tolist(), b["piece"].tolist(), b["tokens"].tolist(), b["place"].tolist(), strict=True):
                fit = [(u, k) for k, u in enumerate(used) if u + t <= capacity]
                if fit:
                    k = max(fit)[1]
                else:
                    if len(used) >= open_at_once:
                        close(max(range(len(used)), key=used.__getitem__))
                    used.append(0)
                    held.append([])
                    k = len(used) - 1
                used[k] += t
                held[k].append((d, p, t, at))
                if used[k] == capacity:
                    close(k)
            yield pd.DataFrame(done, columns=["doc_id", "piece", "tokens", "place", "container", "start", "filled"])
            done.clear()
        while used:
            close(0)
        yield pd.DataFrame(done, columns=["doc_id", "piece", "tokens", "place", "container", "start", "filled"])

    return items.repartitionByRange(tasks, "place", "doc_id").sortWithinPartitions("place", F.desc("tokens"), "doc_id", "piece").mapInPandas(run, PACKED)


def packed(sizes: DataFrame, capacity: int = 2048, open_at_once: int = 64, enough: float = 0.98, per_task: int = 1000, most: int = 1_000_000) -> DataFrame:
    """``doc_id, piece, tokens, container, start``: every item in a container of ``capacity``, neighbours along the curve together.

    Items above the capacity are split into full pieces, each a container of its own, and a rest; others are never split. Rests
    and items are range-partitioned by place on the curve and id, so equal items spread over tasks, and packed along
    it; the number of tasks follows the total size, so that each packs about ``per_task`` containers, until there are as many tasks as shuffle partitions; from there on
    tasks grow to ``most`` containers (some hundred MB of sizes, read as a stream) before there are more of them, so their number stays one that a sample of bounds can be drawn for. Containers filled below ``enough``, the last ones of each task among them, are packed once more, in fewer tasks. Items of size 0 take
    part and need no space. The names of containers depend on the partitioning; no item is lost or repeated.
    """
    full = F.floor(F.col("tokens") / capacity).cast("int")
    s = sizes.select("doc_id", "place", "tokens", full.alias("full"))
    whole = s.where("full > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"))
    whole = whole.select("doc_id", "piece", F.lit(capacity).cast("long").alias("tokens"), F.concat_ws("-", F.lit("w"), "doc_id", "piece").alias("container"), F.lit(0).cast("long").alias("start"))
    rest = s.where((F.col("full") == 0) | (F.col("tokens") % capacity > 0)).select("doc_id", F.col("full").alias("piece"), (F.col("tokens") % capacity).cast("long").alias("tokens"), "place")
    total = rest.agg(F.sum("tokens")).first()[0] or 0
    shuffled = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(round(total / capacity / per_task), max(shuffled, round(total / capacity / most))))
    first = written(_pack(rest, capacity, "a", open_at_once, tasks))
    good = F.col("filled") >= enough * capacity
    again = _pack(first.where(~good).select("doc_id", "piece", "tokens", "place"), capacity, "b", 4 * open_at_once, max(1, tasks // 16))
    cols = ["doc_id", "piece", "tokens", "container", "start"]
    return whole.unionByName(first.where(good).select(*cols)).unionByName(again.select(*cols))


def fill(pack: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, the fewest containers possible, and the share of space used."""
    c = pack.groupBy("container").agg(F.sum("tokens").alias("t"))
    return c.agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), F.ceil(F.sum("t") / capacity).alias("least"), F.round(F.sum("t") / (F.count("*") * capacity), 6).alias("used"))
