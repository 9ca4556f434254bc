"""Sinks: append-only ledgers, refusal to overwrite, atomic replacement, content-addressed copies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, path: str) -> None:
    """Adds rows to a ledger that is never rewritten."""
    df.write.mode("append").parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    """Writes a finished run; raises if it exists."""
    df.write.mode("errorifexists").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Replaces a state table: the new one is complete before the old one goes, by two renames in its folder."""
    spark = df.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    jvm = spark.sparkContext._jvm
    p = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p(path)):
        fs.rename(p(path), p(old))
    fs.rename(p(new), p(path))
    fs.delete(p(old), True)


def stored(new: DataFrame, store: DataFrame, key: str, digest: str) -> DataFrame:
    """``key, action`` of a content-addressed copy: write, skip (same content) or conflict (other content, never overwritten)."""
    s = store.select(F.col(key).alias("_k"), F.col(digest).alias("_d"))
    j = new.join(s, new[key] == F.col("_k"), "left")
    return j.select(key, F.when(F.col("_k").isNull(), "write").when(F.col(digest) == F.col("_d"), "skip").otherwise("conflict").alias("action"))


def report_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, NaN and infinities as null."""
    cols = [F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("errorifexists").json(path)
