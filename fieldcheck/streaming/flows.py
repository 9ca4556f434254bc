"""Streams of events: windows, deduplication, freezing of runs, forecasts that wait for their truth, quarantine.

Each flow reads a file stream, runs until what is there is consumed (``availableNow``), and keeps its state in checkpoints and
ledgers in the shared folder, so that it goes on where it stopped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def files_stream(spark: SparkSession, path: str, schema, per_batch: int = 1000) -> DataFrame:
    """A stream of the parquet files of a path, files in order of age."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder as a stream. Times without zone are read as UTC."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    parent, leaf = path.rsplit("/", 1)
    return files_stream(spark, f"{parent}/[{leaf[0]}]{leaf[1:]}", schema)  # a pattern also finds a table that is one file


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Runs a stream over what is there, handing every batch to ``each``; a failure is raised."""
    q = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint or f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    q.awaitTermination()


def appended(stream: DataFrame, path: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """The rows of a stream in a table, with the batch each came in. A batch that is repeated after a failure replaces itself."""

    def each(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    run(stream, each, mode, checkpoint)
    return stream.sparkSession.read.option("basePath", path).schema(stream.schema.add("batch", "long")).parquet(f"{path}/*")


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Of updates per key and batch, the last."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def windowed(stream: DataFrame, at: str, by: list[str], length: str, slide: str | None, value: str, lateness: str) -> DataFrame:
    """Counts and sums per window and key; late rows count as long as the lateness allows."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return stream.withWatermark(at, lateness).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(stream: DataFrame, at: str, by: list[str], gap: str, lateness: str) -> DataFrame:
    """Sessions of a key: rows with less than the gap between them."""
    return stream.withWatermark(at, lateness).groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def deduplicated(stream: DataFrame, keys: list[str], at: str, lateness: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def ledger(spark: SparkSession, path: str, schema: str, upto: int) -> DataFrame:
    """The rows that batches before ``upto`` wrote to a ledger; none yet is an empty table."""
    try:
        return spark.read.option("basePath", path).schema(f"{schema}, batch long").parquet(f"{path}/*").where(F.col("batch") < upto)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, batch long")


def freeze_batch(df: DataFrame, batch: int, path: str, key: str, order: str, value: str, low: float, high: float) -> DataFrame:
    """Freezes one batch: its rows with their ``status``, written under ``path``/rows; the keys that it froze go to ``path``/keys.

    The first valid row of a key is a least (order, hash of the row), found by partial aggregation; no key's rows are gathered. A repeated batch replaces itself.
    """
    spark, kind = df.sparkSession, dict(df.dtypes)[key]
    v = F.col(value)
    ok = F.coalesce(v.between(low, high) & ~F.isnan(v.cast("double")), F.lit(False))
    x = df.select(key, order, ok.alias("_ok"), F.struct(F.col(order), F.xxhash64(*df.columns)).alias("_at"))
    before = ledger(spark, f"{path}/keys", f"{key} {kind}", batch).select(F.col(key).alias("_b")).distinct()
    first = x.where("_ok").groupBy(F.col(key).alias("_k")).agg(F.min("_at").alias("_first"))
    j = x.join(first, F.col(key).eqNullSafe(F.col("_k")), "left").join(before.withColumn("_old", F.lit(True)), F.col(key).eqNullSafe(F.col("_b")), "left")
    status = F.when(~F.col("_ok"), "refused_range_failure").when(F.col("_old") | (F.col("_at") != F.col("_first")), "duplicate_skipped").otherwise("written")
    j.select(key, order, status.alias("status")).write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
    rows = spark.read.parquet(f"{path}/rows/batch={batch}")
    rows.where("status = 'written'").select(key).write.mode("overwrite").parquet(f"{path}/keys/batch={batch}")
    return rows


def frozen(stream: DataFrame, key: str, order: str, value: str, low: float, high: float, path: str) -> DataFrame:
    """``key, order, status, batch``: a run is written once, later copies are skipped, and one whose value is missing or out of range is refused and may be tried again.

    Rows of a batch count in their order. What is frozen stands in a ledger, so the flow goes on where it stopped.
    """
    run(stream, lambda df, batch: freeze_batch(df, batch, path, key, order, value, low, high) and None)
    kinds = dict(stream.dtypes)
    return ledger(stream.sparkSession, f"{path}/rows", f"{key} {kinds[key]}, {order} {kinds[order]}, status string", 1 << 62)


def digest(df: DataFrame) -> tuple[int, int]:
    """The number of rows and the sum of their hashes, the same in any order."""
    r = df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 40)))).first()
    return r[0], r[1] or 0


def cycle(stream: DataFrame, key: str, order: str, value: str, low: float, high: float, path: str) -> DataFrame:
    """A status row per batch of a cycle of probing, freezing, summing up and verifying: ``probed, written, skipped, refused, gate_ok, exit_state, batch``.

    The gate: what earlier batches froze must have the same digest before and after the batch. ``exit_state`` is 2 if the gate is broken, 1 if nothing new was frozen, else 0.
    """
    spark, kinds = stream.sparkSession, dict(stream.dtypes)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, status string"

    def each(df: DataFrame, batch: int) -> None:
        old = lambda: digest(ledger(spark, f"{path}/rows", schema, batch))
        before = old()
        n = {r.status: r["count"] for r in freeze_batch(df, batch, path, key, order, value, low, high).groupBy("status").count().collect()}  # three states
        ok = old() == before
        written, skipped, refused = (n.get(s, 0) for s in ("written", "duplicate_skipped", "refused_range_failure"))
        row = (written + skipped + refused, written, skipped, refused, ok, 2 if not ok else 0 if written else 1)
        spark.createDataFrame([row], STATUS).coalesce(1).write.mode("overwrite").parquet(f"{path}/status/batch={batch}")

    run(stream, each)
    return ledger(spark, f"{path}/status", STATUS, 1 << 62)


STATUS = "probed long, written long, skipped long, refused long, gate_ok boolean, exit_state int"


def agreed(stream: DataFrame, keys: list[str], at: str, value: str, lateness: str) -> DataFrame:
    """Overlapping rebuilds merged: per key and time within the watermark the number of copies and the least and greatest value, which differ where copies disagree."""
    return stream.withWatermark(at, lateness).groupBy(*keys, at).agg(F.count("*").alias("copies"), F.min(value).alias("low"), F.max(value).alias("high"))


def split(stream: DataFrame, valid, good_path: str, bad_path: str) -> tuple[DataFrame, DataFrame]:
    """Rows that meet a constraint, and the quarantined rest, each in its table; null counts as not met."""

    def each(df: DataFrame, batch: int) -> None:
        ok = F.coalesce(valid, F.lit(False))
        df.where(ok).write.mode("overwrite").parquet(f"{good_path}/batch={batch}")
        df.where(~ok).write.mode("overwrite").parquet(f"{bad_path}/batch={batch}")

    run(stream, each)
    spark, schema = stream.sparkSession, stream.schema
    return tuple(spark.read.option("basePath", p).schema(schema.add("batch", "long")).parquet(f"{p}/*") for p in (good_path, bad_path))


def scored_when_due(stream: DataFrame, key: str, is_forecast, is_truth, value: str, at: str, path: str) -> DataFrame:
    """``key, forecast, truth, error``: forecasts wait in a ledger, without limit, until their truth is there, and are scored exactly once.

    The first forecast and the first truth of a key count, by batch and time. Each batch adds its forecasts and truths; of the ledgers only the keys of the batch are looked up, and those due that no
    earlier batch has scored are scored. A repeated batch replaces its own part of the ledgers.
    """
    spark = stream.sparkSession
    schema, done_schema = "k long, at timestamp, v double", "k long, forecast double, truth double"

    def each(df: DataFrame, batch: int) -> None:
        row = (F.col(key).cast("long").alias("k"), F.col(at).cast("timestamp").alias("at"), F.col(value).cast("double").alias("v"))
        df.where(is_forecast).select(*row).write.mode("overwrite").parquet(f"{path}/issued/batch={batch}")
        df.where(is_truth).select(*row).write.mode("overwrite").parquet(f"{path}/truth/batch={batch}")
        here = df.where(is_forecast | is_truth).select(F.col(key).cast("long").alias("k")).distinct()  # only these can have become due
        first = lambda n: ledger(spark, f"{path}/{n}", schema, batch + 1).join(here, "k", "left_semi").groupBy("k").agg(F.min(F.struct("batch", "at", "v")).alias(n))
        done = ledger(spark, f"{path}/scored", done_schema, batch).select("k")
        due = first("issued").join(first("truth"), "k").join(done, "k", "left_anti")
        due.select("k", F.col("issued.v").alias("forecast"), F.col("truth.v").alias("truth")).write.mode("overwrite").parquet(f"{path}/scored/batch={batch}")

    run(stream, each)
    s = ledger(spark, f"{path}/scored", done_schema, 1 << 62)
    return s.select(F.col("k").alias(key), "forecast", "truth", (F.col("forecast") - F.col("truth")).alias("error"))


def presence(df: DataFrame, at: str, step_s: int) -> DataFrame:
    """``slot, expected, served``: rounds of a cadence that served anything, per day, against those expected (SET-05, ST-08)."""
    s = df.select(F.to_date(at).alias("slot"), F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / step_s).alias("r"))
    return s.groupBy("slot").agg(F.lit(86400 // step_s).alias("expected"), F.countDistinct("r").alias("served"))
