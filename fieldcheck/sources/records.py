"""Scans of records: positional rows, JSON lines, indexes with byte spans, catalogues, directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def positional_rows(lines: DataFrame, text: str, columns: list[tuple[str, str]]) -> DataFrame:
    """Named, typed columns of JSON arrays by position. Unreadable lines are left out; short rows and values of another type give nulls."""
    a = lines.select(F.from_json(text, "array<string>").alias("_a")).where("_a is not null")
    return a.select(*(F.get("_a", F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(columns)))


def json_lines(lines: DataFrame, text: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Parsed records, and the lines that couldn't be read."""
    x = lines.select(F.col(text).alias("line"), F.from_json(text, schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r._bad").isNotNull() | F.col("r").isNull()
    return x.where(~bad).select("r.*").drop("_bad"), x.where(bad).select("line")


def index_spans(index: DataFrame, by: list[str], offset: str, size: str) -> DataFrame:
    """``first, last`` byte of each record of an index: up to the next record's offset, or the file's size (null: open) for the last."""
    after = F.lead(offset).over(Window.partitionBy(*by).orderBy(offset))
    return index.withColumn("first", F.col(offset)).withColumn("last", F.coalesce(after, F.col(size)) - 1)


def byte_span(content: Column, first: Column, length: Column) -> Column:
    """Bytes of a binary column from a 0-based offset; beyond the end they are fewer."""
    return F.substring(content, (first + 1).cast("int"), length.cast("int"))


def catalogue_assets(records: DataFrame, collection: Column, item: Column, assets: Column) -> DataFrame:
    """``collection, item, asset, value``: a map of assets flattened; records without assets give none."""
    return records.select(collection.alias("collection"), item.alias("item"), F.explode(F.map_entries(assets)).alias("e")).select("collection", "item", F.col("e.key").alias("asset"), F.col("e.value").alias("value"))


def archive(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All JSON files of a pattern with their path; files that can't be read are skipped, not fatal."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(pattern).withColumn("path", F.input_file_name())


def partial_digest(content: Column, size: Column, ends: int = 1 << 20) -> Column:
    """SHA-256 over the first and last mebibyte of a file, and its size."""
    tail = F.substring(content, F.greatest(size - ends, F.lit(0)).cast("int") + 1, F.lit(ends))
    return F.sha2(F.concat(F.substring(content, F.lit(1), F.lit(ends)), tail, size.cast("string").cast("binary")), 256)


def tiered(fields: DataFrame, by: list[str], tier: str, order: list[str]) -> DataFrame:
    """Of rows in several tiers, those of the first tier in ``order`` that a group has; tiers are never mixed."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(tier))
    best = fields.where(place > 0).groupBy(*by).agg(F.min(place).alias("_best"))
    return fields.join(best, by).where(place == F.col("_best")).drop("_best")
