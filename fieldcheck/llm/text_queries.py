"""Queries of the text problems: containers, leaked passages, cut texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from ..tables import table
from .leaks import leaked
from .packing import fill, packed, sized
from .truncation import cut_shares, cut_texts


def cut_posts(spark: SparkSession, folder: str) -> DataFrame:
    return cut_texts(table(spark, folder, "documents"), "doc_id", "text", "source", "author")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Posts whose stored text stops before its own end."""
    return cut_posts(spark, folder).where("truncated").select(F.col("key").alias("doc_id"))


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source truncates."""
    return cut_shares(cut_posts(spark, folder))


CAPACITY = 2048


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every post, or piece of one, in a container of 2,048 tokens."""
    return packed(written(sized(table(spark, folder, "documents"), "doc_id", "text")), CAPACITY)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are."""
    return fill(p8_containers(spark, folder), CAPACITY)


def leaks(spark: SparkSession, folder: str, least: float | None = None) -> DataFrame:
    return leaked(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "passage", least=least, seeds_each=1)  # runs of 12 need one seed, and with ``least`` nothing rests on seeds


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Posts with at least 12 consecutive words of a passage."""
    return leaks(spark, folder).where("run >= 12").select("item_id", "doc_id")


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Posts that hold a passage whole, in part or edited: a run of 12 words, or half the score of a full copy."""
    return leaks(spark, folder, 0.5).where("run >= 12 or share >= 0.5").select("item_id", "doc_id", "run", "score", F.round("share", 6).alias("share"))


QUERIES = {f.__name__: f for f in (p8_containers, p8_fill, p9_found, p9_leaks, p10_found, p10_shares)}
