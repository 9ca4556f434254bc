"""Session settings and the one way in which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; where that is unset in local mode (tests), a new temporary one. On a cluster without it, raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_fieldcheck_folder", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark._fieldcheck_folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table written once to the shared folder and read back.

    Cuts the lineage like a checkpoint, is columnar and compressed, and survives the loss of any executor.
    """
    path = f"{shared_folder(df.sparkSession)}/fieldcheck-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
