"""Session settings and the two guards every plan uses at scale."""

from __future__ import annotations

import atexit
import functools
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when a count proves it holds no more rows than this.
BROADCAST_ROWS = 200_000


def local_session(cpus: int | str = 8, app: str = "barloom") -> SparkSession:
    """Session for tests and the bench. A cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BARLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Only a single-machine session may do without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_dir()


@functools.cache
def _local_dir() -> str:
    made = tempfile.mkdtemp(prefix="barloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def cut_lineage(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and read it back, so later stages never recompute it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/barloom/{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a row count; a larger side keeps the shuffle join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
