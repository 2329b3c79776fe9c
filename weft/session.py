"""Session helpers."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "weft", cpus: str = "*") -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """Shared folder for intermediates, as the cluster names it.

    A folder of our own is made only for a local master that names none.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="weft-checkpoint-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes inside free the disk that they took for their shuffles at their end, not when the driver collects its garbage."""
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def cut_lineage(df: DataFrame, name: str = "table", drop_shuffles: bool = False) -> DataFrame:
    """Write a result to the shared folder and read it back.

    The files outlive the executors that made them, and later readers scan only
    the columns they need.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/weft/{name}-{uuid.uuid4().hex}"
    with dropped_shuffles(spark) if drop_shuffles else contextlib.nullcontext():
        df.write.parquet(path)
    return spark.read.parquet(path)


def fetched(df: DataFrame, name: str = "table") -> pa.Table:
    """A small result in the driver; neither its shuffles nor a table of it stay on disk."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_folder(spark)}/weft/{name}-{uuid.uuid4().hex}")
    try:
        with dropped_shuffles(spark):
            df.write.parquet(path.toString())
        return spark.read.parquet(path.toString()).toArrow()
    finally:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_memory() -> None:
    """Give freed memory back, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def default_salts(spark: SparkSession, most: int = 256) -> int:
    """Salt count that spreads one hot key over the cluster's shuffle tasks."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), most))
