"""Session builder and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", app: str = "spanmill", **conf: str) -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own."""
    cpus = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local-mode session may fall back to a folder of this machine.
    """
    named = spark.conf.get(SHARED_DIR_CONF, None) or spark.sparkContext.getConf().get(SHARED_DIR_CONF)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SHARED_DIR_CONF} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spanmill-")
    spark.conf.set(SHARED_DIR_CONF, folder)
    return folder


_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for one materialised table."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def drop_scratch(spark: SparkSession) -> None:
    """Delete the tables that this process has written so far; call it once no result that reads them is needed."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    while _made:
        path = hadoop.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, written once to the shared folder and read back: later plans start from the table."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
