"""Session defaults for local runs and the shared-folder rule."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Colour formulas generate long methods. Above 8000 bytes the JVM would run them
# interpreted; this limit makes Spark compile such steps one by one instead.
CODEGEN_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")
SHARED_DIR_KEY = "spark.checkpoint.dir"


def build_session(cpus: str | int = "*", app: str = "proofline") -> SparkSession:
    """Local session; on a cluster the submitting job brings its own."""
    n = os.cpu_count() if cpus == "*" else int(cpus)
    return (SparkSession.builder.master(f"local[{cpus}]").appName(app)
            .config("spark.sql.shuffle.partitions", str(n))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .config(*CODEGEN_LIMIT)
            .config("spark.driver.memory", os.environ.get("PROOFLINE_DRIVER_MEMORY", "12g"))
            .config("spark.ui.enabled", "false")
            .config("spark.python.sql.dataFrameDebugging.enabled", "false")
            .getOrCreate())


def tune(spark: SparkSession) -> None:
    """Runtime settings the operators expect, for sessions built elsewhere."""
    if spark.conf.get(CODEGEN_LIMIT[0], "65535") == "65535":
        spark.conf.set(*CODEGEN_LIMIT)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    Only on a single machine, as in tests, an absent setting is made up for by a
    temporary folder; on a cluster its absence is an error, since each executor
    would write to its own disk.
    """
    path = spark.conf.get(SHARED_DIR_KEY, None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {SHARED_DIR_KEY} to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="proofline-")
        spark.conf.set(SHARED_DIR_KEY, path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: it is computed once, and the planner sees its real size."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def task_parallelism(spark: SparkSession) -> int:
    """Partition count for map-side row explosion: small rows that become big data.

    A fixed number keeps adaptive execution from merging the tiny input
    partitions that are about to grow a thousandfold.
    """
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
