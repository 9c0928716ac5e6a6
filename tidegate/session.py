"""Session settings and the shared folder every job writes intermediate tables to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the jobs rely on. All of them can be changed on a running session.
RUNTIME_CONF = {
    # epoch arithmetic and zone conversion start from UTC
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # dt partitions stay STRING when read back
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    # methods above this size are never JIT-compiled; wide decode projections are split instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # deep pages fall back to a distributed sort instead of a per-task heap
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
}


def configure(spark: SparkSession) -> SparkSession:
    for name, value in RUNTIME_CONF.items():
        spark.conf.set(name, value)
    return spark


def local_session(cpus: int | str = "*", app: str = "tidegate", **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        # call sites of every column expression are looked up otherwise
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for name, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, ``spark.checkpoint.dir``.

    Where it is unset, a session in one process gets a folder of its own; a cluster has to name one, as executors
    would each write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidegate-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
