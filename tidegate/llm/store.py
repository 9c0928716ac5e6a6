"""Tables that jobs of one operator hand to each other."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidegate.session import scratch_path


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, and a lost executor takes nothing along."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(df: DataFrame, rows: int, per_partition: int) -> int:
    """As many partitions as ``rows`` need, at least those of the session."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))


@contextmanager
def records_at_once(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs that run meanwhile send at most so many rows to a Python worker at once; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= most:
        spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def importable(spark: SparkSession) -> SparkSession:
    """Python workers find this package where the driver does, should it not be installed on them."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")
    return spark
