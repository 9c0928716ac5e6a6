"""Where a stream began and what it is called: written once, inside its checkpoint.

A checkpoint keeps how far a stream has read of its files, not which records it was to start from, and it numbers its
batches from 0 as any other does. Both are settled at the first start: a restart reads the record and takes neither the
clock nor its own arguments for it. Removing the checkpoint removes the record along with it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STARTUP_MODES = ("earliest", "latest", "timestamp")
FIELDS = "stream string, startup string, timestamp_ms bigint, topic string, partition int, offset bigint"


@dataclass(frozen=True)
class Start:
    stream: str
    startup: str
    timestamp_ms: int | None
    rows: DataFrame

    def positions(self) -> DataFrame:
        """Last record of each partition that the stream leaves out."""
        return self.rows.where(F.col("topic").isNotNull()).select("topic", "partition", F.col("offset").alias("_left_out"))


def checked(startup: str, timestamp_ms: int | None) -> None:
    if startup not in STARTUP_MODES:
        raise ValueError(f"unknown startup mode: {startup}")
    if startup == "timestamp" and timestamp_ms is None:
        raise ValueError("startup 'timestamp' needs timestamp_ms")


def _written(spark: SparkSession, path: str) -> Start | None:
    try:
        rows = spark.read.schema(FIELDS).parquet(path)
        first = rows.first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if first is None else Start(first.stream, first.startup, first.timestamp_ms, rows)


def begun(
    spark: SparkSession, checkpoint: str, startup: str = "earliest", timestamp_ms: int | None = None,
    recorded: DataFrame | None = None,
) -> Start:
    """The start of this checkpoint's stream; settled now if this is the first.

    ``recorded`` holds the records there are; a start at the latest one leaves out all of them.
    """
    path = f"{checkpoint.rstrip('/')}/start"
    known = _written(spark, path)
    if known is not None:
        return known
    checked(startup, timestamp_ms)
    same = {"stream": F.lit(uuid.uuid4().hex), "startup": F.lit(startup), "timestamp_ms": F.lit(timestamp_ms).cast("bigint")}
    rows = spark.createDataFrame([(None, None, None)], "topic string, partition int, offset bigint")
    if startup == "latest" and recorded is not None:
        rows = rows.union(recorded.groupBy("topic", "partition").agg(F.max("offset").alias("offset")))
    # one file: all of the record or none of it
    rows.withColumns(same).coalesce(1).write.mode("overwrite").parquet(path)
    return _written(spark, path)


def after_start(rows: DataFrame, start: Start) -> DataFrame:
    """Records from the start on."""
    if start.startup == "earliest":
        return rows
    if start.startup == "timestamp":
        return rows.where(F.col("timestamp") >= F.timestamp_millis(F.lit(start.timestamp_ms)))
    placed = rows.join(start.positions(), ["topic", "partition"], "left")
    return placed.where(F.col("_left_out").isNull() | (F.col("offset") > F.col("_left_out"))).select(*rows.columns)
