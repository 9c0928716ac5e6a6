"""The raw change table: Kafka-shaped rows kept by topic and local event date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.functions.values import DEFAULT_ZONE, local_date_of_ms
from tidegate.sources import position

RAW_SCHEMA = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

# as it is stored: topic and event date are folders
TABLE_SCHEMA = T.StructType([*RAW_SCHEMA.fields, T.StructField("event_date", T.StringType())])


def kafka_options(
    servers: str, topics: list[str], startup: str = "latest", timestamp_ms: int | None = None,
    max_offsets_per_trigger: int | None = None,
) -> dict[str, str]:
    """Options of the Kafka source for a startup at the first, the newest or a dated record."""
    position.checked(startup, timestamp_ms)
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(topics),
        # records that aged out of the topic stop the job instead of vanishing silently
        "failOnDataLoss": "true",
    }
    if startup == "timestamp":
        options["startingTimestamp"] = str(timestamp_ms)
    else:
        options["startingOffsets"] = startup
    if max_offsets_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return options


def text_columns(kafka: DataFrame) -> DataFrame:
    """Kafka's binary key and value as text, in the bronze layout."""
    return kafka.select(
        "topic", "partition", "offset", "timestamp",
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
    )


def kafka_stream(spark: SparkSession, **options) -> DataFrame:
    return text_columns(spark.readStream.format("kafka").options(**kafka_options(**options)).load())


def kafka_batch(spark: SparkSession, servers: str, topics: list[str]) -> DataFrame:
    """Everything a topic holds now, from its first record; a fresh replay of any date."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(topics),
        "startingOffsets": "earliest",
        "endingOffsets": "latest",
    }
    return text_columns(spark.read.format("kafka").options(**options).load())


def table_stream(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None, startup: str = "earliest",
    timestamp_ms: int | None = None, checkpoint: str | None = None,
) -> DataFrame:
    """The bronze folder as a stream, for replays and where no broker is at hand.

    ``startup`` is as for Kafka: from the first record, from a dated one, or only what is recorded from now on. The
    position is settled at the first start of ``checkpoint`` and kept there: what is recorded while the stream is down
    is read when it is back.
    """
    position.checked(startup, timestamp_ms)
    if startup == "latest" and checkpoint is None:
        raise ValueError("startup 'latest' needs the checkpoint that keeps its position")
    reader = spark.readStream.schema(TABLE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    rows = reader.parquet(path).select(*RAW_SCHEMA.fieldNames())
    if checkpoint is None:
        return since(rows, timestamp_ms) if startup == "timestamp" else rows
    recorded = spark.read.schema(TABLE_SCHEMA).parquet(path)
    return position.after_start(rows, position.begun(spark, checkpoint, startup, timestamp_ms, recorded))


def with_event_date(decoded: DataFrame, zone: str = DEFAULT_ZONE) -> DataFrame:
    """Local event date as text: the partition a day job reads. NULL dates stay readable."""
    return decoded.withColumn(
        "event_date", F.coalesce(local_date_of_ms(F.col("event_ms"), zone).cast("string"), F.lit("unknown"))
    )


def append(decoded: DataFrame, path: str, zone: str = DEFAULT_ZONE) -> None:
    """Keep every raw record, also those outside any day, under its topic and event date.

    Rows are gathered by folder before the write; a folder with very many rows is split over several tasks.
    """
    raw = with_event_date(decoded, zone).select(*RAW_SCHEMA.fieldNames(), "event_date")
    raw.hint("rebalance", F.col("topic"), F.col("event_date")).write.mode("append").partitionBy("topic", "event_date").parquet(path)


def read_day(spark: SparkSession, path: str, day: str, topics: list[str] | None = None) -> DataFrame:
    """Raw records that may belong to a day in any zone.

    Folders are dated in the zone of ``append``, which may be another one: those of the neighbouring days and of
    unknown dates are read as well, and the caller's window decides.
    """
    date = dt.date.fromisoformat(day)
    days = [(date + dt.timedelta(days=n)).isoformat() for n in (-1, 0, 1)]
    table = spark.read.schema(TABLE_SCHEMA).parquet(path).where(F.col("event_date").isin(*days, "unknown"))
    if topics:
        table = table.where(F.col("topic").isin(topics))
    return table.select(*RAW_SCHEMA.fieldNames())


def since(raw: DataFrame, timestamp_ms: int) -> DataFrame:
    """Records at or after a Kafka record time."""
    return raw.where(F.col("timestamp") >= F.timestamp_millis(F.lit(timestamp_ms)))
