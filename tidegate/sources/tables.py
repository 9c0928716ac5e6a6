"""Loads into file tables: whole, appended, by day; retention of day partitions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions.values import check_identifier

# Days kept around today and the partition column.
KEEP_BACK, KEEP_AHEAD = 7, 3
DAY = "dt"


def load(df: DataFrame, path: str, truncate: bool = True) -> None:
    """Full load replaces the table's rows, otherwise they are appended."""
    df.write.mode("overwrite" if truncate else "append").parquet(path)


def write_days(df: DataFrame, path: str) -> None:
    """ORC by ``dt``: the days in ``df`` are replaced, all others stay.

    Rows are gathered by day before the write, so a day gets a few files instead of one from
    every task; the rebalance splits a day with very many rows over several tasks.
    """
    (
        df.hint("rebalance", F.col(DAY))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DAY)
        .orc(path)
    )


def load_day(df: DataFrame, path: str, day: str) -> None:
    """Reload one day: its folder is replaced as a whole, also by no rows."""
    dt.date.fromisoformat(day)
    (
        df.drop(DAY)
        .hint("rebalance")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .orc(f"{path.rstrip('/')}/{DAY}={day}")
    )


def read_days(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    table = spark.read.orc(path).withColumn(DAY, F.col(DAY).cast("string"))
    return table if day is None else table.where(F.col(DAY) == day)


def create_day_table(spark: SparkSession, name: str, df: DataFrame, path: str) -> None:
    """An external ORC table over a day-partitioned folder."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != DAY)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {check_identifier(name)} ({columns}, {DAY} STRING) "
        f"USING ORC PARTITIONED BY ({DAY}) LOCATION '{path}'"
    )


def retention(
    days: DataFrame, today: str, keep_back: int = KEEP_BACK, keep_ahead: int = KEEP_AHEAD
) -> DataFrame:
    """Each day partition with its verdict: kept from ``today - keep_back`` on, dropped before.

    ``prepared`` marks the days of the window itself, up to ``today + keep_ahead``.
    """
    base = dt.date.fromisoformat(today)
    lower = (base - dt.timedelta(days=keep_back)).isoformat()
    upper = (base + dt.timedelta(days=keep_ahead)).isoformat()
    return days.select(
        DAY,
        F.when(F.col(DAY) < lower, "drop").otherwise("keep").alias("verdict"),
        F.col(DAY).between(lower, upper).alias("prepared"),
    )


def drop_old_days(spark: SparkSession, table: str, today: str, keep_back: int = KEEP_BACK) -> list[str]:
    """Drop day partitions below the bound, and their files, which an external table keeps otherwise.

    The partition list is the catalog's, not the data's.
    """
    check_identifier(table)
    lower = (dt.date.fromisoformat(today) - dt.timedelta(days=keep_back)).isoformat()
    listed = [r[0].split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    old = sorted(d for d in listed if d < lower)
    for day in old:
        where = spark.sql(f"DESCRIBE FORMATTED {table} PARTITION ({DAY}='{day}')").where("col_name = 'Location'")
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where.first()["data_type"])
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({DAY}='{day}')")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return old


def transform(spark: SparkSession, sql: str, day: str, **tables: DataFrame) -> DataFrame:
    """A warehouse statement with its day as the parameter ``:dt`` and its tables in braces."""
    dt.date.fromisoformat(day)
    return spark.sql(sql, args={DAY: day}, **tables)
