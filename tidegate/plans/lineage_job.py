"""Lineage of a folder of SQL files, kept in an edge table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tidegate.operators import lineage
from tidegate.sources import corpus

EDGES = "source_table string, target_table string, sql_file string"


def stored(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(EDGES).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], EDGES)


def run(spark: SparkSession, folder: str, path: str, extended: bool = False) -> DataFrame:
    """Add the edges the table does not hold yet and return all of them."""
    found = lineage.extract(corpus.read(spark, folder), extended)
    lineage.edges(found, stored(spark, path)).write.mode("append").parquet(path)
    return stored(spark, path)
