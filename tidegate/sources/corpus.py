"""SQL files as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Endings of SQL files.
ENDINGS = ["sql", "hql", "ddl"]


def read(spark: SparkSession, folder: str, endings: Sequence[str] = ENDINGS) -> DataFrame:
    """``path`` relative to the folder and the whole text of every SQL file below it."""
    texts = (
        spark.read.option("wholetext", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{" + ",".join(e + "," + e.upper() for e in endings) + "}")
        .text(folder)
        .select(F.col("_metadata.file_path").alias("full"), F.col("value").alias("sql"))
    )
    root = folder.rstrip("/") + "/"
    return texts.select(F.substring_index("full", root, -1).alias("path"), "sql")
