"""Partitioned JDBC reads and writes; needs the vendor's driver on the cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tidegate.functions.values import check_identifier

# Connection URLs, default ports, kinds that share a driver, readers per copy.
URLS = {
    "mysql": "jdbc:mysql://{host}:{port}/{database}?useUnicode=true&characterEncoding=utf8",
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}",
    "oracle": "jdbc:oracle:thin:@{host}:{port}/{database}",
    "hive": "jdbc:hive2://{host}:{port}/{database}",
    "doris": "jdbc:mysql://{host}:{port}/{database}",
    "sqlserver": "jdbc:sqlserver://{host}:{port};databaseName={database}",
    "odps": "jdbc:odps:{host}",
    "oceanbase": "jdbc:oceanbase://{host}:{port}/{database}",
    "gaussdb": "jdbc:postgresql://{host}:{port}/{database}",
    "dws": "jdbc:postgresql://{host}:{port}/{database}",
    "opengauss": "jdbc:postgresql://{host}:{port}/{database}",
    "db2": "jdbc:db2://{host}:{port}/{database}",
    "clickhouse": "jdbc:clickhouse://{host}:{port}/{database}",
}
PORTS = {
    "mysql": 3306,
    "postgresql": 5432,
    "oracle": 1521,
    "hive": 10000,
    "doris": 9030,
    "sqlserver": 1433,
    "odps": 443,
    "oceanbase": 2881,
    "gaussdb": 5432,
    "dws": 8000,
    "opengauss": 5432,
    "db2": 50000,
    "clickhouse": 8123,
}
CHANNELS = 3
FETCH_ROWS = 10_000


def url(kind: str, host: str, database: str, port: int | None = None) -> str:
    if kind not in URLS:
        raise ValueError(f"no JDBC source: {kind}")
    return URLS[kind].format(host=host, port=port or PORTS[kind], database=database)


def options(
    kind: str, host: str, database: str, table: str, user: str, password: str, port: int | None = None,
    schema: str | None = None, split_column: str | None = None, bounds: tuple | None = None,
    channels: int = CHANNELS,
) -> dict[str, str]:
    """Reader options; with a split column and its bounds the read runs in ``channels`` parts.

    Rows outside the bounds are read too, by the first and the last part.
    """
    name = check_identifier(table) if schema is None else f"{check_identifier(schema)}.{check_identifier(table)}"
    result = {
        "url": url(kind, host, database, port),
        "dbtable": name,
        "user": user,
        "password": password,
        "fetchsize": str(FETCH_ROWS),
    }
    if split_column:
        if bounds is None:
            raise ValueError("a split column needs its bounds")
        result |= {
            "partitionColumn": check_identifier(split_column),
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(channels),
        }
    return result


def bounds_query(table: str, split_column: str) -> str:
    """The smallest and largest split key, asked of the database."""
    column = check_identifier(split_column)
    return f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}"


def read(
    spark: SparkSession, columns: Sequence[str] | None = None, split_column: str | None = None, **where
) -> DataFrame:
    """A table with its columns projected, split by key range where a split column is given."""
    plain = options(**where)
    if split_column:
        ask = {k: v for k, v in plain.items() if k != "dbtable"}
        query = bounds_query(plain["dbtable"], split_column)
        row = spark.read.format("jdbc").options(**ask, query=query).load().first()
        if row["lo"] is not None:
            plain = options(**where, split_column=split_column, bounds=(row["lo"], row["hi"]))
    table = spark.read.format("jdbc").options(**plain).load()
    return table.select(*columns) if columns else table


def write(df: DataFrame, truncate: bool = True, **where) -> None:
    """Full load empties the table and keeps its definition; otherwise rows are appended."""
    writer = df.write.format("jdbc").options(**options(**where))
    if truncate:
        writer.mode("overwrite").option("truncate", "true").save()
    else:
        writer.mode("append").save()
