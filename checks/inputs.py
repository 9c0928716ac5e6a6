"""Inputs derived from the driver tables: perturbed copies, change logs, catalogs, SQL texts.

Every input is built twice, as a DataFrame and as the text of SQL common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.session import configure


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf}/{name}.parquet")


# --------------------------------------------------------------------- reconcile

def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the price as an exact decimal."""
    return table(spark, sf, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(15,2)"))


def orders_target(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with injected defects: rows missing, changed, emptied and added."""
    source = orders(spark, sf)
    status, priority, price = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice")
    kept = (
        source.where(~((status == "P") & (priority == "1-URGENT") & (price < 50000)))
        .withColumn(
            "o_totalprice",
            F.when((status == "F") & (priority == "5-LOW") & (price > 450000), price + 1)
            .otherwise(price)
            .cast("decimal(15,2)"),
        )
        .withColumn("o_orderpriority", F.when(~((status == "O") & (priority == "2-HIGH")), priority))
    )
    extra = source.where(price > 495000).withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    return kept.unionByName(extra)


ORDERS_SQL = """
src AS (SELECT * REPLACE (CAST(o_totalprice AS DECIMAL(15,2)) AS o_totalprice) FROM orders),
tgt AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' AND o_totalprice > 450000
              THEN CAST(o_totalprice + 1 AS DECIMAL(15,2)) ELSE o_totalprice END AS o_totalprice,
         o_orderdate,
         CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' THEN NULL ELSE o_orderpriority END
           AS o_orderpriority
  FROM src WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND o_totalprice < 50000)
  UNION ALL
  SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM src WHERE o_totalprice > 495000)
"""

# ------------------------------------------------------------------- change log


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their number ``k`` taken out of the properties and UTC instants."""
    return table(spark, sf, "events").select(
        "event_id",
        "user_id",
        "event_type",
        F.col("value").cast("decimal(10,2)").cast("string").alias("amount"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


EVENTS_SQL = """
ev AS (
  SELECT event_id, user_id, event_type, CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR) AS amount, ts,
         CAST(props->>'k' AS INTEGER) AS k, epoch_us(ts) // 1000 AS ms
  FROM events)
"""

TOPIC = "shop.public.accounts"


def _json(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def price_text(k: Column, amount: Column) -> Column:
    """JSON of a price cell: mostly a numeric text, for some ``k`` something else."""
    return (
        F.when(k == 31, '"-1.5"').when(k == 32, '"1e3"').when(k == 33, '" 3"').when(k == 34, "null")
        .when(k == 35, '"1.005"').otherwise(_json('"', amount, '"'))
    )


def debezium_log(spark: SparkSession, sf: str, truncates: bool = False, partial: bool = False) -> DataFrame:
    """Events as Debezium messages in Kafka shape; ``k`` decides which irregularity a message has.

    Offset = event id, key = user. 13 malformed, 14 an array, 15 empty, 16 no after image,
    17 an empty one, 18 an unknown op, 19 none, 20 only a source time, 21 no time at all,
    22 a delete without key and row. Below 50 the envelope is wrapped in a payload.
    """
    k, user, kind, ts = F.col("k"), F.col("user_id"), F.col("event_type"), F.col("ts")
    ms = F.unix_millis(ts)
    op = (
        F.when(k == 18, "x").when(k == 19, F.lit(None))
        .when((kind == "error") & (k == 99) & F.lit(truncates), "t")
        .when(kind == "signup", "c").when(kind == "view", "r").when(kind == "error", "d").otherwise("u")
    )
    whole = _json(
        '{"id":', user, ',"event":"', kind, '","price":', price_text(k, F.col("amount")), ',"k":', k,
        ',"vip":', (k >= 50), ',"tags":{"k":', k, '},"seen_at":"', iso(ts), '"}',
    )
    image = whole
    if partial:
        image = (
            F.when(kind == "click", _json('{"id":', user, ',"price":"', F.col("amount"), '"}'))
            .when((kind == "purchase") & (k < 30), _json('{"id":', user, ',"event":null,"k":', k, "}"))
            .otherwise(whole)
        )
    has_image = op.isin("c", "r", "u", "x")
    after = F.when(k == 16, "null").when(k == 17, "{}").when(has_image | op.isNull(), image).otherwise("null")
    before = F.when((op == "d") & (k != 22), _json('{"id":', user, ',"price":"0"}')).otherwise("null")
    times = (
        F.when(k == 20, _json('"ts_ms":0,"source":{"ts_ms":', ms - 1000, "}"))
        .when(k == 21, '"source":{}')
        .otherwise(_json('"ts_ms":', ms, ',"source":{"ts_ms":', ms - 5, "}"))
    )
    op_part = F.when(op.isNull(), "").otherwise(_json('"op":"', op, '",'))
    body = _json("{", op_part, '"before":', before, ',"after":', after, ",", times, "}")
    value = (
        F.when(k == 13, "{bad").when(k == 14, "[1]").when(k == 15, F.lit(None).cast("string"))
        .when(k < 50, _json('{"schema":{},"payload":', body, "}")).otherwise(body)
    )
    # every other error names its key only in the row image
    key = F.when((k == 22) | ((kind == "error") & (k < 25)), F.lit(None).cast("string")).otherwise(
        _json('{"payload":{"id":', user, "}}")
    )
    # spread by key, as the partitions of a topic are
    return events(spark, sf).select(
        F.lit(TOPIC).alias("topic"),
        F.pmod(user, F.lit(8)).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.timestamp_millis(ms + 2000).alias("timestamp"),
        key.alias("key"),
        value.alias("value"),
    )


def log_sql(truncates: bool = False) -> str:
    """Decoded truth of the change log, straight from the events."""
    truncate = "WHEN event_type = 'error' AND k = 99 THEN 't'" if truncates else ""
    return EVENTS_SQL + f""",
dec AS (
  SELECT *, k NOT IN (13, 14, 15) AS readable,
    CASE WHEN k IN (13, 14, 15) THEN NULL WHEN k = 18 THEN 'x' WHEN k = 19 THEN NULL {truncate}
         WHEN event_type = 'signup' THEN 'c' WHEN event_type = 'view' THEN 'r'
         WHEN event_type = 'error' THEN 'd' ELSE 'u' END AS op,
    CASE WHEN k IN (13, 14, 15, 21) THEN ms + 2000 WHEN k = 20 THEN ms - 1000 ELSE ms END AS event_ms
  FROM ev),
act AS (
  SELECT *, CASE WHEN NOT readable THEN 'bad_message'
    WHEN op IN ('c', 'r', 'u') THEN CASE WHEN k IN (16, 17) THEN 'no_after' ELSE 'upsert' END
    WHEN op = 'd' THEN CASE WHEN k = 22 THEN 'bad_message' ELSE 'delete' END
    WHEN op = 't' THEN 'truncate' ELSE 'unknown_op' END AS action
  FROM dec),
guarded AS (
  SELECT *, CASE WHEN k = 31 THEN '-1.5' WHEN k = 32 THEN '1e3' WHEN k = 33 THEN ' 3' WHEN k = 34 THEN NULL
                 WHEN k = 35 THEN '1.005' ELSE amount END AS price,
    CASE WHEN action = 'upsert' AND k IN (31, 32, 33, 34) THEN 'rejected' ELSE action END AS applied
  FROM act)
"""


def canal_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as Canal messages of two rows each; small purchases move the first row's key."""
    k, user, kind = F.col("k"), F.col("user_id"), F.col("event_type")
    change = F.when(kind == "signup", "INSERT").when(kind == "error", "DELETE").otherwise("UPDATE")
    data = _json(
        '[{"id":"', user, '","name":"', kind, '","age":"', k, '"},{"id":"', user + 1_000_000, '","name":null,"age":"',
        F.when(k == 40, "old").otherwise(k.cast("string")), '"}]',
    )
    old = (
        F.when(change != "UPDATE", "null")
        .when((kind == "purchase") & (k < 10), _json('[{"id":"', user + 2_000_000, '"},{"age":"0"}]'))
        .otherwise('[{"name":"x"},{"age":"0"}]')
    )
    value = F.when(k == 13, "{bad").otherwise(
        _json('{"data":', data, ',"old":', old, ',"type":"', change, '","es":', F.unix_millis("ts"), "}")
    )
    return events(spark, sf).select(
        F.lit(TOPIC).alias("topic"),
        F.pmod(user, F.lit(8)).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").alias("timestamp"),
        F.lit(None).cast("string").alias("key"),
        value.alias("value"),
    )


CANAL_SQL = EVENTS_SQL + """,
chg AS (
  SELECT *, CASE WHEN event_type = 'signup' THEN 'INSERT' WHEN event_type = 'error' THEN 'DELETE'
                 ELSE 'UPDATE' END AS type FROM ev WHERE k <> 13),
cells AS (
  SELECT event_id, 1 AS position, CASE WHEN type = 'DELETE' THEN 'delete' ELSE 'upsert' END AS action,
         user_id AS id, event_type AS name, CAST(k AS VARCHAR) AS age FROM chg
  UNION ALL
  SELECT event_id, 3, CASE WHEN type = 'DELETE' THEN 'delete' ELSE 'upsert' END,
         user_id + 1000000, NULL, CASE WHEN k = 40 THEN 'old' ELSE CAST(k AS VARCHAR) END FROM chg
  UNION ALL
  SELECT event_id, 0, 'delete', user_id + 2000000, NULL, NULL FROM chg WHERE event_type = 'purchase' AND k < 10)
"""

# --------------------------------------------------------------------- requests


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Events as logged requests; ``k`` gives path and status."""
    k, kind = F.col("k"), F.col("event_type")
    return events(spark, sf).select(
        "event_id",
        F.when(kind == "purchase", "POST").when(kind == "error", "DELETE").otherwise("GET").alias("method"),
        F.when((kind == "view") & (k < 10), _json("/static/app", k, ".js"))
        .when((kind == "view") & (k < 15), _json("/img/", k, ".png"))
        .when((kind == "view") & (k < 20), _json("/api/report", k, ".css"))
        .when(kind == "signup", "/admin/users")
        .otherwise(_json("/api/k/", k))
        .alias("path"),
        F.when(k == 50, F.lit(None)).when(k < 70, 200).when(k < 85, 302).when(k < 95, 404).otherwise(500)
        .cast("int").alias("status_code"),
        (F.col("amount").cast("decimal(10,2)") * 10).cast("int").alias("duration_ms"),
        _json("user", F.col("user_id")).alias("username"),
        F.col("ts").alias("created_at"),
    )


REQUESTS_SQL = EVENTS_SQL + """,
req AS (
  SELECT event_id,
    CASE WHEN event_type = 'purchase' THEN 'POST' WHEN event_type = 'error' THEN 'DELETE' ELSE 'GET' END AS method,
    CASE WHEN event_type = 'view' AND k < 10 THEN '/static/app' || k || '.js'
         WHEN event_type = 'view' AND k < 15 THEN '/img/' || k || '.png'
         WHEN event_type = 'view' AND k < 20 THEN '/api/report' || k || '.css'
         WHEN event_type = 'signup' THEN '/admin/users' ELSE '/api/k/' || k END AS path,
    CASE WHEN k = 50 THEN NULL WHEN k < 70 THEN 200 WHEN k < 85 THEN 302 WHEN k < 95 THEN 404 ELSE 500 END
      AS status_code,
    CAST(trunc(CAST(amount AS DECIMAL(10,2)) * 10) AS INTEGER) AS duration_ms,
    'user' || user_id AS username, ts AS created_at
  FROM ev)
"""

# ---------------------------------------------------------------------- catalog

# data_type, column_type, length, precision, scale, then the types they map to: store, Hive,
# change stream read and write.
MYSQL_TYPES = [
    ("tinyint", "tinyint(1)", None, 3, 0, "BOOLEAN", "BOOLEAN", "BOOLEAN", "BOOLEAN"),
    ("tinyint", "tinyint(4)", None, 3, 0, "TINYINT", "TINYINT", "TINYINT", "TINYINT"),
    ("smallint", "smallint(6)", None, 5, 0, "SMALLINT", "SMALLINT", "SMALLINT", "SMALLINT"),
    ("mediumint", "mediumint(9)", None, 7, 0, "INT", "INT", "INT", "INT"),
    ("int", "int(11)", None, 10, 0, "INT", "INT", "INT", "INT"),
    ("bigint", "bigint(20)", None, 19, 0, "BIGINT", "BIGINT", "BIGINT", "BIGINT"),
    ("float", "float", None, 12, None, "FLOAT", "FLOAT", "FLOAT", "FLOAT"),
    ("double", "double", None, 22, None, "DOUBLE", "DOUBLE", "DOUBLE", "DOUBLE"),
    ("decimal", "decimal(12,2)", None, 12, 2, "DECIMAL(12,2)", "DECIMAL(12,2)", "DECIMAL(12, 2)", "DECIMAL(12, 2)"),
    ("numeric", "numeric", None, None, None, "DECIMAL(10,0)", "DECIMAL(10,0)", "DECIMAL(10, 0)", "DECIMAL(10, 0)"),
    ("char", "char(8)", 8, None, None, "CHAR(8)", "STRING", "STRING", "STRING"),
    ("varchar", "varchar(255)", 255, None, None, "VARCHAR(255)", "STRING", "STRING", "STRING"),
    ("varchar", "varchar", None, None, None, "VARCHAR(255)", "STRING", "STRING", "STRING"),
    ("longtext", "longtext", None, None, None, "STRING", "STRING", "STRING", "STRING"),
    ("date", "date", None, None, None, "DATE", "DATE", "DATE", "DATE"),
    ("datetime", "datetime(3)", None, None, None, "DATETIME(3)", "TIMESTAMP", "STRING", "STRING"),
    ("timestamp", "timestamp", None, None, None, "DATETIME", "TIMESTAMP", "STRING", "STRING"),
    ("time", "time", None, None, None, "STRING", "STRING", "STRING", "STRING"),
    ("json", "json", None, None, None, "JSON", "STRING", "STRING", "STRING"),
    ("blob", "blob", 65535, None, None, "STRING", "BINARY", "STRING", "STRING"),
    ("enum", "enum('a','b')", 1, None, None, "STRING", "STRING", "STRING", "STRING"),
    ("tinyint", "tinyint(1) unsigned", None, 3, 0, "BOOLEAN", "BOOLEAN", "BOOLEAN", "BOOLEAN"),
]
POSTGRESQL_TYPES = [
    ("smallint", "int2", None, 16, 0, "SMALLINT", "SMALLINT", "SMALLINT", "SMALLINT"),
    ("integer", "int4", None, 32, 0, "INT", "INT", "INT", "INT"),
    ("bigint", "int8", None, 64, 0, "BIGINT", "BIGINT", "BIGINT", "BIGINT"),
    ("boolean", "bool", None, None, None, "BOOLEAN", "BOOLEAN", "BOOLEAN", "BOOLEAN"),
    ("numeric", "numeric", None, 10, 2, "DECIMAL(10,2)", "DECIMAL(10,2)", "STRING", "DECIMAL(10, 2)"),
    ("numeric", "numeric", None, None, None, "STRING", "STRING", "STRING", "DECIMAL(10, 2)"),
    ("numeric", "numeric", None, 50, 4, "DECIMAL(38,4)", "DECIMAL(50,4)", "STRING", "DECIMAL(50, 4)"),
    ("numeric", "numeric", None, 12, 0, "DECIMAL(12,0)", "DECIMAL(12,0)", "STRING", "DECIMAL(12, 0)"),
    ("real", "float4", None, 24, None, "FLOAT", "FLOAT", "STRING", "STRING"),
    ("double precision", "float8", None, 53, None, "DOUBLE", "DOUBLE", "STRING", "STRING"),
    ("character varying", "varchar", 100, None, None, "VARCHAR(100)", "STRING", "STRING", "STRING"),
    ("character varying", "varchar", 70000, None, None, "STRING", "STRING", "STRING", "STRING"),
    ("character varying", "varchar", None, None, None, "STRING", "STRING", "STRING", "STRING"),
    ("character", "bpchar", 4, None, None, "CHAR(4)", "STRING", "STRING", "STRING"),
    ("date", "date", None, None, None, "DATE", "DATE", "DATE", "DATE"),
    ("timestamp with time zone", "timestamptz", None, None, None, "DATETIME", "TIMESTAMP", "TIMESTAMP_LTZ(6)", "STRING"),
    ("timestamp without time zone", "timestamp", None, None, None, "DATETIME", "TIMESTAMP", "TIMESTAMP_LTZ(6)", "STRING"),
    ("jsonb", "jsonb", None, None, None, "JSON", "STRING", "STRING", "STRING"),
    ("uuid", "uuid", None, None, None, "STRING", "STRING", "STRING", "STRING"),
]
ORACLE_TYPES = [
    ("number", "NUMBER(10,2)", None, 10, 2, "DECIMAL(10,2)", "DECIMAL(10,2)", "", ""),
    ("number", "NUMBER", None, None, None, "DOUBLE", "DOUBLE", "", ""),
    ("number", "NUMBER", None, 12, 0, "DOUBLE", "DOUBLE", "", ""),
    ("number", "", None, 12, 3, "DECIMAL(12,3)", "DECIMAL(12,3)", "", ""),
    ("varchar2", "VARCHAR2(100)", 100, None, None, "VARCHAR(100)", "STRING", "", ""),
    ("nvarchar2", "NVARCHAR2", None, None, None, "STRING", "STRING", "", ""),
    ("char", "CHAR(2)", 2, None, None, "CHAR(2)", "STRING", "", ""),
    ("nchar", "NCHAR", None, None, None, "CHAR(1)", "STRING", "", ""),
    ("date", "DATE", None, None, None, "DATE", "DATE", "", ""),
    ("timestamp", "TIMESTAMP(6)", None, None, None, "DATETIME", "TIMESTAMP", "", ""),
    ("float", "FLOAT", None, 126, None, "DOUBLE", "DOUBLE", "", ""),
    ("binary_float", "BINARY_FLOAT", None, None, None, "FLOAT", "FLOAT", "", ""),
    ("binary_double", "BINARY_DOUBLE", None, None, None, "DOUBLE", "DOUBLE", "", ""),
    ("clob", "CLOB", None, None, None, "STRING", "STRING", "", ""),
]
TYPES = {"mysql": MYSQL_TYPES, "postgresql": POSTGRESQL_TYPES, "oracle": ORACLE_TYPES}
# declared default, its kind, its value
DEFAULTS = [
    (None, "none", None),
    ("NULL", "null", None),
    ("CURRENT_TIMESTAMP(3)", "now", None),
    ("0", "number", "0"),
    ("-1.5e3", "number", "-1.5e3"),
    ("uuid()", "expression", None),
    (" new ", "text", "new"),
]
_FIELDS = ("data_type", "column_type", "max_length", "numeric_precision", "numeric_scale",
           "store", "hive", "stream_read", "stream_write")
_INTS = ("max_length", "numeric_precision", "numeric_scale")


def pick(rows: list[tuple], index: int, at: Column, cast: str = "string") -> Column:
    """Field ``index`` of the listed row that ``at`` (from 0) chooses."""
    return F.element_at(F.array(*[F.lit(r[index]).cast(cast) for r in rows]), (at + 1).cast("int"))


def pick_sql(rows: list[tuple], index: int, at: str, cast: str = "VARCHAR") -> str:
    texts = ["NULL" if r[index] is None else "'" + str(r[index]).replace("'", "''") + "'" for r in rows]
    return f"CAST(list_extract([{', '.join(texts)}], CAST({at} AS INTEGER) + 1) AS {cast})"


def columns(spark: SparkSession, sf: str, source_type: str = "mysql", extra: tuple[str, ...] = (), schemas: int = 1) -> DataFrame:
    """A column catalog from the parts: 16 columns per table, 64 tables per database, each name in one or two schemas."""
    rows = TYPES[source_type]
    key = F.col("p_partkey")
    block = F.floor(key / 16)
    at = F.pmod(key + F.col("p_size"), F.lit(len(rows)))
    shown = _FIELDS[:5] + extra
    return table(spark, sf, "part").select(
        F.concat(F.lit("db_"), F.floor(key / 1024)).alias("database"),
        F.when(block % schemas == 0, "public").otherwise("audit").alias("schema_name"),
        F.concat(F.lit("t_"), F.floor(block / schemas)).alias("table_name"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), key).alias("name"),
        (F.pmod(key, F.lit(16)) + 1).cast("int").alias("ordinal_position"),
        *[pick(rows, _FIELDS.index(f), at, "int" if f in _INTS else "string").alias(f) for f in shown],
        pick(DEFAULTS, 0, F.pmod(F.col("p_size"), F.lit(len(DEFAULTS)))).alias("column_default"),
        (F.col("p_size") > 10).alias("is_nullable"),
        F.concat("p_brand", F.lit(" "), F.lower("p_type")).alias("comment"),
    )


def columns_sql(name: str = "cols", source_type: str = "mysql", schemas: int = 1) -> str:
    rows = TYPES[source_type]
    at = f"((p_partkey + p_size) % {len(rows)})"
    fields = ",\n    ".join(
        pick_sql(rows, i, at, "INTEGER" if f in _INTS else "VARCHAR") + f" AS {f}" for i, f in enumerate(_FIELDS)
    )
    default = pick_sql(DEFAULTS, 0, f"(p_size % {len(DEFAULTS)})")
    return f"""
{name} AS (
  SELECT 'db_' || (p_partkey // 1024) AS database,
    CASE WHEN p_partkey // 16 % {schemas} = 0 THEN 'public' ELSE 'audit' END AS schema_name,
    't_' || (p_partkey // {16 * schemas}) AS table_name,
    replace(p_name, ' ', '_') || '_' || p_partkey AS name, CAST(p_partkey % 16 + 1 AS INTEGER) AS ordinal_position,
    {fields},
    {default} AS column_default, p_size > 10 AS is_nullable, p_brand || ' ' || lower(p_type) AS comment,
    p_partkey, p_size, p_brand
  FROM part)
"""


def target_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The store's catalog after a sync of ``columns``, with defects by brand and table."""
    source = columns(spark, sf, extra=("store",), schemas=2).withColumn("brand", F.substring_index("comment", " ", 1))
    block = F.substring_index("table_name", "_", -1).cast("bigint") * 2 + (F.col("schema_name") == "audit").cast("int")
    brand = F.col("brand")
    kept = source.where((brand != "Brand#5") & (F.pmod(block, F.lit(10)) != 3)).select(
        "database", "schema_name", "table_name", "name", "ordinal_position",
        F.col("data_type"),
        F.when(brand == "Brand#3", "STRING").otherwise(F.lower("store")).alias("column_type"),
        F.when(brand == "Brand#7", ~F.col("is_nullable")).otherwise(F.col("is_nullable")).alias("is_nullable"),
        "column_default", "comment",
    )
    extra = kept.where(F.col("comment").startswith("Brand#9 ")).withColumn("name", F.concat("name", F.lit("_old")))
    return kept.unionByName(extra)


TARGET_COLUMNS_SQL = """
kept AS (
  SELECT database, schema_name, table_name, name, ordinal_position, data_type,
    CASE WHEN p_brand = 'Brand#3' THEN 'STRING' ELSE lower(store) END AS column_type,
    CASE WHEN p_brand = 'Brand#7' THEN NOT is_nullable ELSE is_nullable END AS is_nullable, p_brand
  FROM cols WHERE p_brand <> 'Brand#5' AND (p_partkey // 16) % 10 <> 3),
tcols AS (
  SELECT * FROM kept
  UNION ALL
  SELECT * REPLACE (name || '_old' AS name) FROM kept WHERE p_brand = 'Brand#9'),
matched AS (
  SELECT coalesce(s.database, t.database) AS database, coalesce(s.schema_name, t.schema_name) AS schema_name,
    coalesce(s.table_name, t.table_name) AS table_name, coalesce(s.name, t.name) AS name,
    s.name IS NOT NULL AS in_source, t.name IS NOT NULL AS in_target,
    s.column_type AS source_type, t.column_type AS target_type, s.store,
    s.name IS NOT NULL AND t.name IS NOT NULL AND lower(s.store) <> lower(t.column_type) AS type_differs,
    s.name IS NOT NULL AND t.name IS NOT NULL AND s.is_nullable <> t.is_nullable AS nullable_differs,
    s.ordinal_position AS source_position, t.ordinal_position AS target_position
  FROM cols s FULL OUTER JOIN tcols t
    ON s.database = t.database AND s.schema_name = t.schema_name AND s.table_name = t.table_name AND s.name = t.name)
"""


def tables(spark: SparkSession, sf: str) -> DataFrame:
    """The tables of the column catalog."""
    return columns(spark, sf).groupBy("database", "schema_name", "table_name").agg(
        F.min("name").alias("first_name")
    ).select(
        "database", "schema_name", "table_name", F.lit("BASE TABLE").alias("table_type"),
        F.concat(F.lit("holds "), "first_name").alias("comment"),
    )


TABLES_SQL = """
tabs AS (
  SELECT database, schema_name, table_name, 'BASE TABLE' AS table_type, 'holds ' || min(name) AS comment
  FROM cols GROUP BY ALL)
"""


def databases(spark: SparkSession, sf: str) -> DataFrame:
    """The databases of the catalog and one per supplier that holds no table yet."""
    used = table(spark, sf, "part").select(F.concat(F.lit("db_"), F.floor(F.col("p_partkey") / 1024)).alias("database"))
    unused = table(spark, sf, "supplier").select(F.concat(F.lit("new_"), "s_suppkey").alias("database"))
    return used.union(unused).distinct().select(
        "database", F.lit("mysql").alias("db_type"), F.upper("database").alias("database_name")
    )


DATABASES_SQL = """
dbs AS (
  SELECT database, 'mysql' AS db_type, upper(database) AS database_name FROM (
    SELECT 'db_' || (p_partkey // 1024) AS database FROM part UNION SELECT 'new_' || s_suppkey FROM supplier))
"""

# ------------------------------------------------------------------- SQL corpus


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """One SQL file per customer: an INSERT with joins, a CTAS, a plain SELECT, quoted semicolons."""
    key, segment = F.col("c_custkey"), F.lower("c_mktsegment")
    nation = F.col("c_nationkey")
    sql = F.concat(
        F.lit("-- load; daily\nINSERT INTO dwd."), segment, F.lit("_"), nation, F.lit("\nSELECT a.id, ';x' AS c FROM ods.raw_"),
        key, F.lit(" a JOIN `dim`.`nation_"), nation, F.lit("` b ON a.k = b.k\nWHERE a.d > '2024;01' AND a.x IN (SELECT x FROM hidden.t);\n"),
        F.lit("CREATE TABLE IF NOT EXISTS dws."), segment, F.lit(" AS SELECT * FROM dwd."), segment, F.lit("_"), nation,
        F.lit(" left join dual on 1 = 1 join ods.raw_"), key, F.lit(" x on true GROUP BY 1;\nSELECT * FROM ods.nothing LIMIT 10"),
    )
    # few bytes a customer, much work on its texts: spread over tasks before these are made
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey").repartition("c_custkey")
    return customers.select(F.concat(F.lit("jobs/"), key, F.lit(".sql")).alias("path"), sql.alias("sql"))


CORPUS_SQL = """
cust AS (SELECT c_custkey AS k, lower(c_mktsegment) AS s, c_nationkey AS n, 'jobs/' || c_custkey || '.sql' AS sql_file
         FROM customer),
edge AS (
  SELECT 'ods.raw_' || k AS source_table, 'dwd.' || s || '_' || n AS target_table, sql_file FROM cust
  UNION SELECT 'dim.nation_' || n, 'dwd.' || s || '_' || n, sql_file FROM cust
  UNION SELECT 'dwd.' || s || '_' || n, 'dws.' || s, sql_file FROM cust
  UNION SELECT 'ods.raw_' || k, 'dws.' || s, sql_file FROM cust)
"""
