"""Structure and type queries over a column catalog."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import inputs as i
from checks.registry import query
from tidegate.functions import typemap, typetext
from tidegate.operators import schema

BOTH = "WITH " + i.columns_sql(schemas=2) + "," + i.TARGET_COLUMNS_SQL


@query("schema_diff", BOTH + """
SELECT database, schema_name, table_name, name, 'difference' AS level, 'missing_in_target' AS change, source_type, target_type
FROM matched WHERE NOT in_target
UNION ALL SELECT database, schema_name, table_name, name, 'difference', 'extra_in_target', source_type, target_type FROM matched WHERE NOT in_source
UNION ALL SELECT database, schema_name, table_name, name, 'difference', 'type_mismatch', source_type, target_type FROM matched WHERE type_differs
UNION ALL SELECT database, schema_name, table_name, name, 'warning', 'nullable_different', source_type, target_type FROM matched WHERE nullable_differs""")
def diff(spark, sf):
    return schema.diff(i.columns(spark, sf, schemas=2), i.target_columns(spark, sf))


GATE = BOTH + """,
per AS (
  SELECT database, schema_name, table_name, count(*) FILTER (in_source) AS source_columns, count(*) FILTER (in_target) AS target_columns,
    count(*) FILTER (NOT in_target OR NOT in_source OR type_differs) AS differences,
    count(*) FILTER (nullable_differs) AS nullable_warnings,
    bool_or(source_position IS DISTINCT FROM target_position) AS order_differs
  FROM matched GROUP BY database, schema_name, table_name),
gate AS (SELECT *, target_columns = 0 AS table_missing, differences = 0 AS consistent FROM per)
"""


@query("schema_gate", GATE + "SELECT * FROM gate")
def gate(spark, sf):
    return schema.gate(i.columns(spark, sf, schemas=2), i.target_columns(spark, sf))


@query("schema_gate_verdict", GATE + """
SELECT bool_and(consistent) AS consistent, count(*) AS tables, count(*) FILTER (NOT consistent) AS blocked FROM gate""")
def gate_verdict(spark, sf):
    return schema.all_consistent(schema.gate(i.columns(spark, sf, schemas=2), i.target_columns(spark, sf)))


@query("schema_signature", "WITH " + i.columns_sql(schemas=2) + """
SELECT database, schema_name, table_name, count(*) AS column_count,
  md5('[' || string_agg('{"flink_type": "' || stream_read || '", "name": "' || name || '"}', ', ' ORDER BY ordinal_position) || ']')
    AS signature
FROM cols GROUP BY database, schema_name, table_name""")
def signature(spark, sf):
    return schema.signature(i.columns(spark, sf, schemas=2), "canal")


# the target's columns as they are now, read as the source of a stream: what changed?
@query("schema_drift", "WITH " + i.columns_sql(schemas=2) + """,
now AS (
  SELECT database, schema_name, table_name, name,
    CASE WHEN p_brand = 'Brand#3' THEN 'STRING' ELSE stream_read END AS new_type FROM cols WHERE p_brand <> 'Brand#5'
  UNION ALL SELECT database, schema_name, table_name, name || '_new', stream_read FROM cols WHERE p_brand = 'Brand#9'),
old AS (SELECT database, schema_name, table_name, name, stream_read AS old_type FROM cols)
SELECT database, schema_name, table_name, name, CASE WHEN old_type IS NULL THEN 'add' WHEN new_type IS NULL THEN 'drop' ELSE 'modify' END AS change,
  old_type, new_type
FROM old FULL OUTER JOIN now USING (database, schema_name, table_name, name) WHERE old_type IS DISTINCT FROM new_type""")
def drift(spark, sf):
    declared = i.columns(spark, sf, schemas=2)
    brand = F.substring_index("comment", " ", 1)
    current = declared.where(brand != "Brand#5").withColumns(
        {c: F.when(brand == "Brand#3", "text").otherwise(F.col(c)) for c in ("data_type", "column_type")}
    )
    added = declared.where(brand == "Brand#9").withColumn("name", F.concat("name", F.lit("_new")))
    return schema.drift(declared, current.unionByName(added), "canal")


PLAN = BOTH + """,
pk AS (SELECT database, schema_name, table_name, string_agg(name, ',' ORDER BY ordinal_position) AS pk FROM cols
       WHERE ordinal_position <= 2 AND p_size <= 25 GROUP BY database, schema_name, table_name),
firsts AS (SELECT database, schema_name, table_name, arg_min(name, ordinal_position) AS first_name FROM cols GROUP BY database, schema_name, table_name),
gone AS (SELECT database, schema_name, table_name FROM matched GROUP BY database, schema_name, table_name HAVING NOT bool_or(in_target))
SELECT g.database, g.schema_name, g.table_name, 'create' AS action, NULL AS column_name, NULL AS from_type, NULL AS to_type,
  coalesce(pk, first_name) AS key,
  CASE WHEN pk IS NULL THEN 'no primary key, first column is the key' END AS warning
FROM gone g JOIN firsts USING (database, schema_name, table_name) LEFT JOIN pk USING (database, schema_name, table_name)
UNION ALL
SELECT database, schema_name, table_name, CASE WHEN NOT in_target THEN 'add' WHEN NOT in_source THEN 'drop' ELSE 'modify' END, name, target_type,
  CASE WHEN in_source THEN store END, NULL, NULL
FROM matched WHERE (database, schema_name, table_name) NOT IN (SELECT (database, schema_name, table_name) FROM gone)
  AND (NOT in_target OR NOT in_source OR type_differs OR nullable_differs)"""


@query("schema_plan", PLAN)
def plan(spark, sf):
    columns = i.columns(spark, sf, schemas=2)
    size = i.table(spark, sf, "part").select(
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), "p_partkey").alias("name"), "p_size"
    )
    keys = (
        columns.join(size, "name")
        .where((F.col("ordinal_position") <= 2) & (F.col("p_size") <= 25))
        .groupBy(*schema.TABLE)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal_position", "name"))), lambda e: e["name"]).alias("column_names"))
    )
    planned = schema.plan(columns, i.target_columns(spark, sf), keys)
    return planned.withColumn("key", F.array_join("key", ","))


CONFORMED = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("status", T.IntegerType()),
        T.StructField("price", T.DecimalType(8, 2)),
        T.StructField("priority", T.StringType(), False),
        T.StructField("source", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("note", T.StringType()),
    ]
)


@query("schema_conform", "WITH " + i.ORDERS_SQL + """,
raw AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN '1' WHEN o_orderstatus = 'O' THEN '0' ELSE 'P' END AS status,
          CASE WHEN o_totalprice > 499000 THEN '1' || o_totalprice ELSE CAST(o_totalprice AS VARCHAR) END AS price,
          o_orderpriority AS priority FROM tgt),
shaped AS (SELECT id, TRY_CAST(status AS INTEGER) AS status, TRY_CAST(price AS DECIMAL(8,2)) AS p, priority FROM raw),
judged AS (SELECT *, nullif(concat_ws('; ', CASE WHEN status IS NULL THEN 'status: cannot be cast' END,
    CASE WHEN p IS NULL THEN 'price: cannot be cast' END, CASE WHEN priority IS NULL THEN 'priority: required' END), '')
    AS reject_reason FROM shaped)
SELECT id, status, CAST(p AS VARCHAR) AS price, priority, 'new' AS source, CAST(3 AS INTEGER) AS version,
  CAST(NULL AS VARCHAR) AS note, reject_reason FROM judged""")
def conform(spark, sf):
    status = F.col("o_orderstatus")
    price = F.col("o_totalprice").cast("string")
    raw = i.orders_target(spark, sf).select(
        F.col("o_orderkey").alias("id"),
        F.when(status == "F", "1").when(status == "O", "0").otherwise("P").alias("status"),
        F.when(F.col("o_totalprice") > 499000, F.concat(F.lit("1"), price)).otherwise(price).alias("price"),
        F.col("o_orderpriority").alias("priority"),
        "o_custkey",
    )
    defaults = {"source": ("text", "new"), "version": ("number", "3"), "note": ("expression", None)}
    return schema.conform(raw, CONFORMED, defaults).withColumn("price", F.col("price").cast("string"))


def _types(source_type: str, field: str) -> str:
    return "WITH " + i.columns_sql(source_type=source_type) + f"SELECT database, table_name, name, {field} AS mapped FROM cols"


for _source, _name in (("mysql", "mysql"), ("postgresql", "pg"), ("oracle", "oracle")):

    @query(f"map_types_{_name}", _types(_source, "store"))
    def map_types(spark, sf, source=_source):
        return i.columns(spark, sf, source).select("database", "table_name", "name", typemap.store_type(source).alias("mapped"))


@query("map_types_hive", "WITH " + ", ".join(i.columns_sql(s, s) for s in i.TYPES) + " UNION ALL ".join(
    f"SELECT '{s}' AS source_type, database, table_name, name, hive AS mapped FROM {s}" for s in i.TYPES))
def map_types_hive(spark, sf):
    frames = [i.columns(spark, sf, s).withColumn("source_type", F.lit(s)) for s in i.TYPES]
    both = frames[0].unionByName(frames[1]).unionByName(frames[2])
    return both.select(
        "source_type", "database", "table_name", "name",
        typemap.hive_type_by_row(F.col("source_type")).alias("mapped"),
    )


@query("map_types_cdc", "WITH " + i.columns_sql("m") + "," + i.columns_sql("p", "postgresql") + """
SELECT 'canal' AS change_format, database, table_name, name, stream_read AS read_type, stream_write AS write_type FROM m
UNION ALL SELECT 'debezium', database, table_name, name, stream_read, stream_write FROM p""")
def map_types_cdc(spark, sf):
    def mapped(source, change_format):
        return i.columns(spark, sf, source).select(
            F.lit(change_format).alias("change_format"), "database", "table_name", "name",
            typemap.change_types(change_format).alias("t"),
        ).select("change_format", "database", "table_name", "name", "t.read_type", "t.write_type")

    return mapped("mysql", "canal").unionByName(mapped("postgresql", "debezium"))


NORMALISED = [("int(11)", "int"), ("tinyint(1)", "boolean"), ("BOOLEAN", "boolean"), ("bool", "boolean"),
              (" Decimal(10, 2) ", "decimal(10,2)"), ("BIGINT(20)", "bigint"), ("varchar(20)", "varchar(20)"),
              ("tinyint(1) unsigned", "boolean"), ("double precision", "doubleprecision"), (None, "")]
_NORMAL_AT = f"((p_partkey + p_size) % {len(NORMALISED)})"


@query("normalise_type", f"""SELECT p_partkey, {i.pick_sql(NORMALISED, 1, _NORMAL_AT)} AS normalised FROM part""")
def normalise_type(spark, sf):
    at = F.pmod(F.col("p_partkey") + F.col("p_size"), F.lit(len(NORMALISED)))
    return i.table(spark, sf, "part").select(
        "p_partkey", typemap.normalise_type(i.pick(NORMALISED, 0, at)).alias("normalised")
    )


# text, length/precision/scale of the catalog row, then name, length, precision, scale
TEXTS = {
    "store": [("decimal(12,3)", None, None, None, "decimal", None, 12, 3), ("VARCHAR(64)", None, None, None, "varchar", 64, None, None),
              (" int(11) ", None, None, None, "int", None, None, None), ("datetime(3)", None, None, None, "datetime(3)", None, None, None)],
    "oracle": [("VARCHAR2(30 CHAR)", 120, None, None, "varchar2", 30, None, None), ("NUMBER(8)", 22, None, None, "number", None, 8, 0),
               ("NUMBER", 22, 9, 4, "number", None, 9, 4), ("NUMBER(12, 2)", 22, 1, 1, "number", None, 12, 2),
               ("TIMESTAMP(6) WITH TIME ZONE", 11, None, None, "timestamp", None, None, None), ("RAW", 16, None, None, "raw", 16, None, None),
               ("CLOB", 4000, None, None, "clob", None, None, None)],
    "odps": [("DECIMAL(10,2)", None, None, None, "decimal", None, 10, 2), ("VARCHAR(40)", None, None, None, "varchar", 40, None, None),
             ("STRING", None, None, None, "string", None, None, None), ("array<string>", None, None, None, "array<string>", None, None, None)],
    "clickhouse": [("Decimal(18, 4)", None, None, None, "decimal", None, 18, 4), ("FixedString(16)", None, None, None, "fixedstring", 16, None, None),
                   ("Nullable(Int32)", None, None, None, "nullable", None, None, None), ("UInt64", None, None, None, "uint64", None, None, None)],
    "db2": [("VARCHAR", 80, None, 0, "varchar", 80, None, None), ("DECIMAL", 15, None, 2, "decimal", None, 15, 2),
            ("INTEGER", 4, None, 0, "integer", None, None, None), ("DECIMAL", 7, None, None, "decimal", None, 7, 0)],
}


def _texts_sql(kind: str) -> str:
    at = f"(p_partkey % {len(TEXTS[kind])})"
    parts = ", ".join(
        i.pick_sql(TEXTS[kind], n, at, "VARCHAR" if n == 4 else "INTEGER") + f" AS {name}"
        for n, name in ((4, "data_type"), (5, "max_length"), (6, "numeric_precision"), (7, "numeric_scale"))
    )
    return f"SELECT '{kind}' AS kind, p_partkey, {parts} FROM part"


@query("parse_type_text", " UNION ALL ".join(_texts_sql(k) for k in TEXTS))
def parse_type_text(spark, sf):
    part = i.table(spark, sf, "part")
    result = None
    for kind, rows in TEXTS.items():
        at = F.pmod(F.col("p_partkey"), F.lit(len(rows)))
        raw = part.select(
            F.lit(kind).alias("kind"), "p_partkey", i.pick(rows, 0, at).alias("text"),
            *[i.pick(rows, n, at, "int").alias(c) for n, c in ((1, "length"), (2, "precision"), (3, "scale"))],
        )
        text, length, precision, scale = (F.col(c) for c in ("text", "length", "precision", "scale"))
        parsed = {
            "store": lambda: typetext.store_descriptor(text),
            "oracle": lambda: typetext.oracle_descriptor(text, length, precision, scale),
            "odps": lambda: typetext.odps_descriptor(text),
            "clickhouse": lambda: typetext.clickhouse_descriptor(text),
            "db2": lambda: typetext.db2_descriptor(text, length, scale),
        }[kind]()
        shaped = raw.select("kind", "p_partkey", parsed.alias("d")).select(
            "kind", "p_partkey", "d.data_type", "d.max_length", "d.numeric_precision", "d.numeric_scale"
        )
        result = shaped if result is None else result.unionByName(shaped)
    return result


@query("column_defaults", "WITH " + i.columns_sql(schemas=2) + f"""
SELECT database, table_name, name, {i.pick_sql(i.DEFAULTS, 1, f"(p_size % {len(i.DEFAULTS)})")} AS kind,
  {i.pick_sql(i.DEFAULTS, 2, f"(p_size % {len(i.DEFAULTS)})")} AS value FROM cols""")
def column_defaults(spark, sf):
    return schema.default_rows(i.columns(spark, sf, schemas=2)).select("database", "table_name", "name", "default.kind", "default.value")
