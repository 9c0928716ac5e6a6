"""Request-log, load and warehouse-layer queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks import inputs as i
from checks.registry import query
from tidegate.operators import requests as rq
from tidegate.plans import gated_load
from tidegate.session import scratch_path
from tidegate.sources import tables
from tidegate.streaming import apply as streaming

NOW = dt.datetime(2024, 1, 31)
REQUESTS = "WITH " + i.REQUESTS_SQL + """,
kept AS (SELECT * FROM req WHERE path LIKE '/api/%' OR path LIKE '/admin/%'
  OR NOT (path LIKE '/static/%' OR path LIKE '/favicon.ico%' OR path LIKE '%.js' OR path LIKE '%.css'
          OR path LIKE '%.png' OR path LIKE '%.ico')),
win AS (SELECT * FROM kept WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 365 DAY)
"""


def recorded(spark, sf):
    return rq.ingest(i.requests(spark, sf))


def recent_days(spark, sf):
    """A year."""
    return rq.window(recorded(spark, sf), NOW, 365)


@query("ops_ingest_filter", REQUESTS + "SELECT event_id, method, path FROM kept")
def ingest_filter(spark, sf):
    return recorded(spark, sf).select("event_id", "method", "path")


@query("ops_window", REQUESTS + """
SELECT event_id, path FROM kept WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY""")
def window(spark, sf):
    return rq.window(recorded(spark, sf), NOW).select("event_id", "path")


@query("ops_totals", REQUESTS + """
SELECT count(*) AS total, count(*) FILTER (status_code >= 400) AS errors,
  CAST(round(CAST(count(*) FILTER (status_code >= 400) * 100 AS DECIMAL(20,6)) / count(*), 2) AS DOUBLE) AS error_rate,
  CAST(round(CAST((count(*) - count(*) FILTER (status_code >= 400)) * 100 AS DECIMAL(20,6)) / count(*), 2) AS DOUBLE) AS success_rate
FROM win""")
def totals(spark, sf):
    return rq.totals(recent_days(spark, sf))


@query("ops_by_day", REQUESTS + """
SELECT CAST(created_at + INTERVAL 8 HOUR AS DATE)::VARCHAR AS day, count(*) AS count FROM win GROUP BY 1""")
def by_day(spark, sf):
    return rq.by_day(recent_days(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query("ops_path_counts", REQUESTS + "SELECT method, path, count(*) AS count FROM win GROUP BY ALL")
def path_counts(spark, sf):
    return rq.path_counts(recent_days(spark, sf))


@query("ops_top_paths", REQUESTS + """
SELECT method, path, count(*) AS count FROM win GROUP BY ALL ORDER BY count DESC, method, path LIMIT 12""")
def top_paths(spark, sf):
    return rq.top_paths(recent_days(spark, sf))


@query("ops_status_dist", REQUESTS + "SELECT status_code, count(*) AS count FROM win GROUP BY ALL")
def status_dist(spark, sf):
    return rq.status_distribution(recent_days(spark, sf))


@query("ops_recent", REQUESTS + """
SELECT event_id, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at, method, path, status_code, duration_ms, username
FROM win ORDER BY win.created_at DESC, event_id DESC LIMIT 30""")
def recent(spark, sf):
    newest = rq.recent(recent_days(spark, sf))
    return newest.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("ops_stream_ingest", REQUESTS + "SELECT method, count(*) AS count FROM kept GROUP BY method")
def stream_ingest(spark, sf):
    """Requests through the streaming append, then counted."""
    root = scratch_path(spark, "requests")
    i.requests(spark, sf).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(i.requests(spark, sf).schema).parquet(f"{root}/in")
    streaming.append_stream(rq.ingest(stream), f"{root}/out", f"{root}/checkpoint", drain=True).awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("method").agg(F.count("*").alias("count"))


@query("load_full", "WITH " + i.ORDERS_SQL + """
SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS VARCHAR) AS o_totalprice FROM src""")
def load_full(spark, sf):
    """A first load of the defective copy, then a full load of the source over it."""
    path = scratch_path(spark, "load")
    kept = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    tables.load(i.orders_target(spark, sf).select(*kept), path)
    tables.load(i.orders(spark, sf).select(*kept), path)
    return spark.read.parquet(path).withColumn("o_totalprice", F.col("o_totalprice").cast("string"))


@query("load_append", "WITH " + i.ORDERS_SQL + """
SELECT o_orderstatus, count(*) AS n FROM (SELECT * FROM src UNION ALL SELECT * FROM tgt) GROUP BY ALL""")
def load_append(spark, sf):
    path = scratch_path(spark, "append")
    kept = ["o_orderkey", "o_orderstatus"]
    tables.load(i.orders(spark, sf).select(*kept), path)
    tables.load(i.orders_target(spark, sf).select(*kept), path, truncate=False)
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


GATED = ("public.t_0", "audit.t_0", "public.t_1", "audit.t_1", "audit.t_2", "public.t_5")


@query("load_gated", "WITH " + i.columns_sql(schemas=2) + "," + i.TARGET_COLUMNS_SQL + f""",
wanted AS (SELECT unnest({list(GATED)}) AS "table"),
per AS (
  SELECT w."table", count(*) FILTER (schema_name = 'audit' AND (NOT in_target OR NOT in_source OR type_differs)) AS differences
  FROM wanted w LEFT JOIN matched m ON w."table" = m.schema_name || '.' || m.table_name GROUP BY 1)
SELECT "table", differences, differences = 0 AS executed,
  CASE WHEN differences = 0 THEN (SELECT count(*) FROM orders) END AS loaded FROM per""")
def load_gated(spark, sf):
    """Loads of tables whose name stands in two schemas: of one the target is in step, and the gate blocks the other."""
    source = i.columns(spark, sf, schemas=2)
    target = i.target_columns(spark, sf).where("schema_name = 'audit'")
    in_step = i.columns(spark, sf, extra=("store",), schemas=2).withColumn("column_type", F.lower("store")).where("schema_name = 'public'")
    target = target.unionByName(in_step.select(*target.columns))
    rows = []
    for table in GATED:
        path = scratch_path(spark, "gated")
        result = gated_load.run(i.orders(spark, sf), path, table, source, target)
        loaded = spark.read.parquet(path).count() if result.executed else None
        rows.append((table, result.differences.where("level = 'difference'").count(), result.executed, loaded))
    return spark.createDataFrame(rows, "`table` string, differences bigint, executed boolean, loaded bigint")


DAY, EMPTY_DAY = "2024-01-10", "2024-01-11"


@query("ods_partition_reload", "WITH " + i.EVENTS_SQL + f"""
SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS n,
  CAST(sum(CAST(amount AS DECIMAL(10,2)) * CASE WHEN strftime(ts, '%Y-%m-%d') = '{DAY}' THEN 2 ELSE 1 END) AS VARCHAR) AS amount
FROM ev WHERE strftime(ts, '%Y-%m-%d') <> '{EMPTY_DAY}' GROUP BY 1""")
def partition_reload(spark, sf):
    """All days loaded, then one day again with doubled amounts and one with no rows; the other days stay."""
    path = scratch_path(spark, "ods")
    amount = F.col("amount").cast("decimal(10,2)")
    days = i.events(spark, sf).select(
        "event_id", "user_id", amount.alias("amount"), F.date_format("ts", "yyyy-MM-dd").alias("dt")
    )
    tables.write_days(days, path)
    again = tables.read_days(spark, path, DAY).withColumn("amount", (F.col("amount") * 2).cast("decimal(10,2)"))
    # read before it is replaced, so the day goes through a table of its own
    staged = scratch_path(spark, "ods-day")
    tables.load(again, staged)
    tables.load_day(spark.read.parquet(staged), path, DAY)
    tables.load_day(spark.read.parquet(staged).limit(0), path, EMPTY_DAY)
    return tables.read_days(spark, path).groupBy("dt").agg(
        F.count("*").alias("n"), F.sum("amount").cast("string").alias("amount")
    )


@query("ods_partition_retention", """
SELECT dt, CASE WHEN dt < '1998-01-25' THEN 'drop' ELSE 'keep' END AS verdict,
  dt BETWEEN '1998-01-25' AND '1998-02-04' AS prepared
FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS dt FROM orders)""")
def partition_retention(spark, sf):
    days = i.table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("dt")).distinct()
    return tables.retention(days, "1998-02-01")


DETAIL = """
SELECT o.o_orderkey AS order_id, o.o_custkey AS user_id, c.c_name AS customer_name,
       CAST(o.o_totalprice AS STRING) AS amount, :dt AS dt
FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey
WHERE o.dt = :dt
"""


# the day is the statement's own parameter, as in every day-partitioned layer
@query("dwd_order_detail", """
SELECT o_orderkey AS order_id, o_custkey AS user_id, c_name AS customer_name,
  CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS amount, '1998-06-15' AS dt
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate = TIMESTAMP '1998-06-15'""")
def order_detail(spark, sf):
    dated = i.orders(spark, sf).withColumn("dt", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return tables.transform(spark, DETAIL, "1998-06-15", orders=dated, customer=i.table(spark, sf, "customer"))


MONTHS = """
SELECT date_format(o.o_orderdate, 'yyyy-MM') AS month, c.c_mktsegment AS segment, count(*) AS orders,
       CAST(sum(o.o_totalprice) AS STRING) AS amount
FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey
WHERE o.o_orderdate >= CAST(:dt AS DATE)
GROUP BY 1, 2
"""


@query("dwd_order_detail_all_days", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, c_mktsegment AS segment, count(*) AS orders,
  CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS VARCHAR) AS amount
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL""")
def order_detail_all(spark, sf):
    return tables.transform(
        spark, MONTHS, "1900-01-01", orders=i.orders(spark, sf), customer=i.table(spark, sf, "customer")
    )
