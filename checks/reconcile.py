"""Reconciliation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as i
from checks.registry import query
from tidegate.operators import reconcile as rc
from tidegate.operators.reconcile import Pair
from tidegate.plans import reconcile_run
from tidegate.session import scratch_path


def order_pairs(spark, sf):
    return [Pair("orders", i.orders(spark, sf), i.orders_target(spark, sf))]


def all_pairs(spark, sf):
    """Equal tables, a table with defects, and one the target does not have."""
    same = [Pair(t, i.table(spark, sf, t), i.table(spark, sf, t)) for t in ("lineitem", "customer", "conversations")]
    return [*order_pairs(spark, sf), *same, Pair("supplier", i.table(spark, sf, "supplier"), None)]


ROW_COUNT = "WITH " + i.ORDERS_SQL + """,
counts AS (
  SELECT 'orders' AS "table", (SELECT count(*) FROM src) AS s, (SELECT count(*) FROM tgt) AS t
  UNION ALL SELECT 'lineitem', count(*), count(*) FROM lineitem
  UNION ALL SELECT 'customer', count(*), count(*) FROM customer
  UNION ALL SELECT 'conversations', count(*), count(*) FROM conversations
  UNION ALL SELECT 'supplier', count(*), NULL FROM supplier)
"""


@query("reconcile_row_count", ROW_COUNT + """
SELECT "table", s AS source_count, t AS target_count, t - s AS diff,
  CASE WHEN t IS NULL THEN 'target_missing' WHEN s = t THEN 'ok' ELSE 'mismatch' END AS status
FROM counts""")
def row_count(spark, sf):
    return rc.row_count(all_pairs(spark, sf))


@query("reconcile_summary", ROW_COUNT + """
SELECT count(*) AS total, count(*) FILTER (s = t) AS ok, count(*) - count(*) FILTER (s = t) AS mismatch,
  count(*) FILTER (s <> t) AS different, count(*) FILTER (t IS NULL) AS missing,
  CAST(0 AS BIGINT) AS errors, CAST(0 AS BIGINT) AS skipped
FROM counts""")
def summary(spark, sf):
    return rc.summary(rc.row_count(all_pairs(spark, sf)))


def _snapshot_sql(source: str, text: str) -> str:
    one = "CAST(coalesce(sum(CAST(('0x' || substr(md5({t}), 1, 15)) AS BIGINT)), 0) AS VARCHAR)"
    return (
        f"SELECT count(*) AS n, {one.format(t=f'CAST({text} AS VARCHAR)')} || ':' || "
        f"{one.format(t=f"({text}) || ';'")} AS h FROM {source}"
    )


SNAPSHOT_COLUMNS = """
  s.n AS source_count, t.n AS target_count, s.h AS source_hash, t.h AS target_hash, 
  CASE WHEN s.n = t.n AND s.h = t.h THEN 'ok' ELSE 'mismatch' END AS status
"""
TURN = "conv_id || '|' || turn"


@query("reconcile_pk_snapshot", "WITH " + i.ORDERS_SQL + f""",
os AS ({_snapshot_sql("src", "o_orderkey")}), ot AS ({_snapshot_sql("tgt", "o_orderkey")})
SELECT 'orders' AS "table", {SNAPSHOT_COLUMNS} FROM os s, ot t""")
def pk_snapshot(spark, sf):
    return rc.pk_snapshot(order_pairs(spark, sf), ["o_orderkey"])


@query("reconcile_pk_snapshot_composite", f"""
WITH c AS ({_snapshot_sql("conversations", TURN)})
SELECT 'conversations' AS "table", {SNAPSHOT_COLUMNS} FROM c s, c t""")
def pk_snapshot_composite(spark, sf):
    conversations = i.table(spark, sf, "conversations")
    return rc.pk_snapshot([Pair("conversations", conversations, conversations)], ["conv_id", "turn"])


def _digest_sql(source: str, text: str) -> str:
    return (
        f"SELECT count(*) AS n, CAST(coalesce(sum(CAST(('0x' || substr(md5({text}), 1, 15)) AS BIGINT)), 0) AS VARCHAR) "
        f"AS d FROM {source}"
    )


@query("reconcile_pk_digest", "WITH " + i.ORDERS_SQL + f""",
os AS ({_digest_sql("src", "CAST(o_orderkey AS VARCHAR)")}), ot AS ({_digest_sql("tgt", "CAST(o_orderkey AS VARCHAR)")})
SELECT 'orders' AS "table", s.n AS source_count, t.n AS target_count, s.d AS source_digest, t.d AS target_digest,
  CASE WHEN s.n = t.n AND s.d = t.d THEN 'ok' ELSE 'mismatch' END AS status FROM os s, ot t""")
def pk_digest(spark, sf):
    return rc.pk_digest(order_pairs(spark, sf), ["o_orderkey"])


@query("reconcile_pk_digest_lineitem", f"""
WITH l AS ({_digest_sql("lineitem", "l_orderkey || '|' || l_linenumber || '|' || l_partkey")})
SELECT 'lineitem' AS "table", n AS source_count, n AS target_count, d AS source_digest, d AS target_digest,
  'ok' AS status FROM l""")
def pk_digest_lineitem(spark, sf):
    lines = i.table(spark, sf, "lineitem")
    return rc.pk_digest([Pair("lineitem", lines, lines)], ["l_orderkey", "l_linenumber", "l_partkey"])


PROFILED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _profile_sql(source: str) -> str:
    one = (
        "SELECT '{c}' AS \"column\", count({c}) || '|' || count(DISTINCT {c}) || '|' || "
        "coalesce(CAST(min({c}) AS VARCHAR), 'None') || '|' || coalesce(CAST(max({c}) AS VARCHAR), 'None') AS v FROM {t}"
    )
    return " UNION ALL ".join(one.format(c=c, t=source) for c in PROFILED)


@query("reconcile_field_value", "WITH " + i.ORDERS_SQL + f""",
ps AS ({_profile_sql("src")}), pt AS ({_profile_sql("tgt")})
SELECT 'orders' AS "table", "column", ps.v AS source_values, pt.v AS target_values,
  CASE WHEN ps.v = pt.v THEN 'ok' ELSE 'mismatch' END AS status FROM ps JOIN pt USING ("column")""")
def field_value(spark, sf):
    return rc.field_value(order_pairs(spark, sf), PROFILED)


METRIC = "SELECT COUNT(*) AS n, SUM(o_totalprice) AS amount, MAX(o_orderkey) AS newest FROM {schema}.{table} WHERE o_orderstatus = 'F'"


@query("reconcile_metric", "WITH " + i.ORDERS_SQL + """,
ms AS (SELECT count(*) || '|' || sum(o_totalprice) || '|' || max(o_orderkey) AS v FROM src WHERE o_orderstatus = 'F'),
mt AS (SELECT count(*) || '|' || sum(o_totalprice) || '|' || max(o_orderkey) AS v FROM tgt WHERE o_orderstatus = 'F')
SELECT 'orders' AS "table", ms.v AS source_values, mt.v AS target_values,
  CASE WHEN ms.v = mt.v THEN 'ok' ELSE 'mismatch' END AS status FROM ms, mt""")
def metric(spark, sf):
    return rc.metric(order_pairs(spark, sf), METRIC)


METADATA = "WITH " + i.columns_sql(schemas=2) + "," + i.TARGET_COLUMNS_SQL + """,
per AS (
  SELECT database, schema_name, table_name, count(*) FILTER (in_source) AS source_columns, count(*) FILTER (in_target) AS target_columns,
    count(*) FILTER (NOT in_target) AS to_add, count(*) FILTER (NOT in_source) AS to_drop,
    count(*) FILTER (type_differs OR nullable_differs) AS to_modify
  FROM matched GROUP BY database, schema_name, table_name)
SELECT *, CASE WHEN target_columns = 0 THEN 'target_missing' WHEN to_add + to_drop + to_modify = 0 THEN 'ok'
               ELSE 'mismatch' END AS status FROM per"""


@query("reconcile_metadata", METADATA)
def metadata(spark, sf):
    return rc.metadata(i.columns(spark, sf, schemas=2), i.target_columns(spark, sf))


@query("reconcile_key_diff", "WITH " + i.ORDERS_SQL + """
SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey,
  CASE WHEN t.o_orderkey IS NULL THEN 'missing_in_target' WHEN s.o_orderkey IS NULL THEN 'extra_in_target'
       ELSE 'changed' END AS change,
  CASE WHEN s.o_orderkey IS NULL THEN 0 ELSE 1 END::BIGINT AS source_rows,
  CASE WHEN t.o_orderkey IS NULL THEN 0 ELSE 1 END::BIGINT AS target_rows
FROM src s FULL OUTER JOIN tgt t ON s.o_orderkey = t.o_orderkey
WHERE s.o_orderkey IS NULL OR t.o_orderkey IS NULL OR s.o_custkey IS DISTINCT FROM t.o_custkey
  OR s.o_orderstatus IS DISTINCT FROM t.o_orderstatus OR s.o_totalprice IS DISTINCT FROM t.o_totalprice
  OR s.o_orderdate IS DISTINCT FROM t.o_orderdate OR s.o_orderpriority IS DISTINCT FROM t.o_orderpriority""")
def key_diff(spark, sf):
    return rc.key_diff(i.orders(spark, sf), i.orders_target(spark, sf), ["o_orderkey"], PROFILED[1:])


@query("reconcile_recent_runs", """
SELECT * FROM (
  SELECT 'task_' || user_id AS task_name, event_id AS run_id, event_type AS status,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS recency FROM events)
WHERE recency <= 10""")
def recent_runs(spark, sf):
    runs = i.events(spark, sf).select(
        F.concat(F.lit("task_"), "user_id").alias("task_name"),
        F.col("event_id").alias("run_id"),
        F.col("event_type").alias("status"),
        F.col("ts").alias("ran_at"),
    )
    return rc.recent_runs(runs).drop("ran_at")


@query("reconcile_task_alerts", ROW_COUNT + """
SELECT "table", CASE WHEN t IS NULL THEN 'target_missing' ELSE 'mismatch' END AS status
FROM counts WHERE s IS DISTINCT FROM t""")
def task_alerts(spark, sf):
    """A whole task: open both sides, compare, keep what needs attention."""

    def target(name):
        if name == "supplier":
            raise LookupError("supplier is not in the target")
        return i.orders_target(spark, sf) if name == "orders" else i.table(spark, sf, name)

    task = reconcile_run.Task(
        "daily counts", "row_count", ("orders", "lineitem", "customer", "conversations", "supplier")
    )
    details = reconcile_run.details(spark, task, lambda name: i.table(spark, sf, name), target)
    return rc.alerts(details).select("table", "status")


@query("reconcile_run_with_failure", "WITH " + i.ORDERS_SQL + """
SELECT 'orders' AS "table", 'mismatch' AS status, (SELECT count(*) FROM src) AS source_count, (SELECT count(*) FROM tgt) AS target_count
UNION ALL SELECT 'lineitem', 'ok', count(*), count(*) FROM lineitem
UNION ALL SELECT 'events', 'source_error', NULL, NULL
UNION ALL SELECT 'customer', 'ok', count(*), count(*) FROM customer
UNION ALL SELECT 'part', 'target_missing', NULL, NULL""")
def run_with_failure(spark, sf):
    """A recorded run in which one source and one target break while they are read."""

    def broken(name):
        rows = i.table(spark, sf, name)
        return rows.where(F.raise_error(F.concat(F.lit("lost block of "), F.col(rows.columns[0]).cast("string"))).isNull())

    source = lambda name: broken(name) if name == "events" else i.orders(spark, sf) if name == "orders" else i.table(spark, sf, name)
    target = lambda name: broken(name) if name == "part" else i.orders_target(spark, sf) if name == "orders" else i.table(spark, sf, name)
    history = scratch_path(spark, "runs")
    task = reconcile_run.Task("counts", "row_count", ("orders", "lineitem", "events", "customer", "part"))
    run = reconcile_run.record(spark, task, source, target, history)
    if run["status"] != "success":
        raise RuntimeError(run["error"])
    found = spark.read.option("mergeSchema", "true").parquet(f"{history}/details")
    return found.select("table", "status", "source_count", "target_count")


LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_VALUES = ["l_quantity", "l_returnflag", "l_shipdate"]


def lines(spark, sf):
    return i.table(spark, sf, "lineitem").select(*LINE, *LINE_VALUES)


def lines_target(spark, sf):
    """A sixth of all lines with another quantity, some without, and some more."""
    rows = lines(spark, sf)
    part = F.col("l_partkey")
    changed = rows.withColumn("l_quantity", F.when(part % 6 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    more = rows.where(part % 101 == 1).withColumn("l_suppkey", -F.col("l_suppkey") - 1)
    return changed.where(part % 97 != 2).unionByName(more)


def _lines_sql(source):
    text = "l_quantity || '|' || l_returnflag || '|' || l_shipdate"
    return f"SELECT {', '.join(LINE)}, count(*) AS n, list_sort(list({text})) AS v FROM {source} GROUP BY {', '.join(LINE)}"


@query("reconcile_key_diff_deep", f"""
WITH changed AS (
  SELECT * REPLACE (CASE WHEN l_partkey % 6 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity) FROM lineitem),
moved AS (
  SELECT * FROM changed WHERE l_partkey % 97 <> 2
  UNION ALL SELECT * REPLACE (-l_suppkey - 1 AS l_suppkey) FROM lineitem WHERE l_partkey % 101 = 1),
s AS ({_lines_sql("lineitem")}), t AS ({_lines_sql("moved")})
SELECT {', '.join(LINE)}, CASE WHEN t.n IS NULL THEN 'missing_in_target' WHEN s.n IS NULL THEN 'extra_in_target' ELSE 'changed' END AS change,
  coalesce(s.n, 0) AS source_rows, coalesce(t.n, 0) AS target_rows
FROM s FULL OUTER JOIN t USING ({', '.join(LINE)}) WHERE s.v IS DISTINCT FROM t.v""")
def key_diff_deep(spark, sf):
    """Scattered differences; the source's tree is the one an earlier run has kept."""
    source, target = lines(spark, sf), lines_target(spark, sf)
    depth = rc.depth_for(source.count(), leaf_rows=16)
    kept = scratch_path(spark, "digests")
    rc.key_digests(source, LINE, LINE_VALUES, depth).write.parquet(kept)
    return rc.key_diff_deep(source, target, LINE, LINE_VALUES, depth, source_digests=spark.read.parquet(kept))


@query("reconcile_distinct_screen", "WITH " + i.ORDERS_SQL + " UNION ALL ".join(
    f""" SELECT '{c}' AS "column", CASE WHEN EXISTS (SELECT {c} FROM src WHERE {c} IS NOT NULL EXCEPT SELECT {c} FROM tgt)
    OR EXISTS (SELECT {c} FROM tgt WHERE {c} IS NOT NULL EXCEPT SELECT {c} FROM src) THEN 'mismatch' ELSE 'ok' END AS status"""
    for c in PROFILED))
def distinct_screen(spark, sf):
    """Different estimates prove a difference; equal ones fall through to the values."""
    source, target = i.orders(spark, sf), i.orders_target(spark, sf)
    by_day = [rc.distinct_sketches(source.where(half), PROFILED) for half in ("o_orderkey % 2 = 0", "o_orderkey % 2 <> 0")]
    kept = rc.merged_sketches(by_day[0].unionByName(by_day[1]))
    return rc.distinct_values(source, target, PROFILED, source_sketches=kept).select("column", "status")


@query("reconcile_history", ROW_COUNT + """,
runs AS (
  SELECT 'daily counts' AS task_name, count(*) AS total, count(*) FILTER (s = t) AS ok FROM counts
  UNION ALL SELECT 'orders alone', count(*), count(*) FILTER (s = t) FROM counts WHERE "table" = 'orders')
SELECT task_name, 'row_count' AS task_type, 'success' AS status, total, ok, total - ok AS mismatch, total AS details FROM runs""")
def history(spark, sf):
    """Two recorded runs, with as many details as each counted."""
    folder = scratch_path(spark, "history")
    every = tuple(p.table for p in all_pairs(spark, sf))
    opened = {p.table: p for p in all_pairs(spark, sf)}

    def target(name):
        if opened[name].target is None:
            raise LookupError(f"{name} is not in the target")
        return opened[name].target

    for name, tables in (("daily counts", every), ("orders alone", ("orders",))):
        reconcile_run.record(spark, reconcile_run.Task(name, "row_count", tables), lambda t: opened[t].source, target, folder)
    runs = spark.read.parquet(f"{folder}/runs")
    details = spark.read.option("mergeSchema", "true").parquet(f"{folder}/details").groupBy("run_id").agg(F.count("*").alias("details"))
    return runs.join(details, "run_id").select("task_name", "task_type", "status", "total", "ok", "mismatch", "details")
