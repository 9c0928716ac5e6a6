"""Change-data queries, batch and streaming."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import inputs as i
from checks.registry import query
from tidegate.functions.images import raw_cell, typed
from tidegate.functions.values import in_day, is_unsigned_number, local_time
from tidegate.operators import changes as ch
from tidegate.operators import schema
from tidegate.operators.catalog import COLUMNS_DDL
from tidegate.operators.changes import Route
from tidegate.plans import apply_day, repair
from tidegate.session import scratch_path
from tidegate.sources import bronze, canal, debezium
from tidegate.sources.keyed_table import KeyedTable
from tidegate.streaming import apply as streaming
from tidegate.streaming import control, drift

DAY, NEXT_DAY = "2024-01-10", "2024-01-11"
# Shanghai midnights around these days
DAY_MS = (1704816000000, 1704902400000, 1704988800000)
REPLAY_MS = 1705276800000

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("event", T.StringType()),
        T.StructField("price", T.DecimalType(10, 2)),
        T.StructField("k", T.IntegerType()),
        T.StructField("vip", T.StringType()),
        T.StructField("tags", T.StringType()),
        T.StructField("seen_at", T.StringType()),
    ]
)
ROUTE = Route(i.TOPIC, "accounts", ("id",), SCHEMA, guarded=("price",), local_times=("seen_at",), whole_images=True)
# partial images lack the price, so nothing guards it
PARTIAL = Route(i.TOPIC, "accounts", ("id",), SCHEMA, local_times=("seen_at",))
CANAL_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("age", T.IntegerType()),
    ]
)
CANAL_ROUTE = Route(i.TOPIC, "users", ("id",), CANAL_SCHEMA, change_format="canal")


def shown(df):
    """Decimals as text, so both engines print them alike."""
    return df.withColumn("price", F.col("price").cast("string"))


def classified(spark, sf, **log):
    return debezium.classify(debezium.decode(i.debezium_log(spark, sf, **log), SCHEMA.fieldNames()), keys=["id"])


def cell(image, name, data_type, kind=T.MapType(T.StringType(), T.VariantType())):
    return typed(raw_cell(F.col(image), name, kind), data_type)


@query("cdc_decode_debezium", "WITH " + i.log_sql() + """
SELECT event_id AS "offset", readable, op, event_ms,
  CASE WHEN readable AND k NOT IN (16, 17) AND (op IN ('c','r','u','x') OR op IS NULL) THEN user_id END AS after_id,
  CASE WHEN readable AND k NOT IN (16, 17) AND (op IN ('c','r','u','x') OR op IS NULL) THEN event_type END AS after_event,
  CASE WHEN op = 'd' AND k <> 22 THEN user_id END AS before_id,
  CASE WHEN k = 22 OR (event_type = 'error' AND k < 25) THEN NULL ELSE user_id END AS key_id
FROM act""")
def decode_debezium(spark, sf):
    return debezium.decode(i.debezium_log(spark, sf)).select(
        "offset", "readable", "op", "event_ms",
        cell("after", "id", T.LongType()).alias("after_id"),
        cell("after", "event", T.StringType()).alias("after_event"),
        cell("before", "id", T.LongType()).alias("before_id"),
        cell("key_row", "id", T.LongType()).alias("key_id"),
    )


@query("cdc_event_time", "WITH " + i.log_sql() + """
SELECT CAST(make_timestamp(event_ms * 1000) + INTERVAL 8 HOUR AS DATE)::VARCHAR AS event_date, count(*) AS n,
  min(event_ms) AS first_ms, max(event_ms) AS last_ms FROM act GROUP BY 1""")
def event_time(spark, sf):
    dated = bronze.with_event_date(debezium.decode(i.debezium_log(spark, sf)))
    return dated.groupBy("event_date").agg(
        F.count("*").alias("n"), F.min("event_ms").alias("first_ms"), F.max("event_ms").alias("last_ms")
    )


@query("cdc_day_window", "WITH " + i.log_sql() + f"""
SELECT event_id AS "offset", event_ms FROM act WHERE event_ms >= {DAY_MS[0]} AND event_ms < {DAY_MS[1]}""")
def day_window(spark, sf):
    decoded = debezium.decode(i.debezium_log(spark, sf))
    return decoded.where(in_day(F.col("event_ms"), DAY)).select("offset", "event_ms")


COUNTED = ("bad_message", "out_of_window", "unknown_op", "no_after", "upsert", "delete", "truncate")


@query("cdc_action_stats", "WITH " + i.log_sql(truncates=True) + f""",
win AS (SELECT CASE WHEN NOT readable THEN 'bad_message'
  WHEN event_ms < {DAY_MS[0]} OR event_ms >= {DAY_MS[1]} THEN 'out_of_window' ELSE action END AS action FROM act)
SELECT count(*) AS consumed, {", ".join(f"count(*) FILTER (action = '{a}') AS {a}" for a in COUNTED)} FROM win""")
def action_stats(spark, sf):
    decoded = debezium.decode(i.debezium_log(spark, sf, truncates=True))
    return ch.action_counts(debezium.classify(decoded, in_day(F.col("event_ms"), DAY), ["id"]))


@query("cdc_topic_routing", """
SELECT 'shop.public.' || event_type AS topic,
  CASE WHEN event_type = 'click' THEN 'mart' ELSE 'lake' END AS target_database,
  CASE event_type WHEN 'click' THEN 'clicks' WHEN 'view' THEN 'page_views' ELSE event_type END AS target_table,
  CASE event_type WHEN 'click' THEN 'user_id,event_id' WHEN 'view' THEN 'event_id' ELSE '' END AS primary_keys,
  count(*) AS records
FROM events GROUP BY event_type""")
def topic_routing(spark, sf):
    records = i.events(spark, sf).select(F.concat(F.lit("shop.public."), "event_type").alias("topic"))
    routes = spark.createDataFrame(
        [("shop.public.click", "mart", "clicks", ["user_id", "event_id"]),
         ("shop.public.view", "", "page_views", ["event_id"])],
        "topic string, database string, table_name string, primary_keys array<string>",
    )
    routed = ch.route_topics(records, routes, "lake")
    return routed.groupBy(
        "topic", "target_database", "target_table", F.array_join("primary_keys", ",").alias("primary_keys")
    ).agg(F.count("*").alias("records"))


@query("cdc_delete_keys", "WITH " + i.log_sql() + """
SELECT event_id AS "offset", user_id AS id, CASE WHEN k < 25 THEN 'before' ELSE 'key' END AS key_from
FROM act WHERE action = 'delete'""")
def delete_keys(spark, sf):
    decoded = debezium.decode(i.debezium_log(spark, sf))
    deletes = debezium.classify(decoded, keys=["id"]).where(F.col("action") == "delete")
    return deletes.select(
        "offset", cell("row", "id", T.LongType()).alias("id"),
        F.when(F.col("key_row").isNotNull(), "key").otherwise("before").alias("key_from"),
    )


@query("cdc_numeric_guard", "WITH " + i.log_sql() + """
SELECT event_id AS "offset", price AS price_text, k NOT IN (31, 32, 33, 34) AS accepted,
  CASE WHEN k NOT IN (31, 32, 33, 34) THEN CAST(CAST(price AS DECIMAL(10,2)) AS VARCHAR) END AS price
FROM guarded WHERE action = 'upsert'""")
def numeric_guard(spark, sf):
    upserts = classified(spark, sf).where(F.col("action") == "upsert")
    text = typed(F.col("row.price"), T.StringType())
    return upserts.select("offset", text.alias("price_text")).select(
        "offset", "price_text",
        is_unsigned_number(F.col("price_text")).alias("accepted"),
        F.when(is_unsigned_number(F.col("price_text")), F.col("price_text").try_cast("decimal(10,2)"))
        .cast("string").alias("price"),
    )


@query("cdc_local_time", "WITH " + i.EVENTS_SQL + """
SELECT event_id AS "offset", strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS seen_at FROM ev""")
def local_times(spark, sf):
    return i.events(spark, sf).select(F.col("event_id").alias("offset"), local_time(F.col("ts")).alias("seen_at"))


@query("cdc_value_normalise", "WITH " + i.log_sql() + """
SELECT event_id AS "offset", CASE WHEN k >= 50 THEN '1' ELSE '0' END AS vip, '{"k":' || k || '}' AS tags,
  CASE WHEN k = 34 THEN NULL ELSE price END AS price FROM guarded WHERE action = 'upsert'""")
def value_normalise(spark, sf):
    upserts = classified(spark, sf).where(F.col("action") == "upsert")
    text = T.StringType()
    return upserts.select("offset", *[typed(F.col(f"row.{c}"), text).alias(c) for c in ("vip", "tags", "price")])


@query("cdc_bad_messages", "WITH " + i.log_sql() + """
SELECT event_id AS "offset", action, CASE WHEN NOT readable THEN 'not a JSON object'
  WHEN action = 'bad_message' THEN 'delete without a key' ELSE action END AS reason
FROM act WHERE action NOT IN ('upsert', 'delete', 'truncate')""")
def bad_messages(spark, sf):
    rows = classified(spark, sf).where(~F.col("action").isin("upsert", "delete", "truncate"))
    return rows.select("offset", "action", "reason")


STATE = """
newest AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM kept
    WHERE applied IN ('upsert', 'delete')) WHERE rn = 1)
"""
VISIBLE = """
SELECT user_id AS id, event_type AS event, CAST(CAST(price AS DECIMAL(10,2)) AS VARCHAR) AS price, k,
  CASE WHEN k >= 50 THEN '1' ELSE '0' END AS vip, '{"k":' || k || '}' AS tags,
  strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS seen_at
FROM newest WHERE applied = 'upsert'"""
APPLIED = "WITH " + i.log_sql() + ", kept AS (SELECT * FROM guarded)," + STATE
IN_DAY = (
    "WITH " + i.log_sql()
    + f", kept AS (SELECT * FROM guarded WHERE event_ms >= {DAY_MS[0]} AND event_ms < {DAY_MS[2]})," + STATE
)


def state(spark, sf, route=ROUTE, **log):
    return replayed(i.debezium_log(spark, sf, **log), route)


def replayed(raw, route):
    """State after a whole log; its truncates are looked for in the few texts that may hold one."""
    suspects = streaming.decode(raw.where(debezium.may_truncate(F.col("value"))), route)
    epoch = ch.truncate_epoch(ch.project(suspects, route))
    return ch.latest(ch.project(streaming.decode(raw, route), route), list(route.keys), route.values, epoch, route.whole_images)


@query("cdc_apply_latest", APPLIED + VISIBLE)
def apply_latest(spark, sf):
    return shown(ch.visible(state(spark, sf)))


@query("cdc_deleted_keys", APPLIED + "SELECT user_id AS id FROM newest WHERE applied = 'delete'")
def deleted_keys(spark, sf):
    return state(spark, sf).where("_deleted").select("id")


@query("cdc_truncate_epoch", "WITH " + i.log_sql(truncates=True) + """,
epoch AS (SELECT max((event_ms, user_id % 8, event_id)) AS e FROM guarded WHERE applied = 'truncate'),
kept AS (SELECT g.* FROM guarded g, epoch WHERE e IS NULL OR (event_ms, user_id % 8, event_id) > e),
""" + STATE + VISIBLE)
def truncate_epoch(spark, sf):
    return shown(ch.visible(state(spark, sf, truncates=True)))


# every column keeps the newest value an image carried; a delete carries nothing but nulls
PARTIAL_SQL = "WITH " + i.log_sql() + """,
img AS (
  SELECT *, action = 'delete' AS gone, event_type = 'click' AS is_click,
    event_type = 'purchase' AND k < 30 AS is_short FROM act WHERE action IN ('upsert', 'delete')),
typed AS (SELECT *, CASE WHEN k = 31 THEN '-1.50' WHEN k = 32 THEN '1000.00' WHEN k = 33 THEN '3.00'
    WHEN k = 34 THEN NULL WHEN k = 35 THEN '1.01' ELSE amount END AS price FROM img),
folded AS (
  SELECT user_id AS id, arg_max(gone, event_id) AS gone,
    arg_max(struct_pack(v := CASE WHEN NOT gone AND NOT is_short THEN event_type END), event_id)
      FILTER (gone OR NOT is_click).v AS event,
    arg_max(struct_pack(v := CASE WHEN gone THEN NULL WHEN is_click THEN amount ELSE price END), event_id)
      FILTER (gone OR NOT is_short).v AS price,
    arg_max(struct_pack(v := CASE WHEN NOT gone THEN k END), event_id) FILTER (gone OR NOT is_click).v AS k,
    arg_max(struct_pack(v := CASE WHEN NOT gone THEN CASE WHEN k >= 50 THEN '1' ELSE '0' END END), event_id)
      FILTER (gone OR NOT (is_click OR is_short)).v AS vip,
    arg_max(struct_pack(v := CASE WHEN NOT gone THEN '{"k":' || k || '}' END), event_id)
      FILTER (gone OR NOT (is_click OR is_short)).v AS tags,
    arg_max(struct_pack(v := CASE WHEN NOT gone THEN strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S.%f') END), event_id)
      FILTER (gone OR NOT (is_click OR is_short)).v AS seen_at
  FROM typed GROUP BY user_id)
SELECT id, event, price, k, vip, tags, seen_at FROM folded WHERE NOT gone"""


@query("cdc_partial_update", PARTIAL_SQL)
def partial_update(spark, sf):
    return shown(ch.visible(state(spark, sf, PARTIAL, partial=True)))


@query("cdc_replay_from_ts", "WITH " + i.log_sql()
       + f", kept AS (SELECT * FROM guarded WHERE ms + 2000 >= {REPLAY_MS})," + STATE + VISIBLE)
def replay_from_ts(spark, sf):
    raw = bronze.since(i.debezium_log(spark, sf), REPLAY_MS)
    return shown(ch.visible(replayed(raw, ROUTE)))


@query("cdc_decode_canal", "WITH " + i.CANAL_SQL + """
SELECT event_id AS "offset", position, action, id, name, age FROM cells""")
def decode_canal(spark, sf):
    rows = canal.classify(canal.decode(i.canal_log(spark, sf), CANAL_SCHEMA.fieldNames()), ["id"]).where(F.col("readable"))
    return rows.select(
        "offset", F.col("position").cast("int").alias("position"), "action",
        typed(F.col("row.id"), T.LongType()).alias("id"),
        typed(F.col("row.name"), T.StringType()).alias("name"),
        typed(F.col("row.age"), T.StringType()).alias("age"),
    )


CANAL_STATE = "WITH " + i.CANAL_SQL + """,
usable AS (SELECT * FROM cells WHERE NOT (action = 'upsert' AND age = 'old')),
newest AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_id DESC, position DESC) AS rn FROM usable)
SELECT id, name, CAST(age AS INTEGER) AS age FROM newest WHERE rn = 1 AND action = 'upsert'"""


@query("cdc_apply_canal", CANAL_STATE)
def apply_canal(spark, sf):
    changes = ch.project(streaming.decode(i.canal_log(spark, sf), CANAL_ROUTE), CANAL_ROUTE)
    return ch.visible(ch.latest(changes, ["id"], CANAL_ROUTE.values))


# ----------------------------------------------------------- end to end on files


@query("cdc_apply_day", IN_DAY + VISIBLE)
def apply_two_days(spark, sf):
    """Bronze by event date, the day job for two days, and the target table as its readers see it."""
    root = scratch_path(spark, "apply-day")
    bronze.append(debezium.decode(i.debezium_log(spark, sf)), f"{root}/bronze")
    for day in (DAY, NEXT_DAY):
        apply_day.run(spark, f"{root}/bronze", [ROUTE], f"{root}/target", day)
    return shown(KeyedTable(spark, f"{root}/target/accounts", ROUTE).read())


PARTS = 3
# where a log in three parts is cut
CUT_SQL = f"(SELECT max(event_id) // {PARTS} + 1 FROM events)"


class Live:
    """A log that arrives in bronze part by part, and streams that read it."""

    def __init__(self, spark, raw, route):
        self.spark, self.root, self.route = spark, scratch_path(spark, "stream"), route
        raw.write.parquet(f"{self.root}/whole")
        self.whole = spark.read.schema(bronze.RAW_SCHEMA).parquet(f"{self.root}/whole")
        self.step = self.whole.agg(F.max("offset")).first()[0] // PARTS + 1

    def arrive(self, part):
        rows = self.whole.where((F.col("offset") >= part * self.step) & (F.col("offset") < (part + 1) * self.step))
        if self.route.change_format == "canal":  # its messages carry no time of their own
            dated = rows.withColumn("event_ms", F.unix_millis("timestamp"))
        else:
            dated = debezium.with_event_time(rows)
        bronze.append(dated, f"{self.root}/bronze")

    def table(self, route=None):
        return KeyedTable(self.spark, f"{self.root}/target", route or self.route)

    def start(self, checkpoint="checkpoint", drain=True, interval="0 seconds", route=None, startup="earliest", timestamp_ms=None, **policy):
        path = f"{self.root}/{checkpoint}"
        rows = bronze.table_stream(self.spark, f"{self.root}/bronze", None, startup, timestamp_ms, path)
        return streaming.start(rows, self.table(route), path, drain, interval, **{"skip_bad": True} | policy)

    def run(self, **options):
        self.start(**options).awaitTermination()


def _stream(spark, raw, route, **policy):
    """The stream is started anew for every part that has arrived."""
    live = Live(spark, raw, route)
    for part in range(PARTS):
        live.arrive(part)
        live.run(**policy)
    return live.table()


@query("stream_debezium_apply", APPLIED + VISIBLE)
def stream_debezium(spark, sf):
    return shown(_stream(spark, i.debezium_log(spark, sf), ROUTE).read())


@query("stream_debezium_partial", PARTIAL_SQL)
def stream_partial(spark, sf):
    log = i.debezium_log(spark, sf, partial=True)
    return shown(_stream(spark, log, PARTIAL, compact_every=1).read())


@query("stream_canal_apply", CANAL_STATE)
def stream_canal(spark, sf):
    return _stream(spark, i.canal_log(spark, sf), CANAL_ROUTE).read()


@query("stream_quarantine", "WITH " + i.log_sql() + """
SELECT count(*) AS rows, applied AS action FROM guarded WHERE applied NOT IN ('upsert', 'delete') GROUP BY applied""")
def stream_quarantine(spark, sf):
    rejected = _stream(spark, i.debezium_log(spark, sf), ROUTE).quarantine()
    return rejected.groupBy(F.col(ch.ACTION).alias("action")).agg(F.count("*").alias("rows"))


@query("stream_second_checkpoint", "WITH " + i.log_sql()
       + f", kept AS (SELECT * FROM guarded WHERE event_id < {CUT_SQL} OR ms + 2000 >= {REPLAY_MS})," + STATE + VISIBLE)
def stream_second_checkpoint(spark, sf):
    """A stream with another checkpoint, from a record time on, beside what the first has written and no fold has."""
    live = Live(spark, i.debezium_log(spark, sf), ROUTE)
    live.arrive(0)
    live.run()
    for part in range(1, PARTS):
        live.arrive(part)
    live.run(checkpoint="another", startup="timestamp", timestamp_ms=REPLAY_MS)
    return shown(live.table().read())


@query("stream_startup_latest", "WITH " + i.log_sql()
       + f", kept AS (SELECT * FROM guarded WHERE event_id >= {CUT_SQL})," + STATE + VISIBLE)
def stream_startup_latest(spark, sf):
    """Started at the latest record; the second part arrives while the stream is down."""
    live = Live(spark, i.debezium_log(spark, sf), ROUTE)
    live.arrive(0)
    live.run(startup="latest")
    for part in range(1, PARTS):
        live.arrive(part)
        live.run(startup="latest")
    return shown(live.table().read())


@query("stream_drain_idle", APPLIED + VISIBLE)
def stream_drain_idle(spark, sf):
    """A continuous stream that is stopped when nothing has come for a second."""
    live = Live(spark, i.debezium_log(spark, sf), ROUTE)
    for part in range(PARTS):
        live.arrive(part)
    drained = control.drain(live.start(drain=False), idle=1.0, longest=600.0)
    if drained.reason != "idle":
        raise RuntimeError(f"the drain ended by {drained.reason}")
    return shown(live.table().read())


def _schema(*without):
    return T.StructType([f for f in SCHEMA.fields if f.name not in without])


EARLY = Route(i.TOPIC, "accounts", ("id",), _schema("tags"), guarded=("price",), local_times=("seen_at",))
LATE = Route(i.TOPIC, "accounts", ("id",), SCHEMA, guarded=("price",), local_times=("seen_at",))
# a row that changed last before its table had the column, or was deleted since, has none
TAGGED_LATE = "WITH " + i.log_sql() + ", kept AS (SELECT * FROM guarded)," + STATE + VISIBLE.replace(
    "'{\"k\":' || k || '}' AS tags", f"CASE WHEN event_id >= {CUT_SQL} THEN '{{\"k\":' || k || '}}' END AS tags"
)


def _catalog(spark, names, types):
    rows = [("shop", "public", "accounts", n, k + 1, types[n][0], types[n][1], None, True, None, None, None, "") for k, n in enumerate(names)]
    return spark.createDataFrame(rows, COLUMNS_DDL)


@query("stream_drift_repair", TAGGED_LATE)
def stream_drift_repair(spark, sf):
    """The source gets a column while the stream runs: the guard stops the batch, the target is evolved, the stream reads on."""
    raw = i.debezium_log(spark, sf)
    cut = raw.agg(F.max("offset")).first()[0] // PARTS + 1
    bare = F.regexp_replace("value", r',"tags":\{"k":[0-9]+\}', "")
    live = Live(spark, raw.withColumn("value", F.when(F.col("offset") < cut, bare).otherwise(F.col("value"))), EARLY)
    arrived = lambda: spark.read.schema(bronze.TABLE_SCHEMA).parquet(f"{live.root}/bronze")
    now = {"route": EARLY, "types": {f.name: "text" for f in EARLY.schema.fields}}

    def source():
        tagged = not arrived().where(F.col("value").contains('"tags"')).isEmpty()
        names = (LATE if tagged else EARLY).schema.fieldNames()
        return _catalog(spark, names, dict.fromkeys(names, ("text", "text")))

    def target():
        mapped = schema.match_columns(source(), source().limit(0)).select("name", "mapped_type").collect()
        kinds = {r.name: r.mapped_type for r in mapped}
        return _catalog(spark, now["route"].schema.fieldNames(), {n: (k, k) for n, k in kinds.items()})

    def evolve(plan):
        added = {r.column_name for r in plan.where("action = 'add'").collect()}
        now["route"] = dataclasses.replace(EARLY, schema=_schema(*({"tags"} - added)))

    def declared():
        names = now["route"].schema.fieldNames()
        return _catalog(spark, names, dict.fromkeys(names, ("text", "text")))

    def start():
        return live.start(route=now["route"], before=drift.guard(declared(), source, "debezium"))

    def mend(query):
        return repair.repair(query, declared(), source, target, evolve, start, "debezium")

    changed = lambda: not drift.check(declared(), source(), "debezium").isEmpty()
    steps = []
    for part in range(PARTS):
        live.arrive(part)
        steps += repair.supervise(start, mend, changed).steps
    if steps != ["stopped", "evolved", "resumed"]:
        raise RuntimeError(f"unexpected repair: {steps}")
    return shown(live.table(now["route"]).read())


NARROW = Route(i.TOPIC, "accounts", ("id",), T.StructType(
    [T.StructField("id", T.IntegerType()), *_schema("id", "tags").fields]), guarded=("price",), local_times=("seen_at",))


@query("stream_schema_change", TAGGED_LATE)
def stream_schema_change(spark, sf):
    """Restarted on its checkpoint with one more column and a wider key; files of both kinds are read together."""
    live = Live(spark, i.debezium_log(spark, sf), NARROW)
    live.arrive(0)
    live.run(compact_every=1)
    for part in range(1, PARTS):
        live.arrive(part)
        live.run(route=LATE, compact_every=None)
    return shown(live.table(LATE).read())
