"""Typed changes and their fold into the latest state per key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.functions.images import is_given, raw_cell, typed
from tidegate.functions.values import DEFAULT_ZONE, computed_once, is_unsigned_number, local_time

# Where a change stands: per key by log position and offset, against a truncate by time as
# well because offsets of different partitions do not compare.
ORDER = "_order"
ACTION = "_action"
ORDER_TYPE = "struct<lsn:bigint,offset:bigint,position:int,event_ms:bigint,partition:int>"
EPOCH_TYPE = "struct<lsn:bigint,event_ms:bigint,partition:int,offset:bigint>"


@dataclass(frozen=True)
class Route:
    """Which target a topic feeds, its key, its columns and how single cells are shaped."""

    topic: str
    table: str
    keys: tuple[str, ...]
    schema: T.StructType
    database: str = ""
    zone: str = DEFAULT_ZONE
    guarded: tuple[str, ...] = ()
    local_times: tuple[str, ...] = ()
    change_format: str = field(default="debezium")
    # every upsert carries every column: one comparison finds the row, and an image that lacks some is rejected
    whole_images: bool = False

    @property
    def values(self) -> list[str]:
        return [f.name for f in self.schema.fields if f.name not in self.keys]


def route_topics(raw: DataFrame, routes: DataFrame, default_database: str) -> DataFrame:
    """Target database, table and key per record; unlisted topics go by their last segment.

    Spark broadcasts the routing table when its size allows and shuffles it otherwise.
    """
    listed = routes.select(
        "topic",
        F.col("database").alias("_database"),
        F.col("table_name").alias("_table"),
        F.col("primary_keys").alias("_keys"),
    )
    return (
        raw.join(listed, "topic", "left")
        .withColumn("target_database", F.coalesce(F.nullif("_database", F.lit("")), F.lit(default_database)))
        .withColumn("target_table", F.coalesce(F.nullif("_table", F.lit("")), F.element_at(F.split("topic", r"\."), -1)))
        .withColumn("primary_keys", F.coalesce("_keys", F.array().cast("array<string>")))
        .drop("_database", "_table", "_keys")
    )


def order_of(columns: Sequence[str]) -> Column:
    position = F.col("position").cast("int") if "position" in columns else F.lit(0)
    return F.struct(
        F.col("lsn"), F.col("offset"), position.alias("position"), F.col("event_ms"), F.col("partition")
    )


def project(classified: DataFrame, route: Route) -> DataFrame:
    """Typed change rows: keys, one ``{value, present}`` struct per column, action, order.

    A cell that does not fit its type, or a guarded column that is not a plain number, turns
    the change into a rejected one; so an older valid version of the row stays.
    """
    kind = classified.schema["row"].dataType
    cells: dict[str, Column] = {}
    for f in route.schema.fields:
        raw = raw_cell(F.col("row"), f.name, kind)
        if f.name in route.local_times:
            value = local_time(typed(raw, T.TimestampType()), route.zone)
        else:
            value = typed(raw, f.dataType)
        cells[f"_v_{f.name}"] = value
        cells[f"_p_{f.name}"] = raw.isNotNull()
        cells[f"_g_{f.name}"] = is_given(raw)
        if f.name in route.guarded:
            cells[f"_n_{f.name}"] = is_unsigned_number(F.try_variant_get(raw, "$", "string"))
    is_upsert, is_row = F.col("action") == "upsert", F.col("action").isin("upsert", "delete")
    problems: list[Column] = []
    columns: list[Column] = []
    for f in route.schema.fields:
        value, given = F.col(f"_v_{f.name}"), F.col(f"_g_{f.name}")
        is_key = f.name in route.keys
        if f.name in route.guarded:
            problems.append(F.when(is_upsert & ~F.col(f"_n_{f.name}"), f"{f.name}: not a plain number"))
        problems.append(F.when((is_row if is_key else is_upsert) & given & value.isNull(), f"{f.name}: does not fit"))
        if is_key:
            problems.append(F.when(is_row & ~given, f"{f.name}: key is missing"))
            columns.append(value.alias(f.name))
        else:
            present = F.col(f"_p_{f.name}")
            if route.whole_images:
                problems.append(F.when(is_upsert & ~present, f"{f.name}: not in the image"))
            columns.append(F.struct(value.alias("value"), present.alias("present")).alias(f.name))
    problem = F.nullif(F.col("_problem"), F.lit(""))
    applied = F.col("action").isin("upsert", "delete", "truncate")
    kept = applied & problem.isNull()
    # the problems are asked for in every column below
    checked = computed_once(computed_once(classified, **cells), _problem=F.concat_ws("; ", *problems))
    return checked.select(
        *columns,
        F.when(applied & problem.isNotNull(), "rejected").otherwise(F.col("action")).alias(ACTION),
        F.coalesce("reason", F.when(applied, problem)).alias("_reason"),
        order_of(classified.columns).alias(ORDER),
        # raw text only where someone has to look at it
        *[F.when(~kept, F.col(c)).alias(f"_raw_{c}") for c in ("topic", "key", "value")],
    )


def _against_truncate(order: Column) -> Column:
    return F.struct(order["lsn"], order["event_ms"], order["partition"], order["offset"])


def truncate_epoch(changes: DataFrame) -> Column:
    """Order of the last truncate as a scalar subquery: one value, whatever the log's size."""
    last = changes.where(F.col(ACTION) == "truncate").agg(F.max(_against_truncate(F.col(ORDER))))
    return last.scalar()


def after_truncate(changes: DataFrame, epoch: Column) -> DataFrame:
    return changes.where(F.coalesce(_against_truncate(F.col(ORDER)) > epoch, F.lit(True)))


def fold(changes: DataFrame, keys: Sequence[str], values: Sequence[str], whole: bool = False) -> DataFrame:
    """Latest change per key as one aggregate with map-side combine.

    Per column the newest change that carries it wins, so partial upserts leave other columns
    alone. A delete carries every column as NULL: what comes after it starts afresh. With ``whole``
    images the newest change has all columns, and is found by one comparison.
    """
    # a condition inside the aggregate, not a filter: the cells are computed once
    applied = F.col(ACTION).isin("upsert", "delete")
    order = F.when(applied, F.col(ORDER))
    deleted = F.col(ACTION) == "delete"
    if whole:
        row = F.struct(*[F.when(~deleted, F.col(v)["value"]).alias(v) for v in values], deleted.alias("_deleted"), order.alias(ORDER))
        latest_rows = changes.groupBy(*keys).agg(F.max_by(row, order).alias("row")).where(F.col("row").isNotNull())
        cells = [F.struct(F.col(f"row.{v}").alias("value"), F.col(f"row.{ORDER}").alias("at")).alias(v) for v in values]
        return latest_rows.select(*keys, *cells, "row._deleted", f"row.{ORDER}")
    folded: list[Column] = []
    for name in values:
        carried = F.when(F.col(name)["present"] | deleted, order)
        value = F.when(~deleted, F.col(name)["value"])
        folded.append(F.max_by(F.struct(value.alias("value"), order.alias("at")), carried).alias(name))
    latest_rows = changes.groupBy(*keys).agg(
        *folded,
        F.max_by(deleted, order).alias("_deleted"),
        F.max(order).alias(ORDER),
    )
    return latest_rows.where(F.col(ORDER).isNotNull())


def flatten(folded: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Folded changes as plain rows."""
    return folded.select(*keys, *[F.col(v)["value"].alias(v) for v in values], "_deleted", ORDER)


def latest(
    changes: DataFrame, keys: Sequence[str], values: Sequence[str], epoch: Column | None = None, whole: bool = False
) -> DataFrame:
    """State rows that a whole change log leaves, tombstones included.

    ``epoch`` comes from ``truncate_epoch``; formats without truncates need none.
    """
    kept = changes if epoch is None else after_truncate(changes, epoch)
    return flatten(fold(kept, keys, values, whole), keys, values)


def merge(
    base: DataFrame, changes: DataFrame, keys: Sequence[str], values: Sequence[str], epoch: Column, whole: bool = False
) -> DataFrame:
    """A keyed state advanced by a change log that follows it.

    The changes are folded first, so the join has one row per key on each side. A change at or
    before a row's order was already applied.
    """
    state = after_truncate(base, epoch)
    news = fold(after_truncate(changes, epoch), keys, values, whole)
    old, new = state.alias("old"), news.alias("new")
    joined = old.join(new, list(keys), "full_outer")
    newer = lambda order: F.col(f"old.{ORDER}").isNull() | (order > F.col(f"old.{ORDER}"))
    # NULL order: the fold holds nothing for this column or key
    wins = lambda order: F.coalesce(newer(order), F.lit(False)) & order.isNotNull()
    columns = [
        F.when(wins(F.col(f"new.{v}")["at"]), F.col(f"new.{v}")["value"]).otherwise(F.col(f"old.{v}")).alias(v)
        for v in values
    ]
    row_wins = wins(F.col(f"new.{ORDER}"))
    return joined.select(
        *keys,
        *columns,
        F.when(row_wins, F.col("new._deleted")).otherwise(F.col("old._deleted")).alias("_deleted"),
        F.when(row_wins, F.col(f"new.{ORDER}")).otherwise(F.col(f"old.{ORDER}")).alias(ORDER),
    )


def visible(state: DataFrame) -> DataFrame:
    """Rows a reader of the target sees."""
    return state.where(~F.col("_deleted")).drop("_deleted", ORDER)


# What a run counts besides everything it consumed.
COUNTED = ("bad_message", "out_of_window", "unknown_op", "no_after", "upsert", "delete", "truncate")


def counters(action: str, extra: Sequence[str] = ()) -> list[Column]:
    """Aggregates over the named action column, for ``agg`` or for ``observe``."""
    return [
        F.count("*").alias("consumed"),
        *[F.count_if(F.col(action) == name).alias(name) for name in (*COUNTED, *extra)],
    ]


def action_counts(classified: DataFrame) -> DataFrame:
    """Counters of a run: everything consumed, and each action."""
    return classified.agg(*counters("action"))
