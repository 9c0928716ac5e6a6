"""Compare, gate, plan and conform table structures.

Inputs are column catalogs: one row per column, unique on ``keys + (name,)``. A table's
columns are bounded by every database vendor (a few thousand at most), so per-table
windows and lists stay small however many tables the catalog holds.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.functions.defaults import default_value
from tidegate.functions.typemap import change_types, normalise_type, squeeze_type, store_type

# What a table is known by: one name may stand in several schemas and databases. Callers whose sides
# lie in different databases compare by fewer columns.
TABLE = ("database", "schema_name", "table_name")


def _shaped(columns: DataFrame, keys: Sequence[str], side: str, *compared: Column) -> DataFrame:
    return columns.select(
        *keys,
        "name",
        F.lit(True).alias(f"{side}_present"),
        F.col("ordinal_position").alias(f"{side}_position"),
        F.col("column_type").alias(f"{side}_type"),
        F.col("is_nullable").alias(f"{side}_nullable"),
        *compared,
    )


def match_columns(
    source: DataFrame, target: DataFrame, source_type: str = "mysql", mode: str = "check",
    keys: Sequence[str] = TABLE,
) -> DataFrame:
    """Both column sets side by side with ``missing, extra, type_differs, nullable_differs``.

    ``check`` and ``sync`` compare the mapped source type with the target's type text,
    ``normalised`` compares base types. Only ``sync`` counts nullability as a modification.
    """
    if mode not in ("check", "sync", "normalised"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "normalised":
        of_source = of_target = normalise_type(F.col("data_type"))
    else:
        of_source, of_target = squeeze_type(store_type(source_type)), squeeze_type(F.col("column_type"))
    left = _shaped(
        source, keys, "source", of_source.alias("source_compared"), store_type(source_type).alias("mapped_type")
    )
    right = _shaped(target, keys, "target", of_target.alias("target_compared"))
    both = F.col("source_present") & F.col("target_present")
    return (
        left.join(right, [*keys, "name"], "full_outer")
        .withColumn("source_present", F.coalesce("source_present", F.lit(False)))
        .withColumn("target_present", F.coalesce("target_present", F.lit(False)))
        .withColumn("missing", F.col("source_present") & ~F.col("target_present"))
        .withColumn("extra", F.col("target_present") & ~F.col("source_present"))
        .withColumn(
            "type_differs", both & ~F.col("source_compared").eqNullSafe(F.col("target_compared"))
        )
        .withColumn(
            "nullable_differs", both & ~F.col("source_nullable").eqNullSafe(F.col("target_nullable"))
        )
        .withColumn(
            "modify",
            F.col("type_differs") | (F.col("nullable_differs") if mode == "sync" else F.lit(False)),
        )
    )


def diff(
    source: DataFrame, target: DataFrame, source_type: str = "mysql", mode: str = "check",
    keys: Sequence[str] = TABLE,
) -> DataFrame:
    """One row per finding: level ``difference`` or ``warning``, its kind and both types."""
    finding = lambda flag, level, kind: F.when(
        F.col(flag), F.struct(F.lit(level).alias("level"), F.lit(kind).alias("change"))
    )
    nullable_level = "difference" if mode == "sync" else "warning"
    findings = F.array_compact(
        F.array(
            finding("missing", "difference", "missing_in_target"),
            finding("extra", "difference", "extra_in_target"),
            finding("type_differs", "difference", "type_mismatch"),
            finding("nullable_differs", nullable_level, "nullable_different"),
        )
    )
    return (
        match_columns(source, target, source_type, mode, keys)
        .select(*keys, "name", "source_type", "target_type", F.explode(findings).alias("f"))
        .select(*keys, "name", "f.level", "f.change", "source_type", "target_type")
    )


def gate(
    source: DataFrame, target: DataFrame, source_type: str = "mysql", mode: str = "check",
    keys: Sequence[str] = TABLE,
) -> DataFrame:
    """Verdict per table: consistent only when no column differs and the target exists."""
    matched = match_columns(source, target, source_type, mode, keys)
    differs = F.col("missing") | F.col("extra") | F.col("modify")
    moved = ~F.col("source_position").eqNullSafe(F.col("target_position"))
    counts = matched.groupBy(*keys).agg(
        F.count_if("source_present").alias("source_columns"),
        F.count_if("target_present").alias("target_columns"),
        F.count_if(differs).alias("differences"),
        F.count_if("nullable_differs").alias("nullable_warnings"),
        F.bool_or(moved).alias("order_differs"),
    )
    return counts.select(
        *keys,
        "source_columns",
        "target_columns",
        "differences",
        "nullable_warnings",
        "order_differs",
        (F.col("target_columns") == 0).alias("table_missing"),
        (F.col("differences") == 0).alias("consistent"),
    )


def all_consistent(verdicts: DataFrame) -> DataFrame:
    """One row: may the load run for every table?"""
    return verdicts.agg(
        F.coalesce(F.bool_and("consistent"), F.lit(True)).alias("consistent"),
        F.count("*").alias("tables"),
        F.count_if(~F.col("consistent")).alias("blocked"),
    )


def signature(columns: DataFrame, change_format: str, keys: Sequence[str] = TABLE) -> DataFrame:
    """md5 over the ordered JSON list of column names and stream types, per table."""
    escaped = F.regexp_replace("name", r'(["\\])', r"\\$1")
    entry = F.concat(
        F.lit('{"flink_type": "'), change_types(change_format)["read_type"],
        F.lit('", "name": "'), escaped, F.lit('"}'),
    )
    ordered = F.array_sort(F.collect_list(F.struct("ordinal_position", "entry")))
    texts = F.transform(F.col("ordered"), lambda e: e["entry"])
    return (
        columns.select(*keys, "ordinal_position", entry.alias("entry"))
        .groupBy(*keys)
        .agg(ordered.alias("ordered"), F.count("*").alias("column_count"))
        .select(
            *keys,
            "column_count",
            F.md5(F.concat(F.lit("["), F.array_join(texts, ", "), F.lit("]"))).alias("signature"),
        )
    )


def drift(
    declared: DataFrame, current: DataFrame, change_format: str, keys: Sequence[str] = TABLE
) -> DataFrame:
    """Columns added, dropped or retyped since the running stream was declared."""
    read_type = change_types(change_format)["read_type"]
    old = declared.select(*keys, "name", read_type.alias("old_type"))
    new = current.select(*keys, "name", read_type.alias("new_type"))
    return (
        old.join(new, [*keys, "name"], "full_outer")
        .where(~F.col("old_type").eqNullSafe(F.col("new_type")))
        .select(
            *keys,
            "name",
            F.when(F.col("old_type").isNull(), "add")
            .when(F.col("new_type").isNull(), "drop")
            .otherwise("modify")
            .alias("change"),
            "old_type",
            "new_type",
        )
    )


def plan(
    source: DataFrame, target: DataFrame, primary_keys: DataFrame, source_type: str = "mysql",
    drop_columns: bool = True, auto_create: bool = True, keys: Sequence[str] = TABLE,
) -> DataFrame:
    """Alignment actions, one row each: create, add, drop, modify, or a bare warning.

    ``primary_keys`` holds ``keys`` (or fewer, where they tell its tables apart) and
    ``column_names ARRAY<STRING>``. A table that is missing
    in the target yields one create row keyed by its primary key, else by its first column.
    """
    table = Window.partitionBy(*keys)
    known = [k for k in keys if k in primary_keys.columns]
    absent = ~F.max("target_present").over(table)
    first = F.col("source_position") == F.min("source_position").over(table)
    matched = (
        match_columns(source, target, source_type, "sync", keys)
        .withColumn("absent", absent)
        .withColumn("first", first)
        .where(F.when(F.col("absent"), F.col("first")).otherwise(F.col("missing") | F.col("extra") | F.col("modify")))
        .join(primary_keys.select(*known, F.col("column_names").alias("pk")), known, "left")
    )
    unkeyed = F.coalesce(F.size("pk"), F.lit(0)) < 1
    action = (
        F.when(F.col("absent"), F.when(F.lit(auto_create), "create").otherwise("none"))
        .when(F.col("missing"), "add")
        .when(F.col("extra"), F.when(F.lit(drop_columns), "drop").otherwise("none"))
        .otherwise("modify")
    )
    warning = (
        F.when(F.col("absent") & F.lit(not auto_create), "target table is missing, creation is off")
        .when(F.col("absent") & unkeyed, "no primary key, first column is the key")
        .when(F.col("extra") & F.lit(not drop_columns), "extra column kept, drops are off")
    )
    creates = F.col("action") == "create"
    return (
        matched.withColumn("action", action)
        .withColumn("warning", warning)
        .select(
            *keys,
            "action",
            F.when(~F.col("absent"), F.col("name")).alias("column_name"),
            F.when(~F.col("absent"), F.col("target_type")).alias("from_type"),
            F.when(F.col("action").isin("add", "modify"), F.col("mapped_type")).alias("to_type"),
            F.when(creates, F.when(unkeyed, F.array("name")).otherwise(F.col("pk"))).alias("key"),
            "warning",
        )
    )


def named(name: str) -> Column:
    """Rows of a catalog that a name stands for: ``table``, ``schema.table`` or ``database.schema.table``."""
    parts = name.split(".")
    if len(parts) > len(TABLE):
        raise ValueError(f"not a table name: {name!r}")
    same = [F.col(column) == part for column, part in zip(TABLE[-len(parts) :], parts, strict=True)]
    return functools.reduce(lambda x, y: x & y, same)


def names() -> Column:
    """All names that ``named`` takes for a catalog row."""
    return F.array(*[F.concat_ws(".", *TABLE[n:]) for n in range(len(TABLE))])


def default_rows(columns: DataFrame) -> DataFrame:
    """Declared defaults in the form ``conform`` and its callers use."""
    return columns.select(*[c for c in columns.columns], default_value(F.col("column_default")).alias("default"))


def default_column(kind: str, value: str | None, data_type: T.DataType) -> Column:
    """The value an added column takes in rows that never had it."""
    if kind == "now":
        return F.current_timestamp().cast(data_type)
    if kind in ("number", "text"):
        return F.lit(value).try_cast(data_type)
    return F.lit(None).cast(data_type)


def conform(
    df: DataFrame, schema: T.StructType, defaults: Mapping[str, tuple[str, str | None]] | None = None
) -> DataFrame:
    """Rows in the target structure plus ``reject_reason`` (NULL for good rows).

    Missing columns are added with their default, extra columns leave the projection, other
    types are cast; a value the cast would lose, or a NULL in a required column, marks the
    row instead of dropping it.
    """
    defaults = defaults or {}
    present = {f.name: f.dataType for f in df.schema.fields}
    selected: list[Column] = []
    reasons: list[Column] = []
    for field in schema.fields:
        if field.name not in present:
            kind, value = defaults.get(field.name, ("none", None))
            shaped = default_column(kind, value, field.dataType)
        elif present[field.name] == field.dataType:
            shaped = F.col(field.name)
        else:
            shaped = F.col(field.name).try_cast(field.dataType)
            reasons.append(
                F.when(F.col(field.name).isNotNull() & shaped.isNull(), f"{field.name}: cannot be cast")
            )
        if not field.nullable:
            lost = F.col(field.name).isNull() if field.name in present else shaped.isNull()
            reasons.append(F.when(lost, f"{field.name}: required"))
        selected.append(shaped.alias(field.name))
    reason = F.nullif(F.concat_ws("; ", *reasons), F.lit("")) if reasons else F.lit(None).cast("string")
    return df.select(*selected, reason.alias("reject_reason"))


def accepted(conformed: DataFrame) -> DataFrame:
    return conformed.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(conformed: DataFrame) -> DataFrame:
    return conformed.where(F.col("reject_reason").isNotNull())
