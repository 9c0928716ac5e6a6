"""Decode Canal flat JSON: one message carries several rows, cells are text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions.images import carries, image_type, raw_cell
from tidegate.functions.values import computed_once

# Message types.
UPSERT_TYPES = ["INSERT", "UPDATE"]
DELETE_TYPE = "DELETE"


def decode(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per changed row: ``position`` in the message, its ``image`` and the ``old`` cells."""
    image = image_type(columns)
    message = computed_once(
        raw,
        readable=F.json_object_keys("value").isNotNull(),
        _m=F.from_json("value", f"data array<{image}>, old array<{image}>, type string, es bigint, ts bigint"),
    )
    data = F.coalesce(F.col("_m.data"), F.array())
    # old is null on inserts; an empty list keeps the zip aligned with the data
    zipped = F.arrays_zip(data.alias("image"), F.coalesce(F.col("_m.old"), F.array()).alias("old"))
    zero = F.lit(0).cast("bigint")
    return message.select(
        *raw.columns,
        "readable",
        F.col("_m.type").alias("type"),
        F.coalesce(F.nullif("_m.es", zero), F.nullif("_m.ts", zero), F.unix_millis("timestamp")).alias("event_ms"),
        zero.alias("lsn"),
        F.posexplode_outer(zipped).alias("position", "_pair"),
    ).select("*", F.col("_pair.image").alias("image"), F.col("_pair.old").alias("old")).drop("_pair")


def classify(decoded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``action, reason, row``; an update that moves the key also deletes the old key."""
    kind = decoded.schema["image"].dataType
    moved = F.lit(False)
    for name in keys:
        moved = moved | F.coalesce(raw_cell(F.col("old"), name, kind).isNotNull(), F.lit(False))
    action = (
        F.when(~F.col("readable"), "bad_message")
        .when(F.col("image").isNull(), "no_after")
        .when(~carries(F.col("image"), keys, kind), "bad_message")
        .when(F.col("type").isin(UPSERT_TYPES), "upsert")
        .when(F.col("type") == DELETE_TYPE, "delete")
        .otherwise("unknown_op")
    )
    reason = (
        F.when(~F.col("readable"), "not a JSON object")
        .when(F.col("action") == "bad_message", "row without its key")
        .when(~F.col("action").isin("upsert", "delete"), F.col("action"))
    )
    # the old image lists only the cells that changed
    old_key = F.struct(
        *[
            (
                F.coalesce(raw_cell(F.col("old"), n, kind), raw_cell(F.col("image"), n, kind))
                if n in keys
                else F.lit(None).cast("variant")
            ).alias(n)
            for n in kind.fieldNames()
        ]
    )
    itself = F.struct(F.col("action").alias("_action"), F.col("image").alias("_row"), F.lit(1).alias("_step"))
    leaving = F.struct(F.lit("delete").alias("_action"), old_key.alias("_row"), F.lit(0).alias("_step"))
    moves = (F.col("action") == "upsert") & (F.col("type") == "UPDATE") & moved
    steps = F.when(moves, F.array(leaving, itself)).otherwise(F.array(itself))
    routed = decoded.withColumn("action", action).withColumn("reason", reason).select("*", F.inline(steps))
    return routed.withColumns(
        {
            "action": F.col("_action"),
            "row": F.col("_row"),
            # order inside a message: position, then leave the old key before taking the new one
            "position": F.coalesce(F.col("position"), F.lit(0)) * 2 + F.col("_step"),
        }
    ).drop("_action", "_row", "_step")
