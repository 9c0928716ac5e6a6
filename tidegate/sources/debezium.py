"""Decode Debezium change events with built-in JSON functions.

The envelope may sit under ``payload`` or be the message itself. Anything in the place of a
row image that is not an object becomes NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.images import carries, image_type, is_filled
from tidegate.functions.values import computed_once

# Operation codes.
UPSERT_OPS = ["c", "r", "u"]
DELETE_OP, TRUNCATE_OP = "d", "t"


def envelope(columns: Sequence[str] | None) -> str:
    """DDL of a message: the envelope at the top and, alike, under ``payload``."""
    image = image_type(columns)
    fields = {
        "op": "string",
        "ts_ms": "bigint",
        "before": image,
        "after": image,
        "source": "struct<ts_ms:bigint,lsn:bigint>",
    }
    nested = ",".join(f"{n}:{t}" for n, t in fields.items())
    return f"payload struct<{nested}>, " + ", ".join(f"{n} {t}" for n, t in fields.items())


def _field(name: str) -> Column:
    return F.when(F.col("_e.payload").isNotNull(), F.col(f"_e.payload.{name}")).otherwise(F.col(f"_e.{name}"))


def _time(value: Column) -> Column:
    """Zero counts as missing."""
    return F.nullif(value, F.lit(0).cast("bigint"))


def _event_ms() -> Column:
    return F.coalesce(_time(_field("ts_ms")), _time(_field("source")["ts_ms"]), F.unix_millis("timestamp"))


def with_event_time(raw: DataFrame) -> DataFrame:
    """Bronze rows plus ``event_ms`` as ``decode`` has it, without parsing what else the messages hold.

    A text that ``decode`` gives up because of its images, where it takes the record's time, may keep its own here.
    """
    times = "ts_ms bigint, source struct<ts_ms:bigint>"
    parsed = computed_once(raw, _e=F.from_json("value", f"payload struct<{times}>, {times}"))
    return parsed.select(*raw.columns, _event_ms().alias("event_ms"))


def decode(raw: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Bronze rows plus ``readable, op, before, after, key_row, event_ms, lsn``.

    ``readable`` is false for empty, malformed and non-object messages. The event time is the
    envelope's, else the source's, else the record's own. With ``columns`` only their cells
    are parsed, into structs; without, whatever the images hold, into maps.
    """
    parsed = computed_once(
        raw,
        readable=F.json_object_keys("value").isNotNull(),
        _e=F.from_json("value", envelope(columns)),
        key_row=F.from_json("key", f"payload {image_type(columns)}")["payload"],
    )
    return parsed.select(
        *raw.columns,
        "readable",
        "key_row",
        _field("op").alias("op"),
        _field("before").alias("before"),
        _field("after").alias("after"),
        _event_ms().alias("event_ms"),
        F.coalesce(_field("source")["lsn"], F.lit(0).cast("bigint")).alias("lsn"),
    )


def may_truncate(value: Column) -> Column:
    """False only for texts that cannot hold the operation code of a truncate.

    A JSON string of one letter is spelled as itself or as its code point, so the search for
    truncates parses next to nothing.
    """
    return F.contains(value, F.lit(f'"{TRUNCATE_OP}"')) | F.contains(value, F.lit(f"\\u{ord(TRUNCATE_OP):04x}"))


def classify(
    decoded: DataFrame, in_window: Column | None = None, keys: Sequence[str] | None = None
) -> DataFrame:
    """Add ``action``, ``row`` and, for everything that cannot be applied, ``reason``.

    Actions: upsert, delete, truncate, and the rejected bad_message, out_of_window, no_after,
    unknown_op. A delete needs the configured ``keys`` in its row, or a message key that names
    them; with neither its key is unknown and it is rejected.
    """
    kind = decoded.schema["after"].dataType
    window = F.lit(True) if in_window is None else F.coalesce(in_window, F.lit(False))
    op = F.coalesce(F.col("op"), F.lit(""))
    key_filled = is_filled(F.col("key_row"), kind)
    # a delete takes its key from the message key, else from the old image
    leaving = F.when(key_filled, F.col("key_row")).when(is_filled(F.col("before"), kind), F.col("before"))
    has_key = carries(leaving, keys, kind) if keys else key_filled
    action = (
        F.when(~F.col("readable"), "bad_message")
        .when(~window, "out_of_window")
        .when(op.isin(UPSERT_OPS), F.when(is_filled(F.col("after"), kind), "upsert").otherwise("no_after"))
        .when(op == DELETE_OP, F.when(has_key, "delete").otherwise("bad_message"))
        .when(op == TRUNCATE_OP, "truncate")
        .otherwise("unknown_op")
    )
    reason = (
        F.when(~F.col("readable"), "not a JSON object")
        .when(F.col("action") == "bad_message", "delete without a key")
        .when(~F.col("action").isin("upsert", "delete", "truncate"), F.col("action"))
    )
    row = F.when(F.col("action") == "upsert", F.col("after")).when(F.col("action") == "delete", leaving)
    return decoded.withColumn("action", action).withColumns({"reason": reason, "row": row})
