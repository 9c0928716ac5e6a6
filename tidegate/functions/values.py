"""Canonical text, digests, guards, identifiers and local time."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted identifiers, accepted unsigned numbers, text of a NULL,
# separators of a key snapshot, default zone.
IDENTIFIER = r"^[A-Za-z0-9_$]+$"
UNSIGNED_NUMBER = r"^[0-9]+(\.[0-9]+)?$"
NULL_TEXT = "None"
FIELD_SEPARATOR = "|"
ROW_SEPARATOR = ";"
DEFAULT_ZONE = "Asia/Shanghai"
LOCAL_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def check_identifier(name: str) -> str:
    """Return ``name`` when it is a plain identifier; raise otherwise."""
    if not re.fullmatch(IDENTIFIER, str(name)):
        raise ValueError(f"not a plain identifier: {name!r}")
    return str(name)


def canon(value: Column | str) -> Column:
    """Text of a value for digests and side-by-side display; NULL has a text of its own."""
    column = F.col(value) if isinstance(value, str) else value
    return F.coalesce(column.cast("string"), F.lit(NULL_TEXT))


def row_text(columns: Sequence[Column | str]) -> Column:
    return F.concat_ws(FIELD_SEPARATOR, *[canon(c) for c in columns])


def portable_hash(text: Column) -> Column:
    """First 60 bits of the md5 as an exact number, reproducible by other SQL engines."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")


def row_hash(columns: Sequence[str]) -> Column:
    """64-bit hash of a row that tells NULL from any value and keeps column order."""
    parts: list[Column] = []
    for name in columns:
        parts += [F.col(name).isNull(), F.col(name)]
    return F.xxhash64(*parts).cast("decimal(20,0)")


def is_unsigned_number(text: Column) -> Column:
    """True only for plain unsigned numbers: no sign, exponent or blanks, and not NULL."""
    return F.coalesce(text.rlike(UNSIGNED_NUMBER), F.lit(False))


def local_time(timestamp: Column, zone: str = DEFAULT_ZONE, pattern: str = LOCAL_TIME_FORMAT) -> Column:
    """Wall-clock text of an instant in ``zone`` (session zone UTC)."""
    return F.date_format(F.from_utc_timestamp(timestamp, zone), pattern)


def local_date(timestamp: Column, zone: str = DEFAULT_ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(timestamp, zone))


def local_date_of_ms(epoch_ms: Column, zone: str = DEFAULT_ZONE) -> Column:
    return local_date(F.timestamp_millis(epoch_ms), zone)


def yesterday(zone: str = DEFAULT_ZONE) -> str:
    return (dt.datetime.now(ZoneInfo(zone)).date() - dt.timedelta(days=1)).isoformat()


def day_bounds_ms(day: str, zone: str = DEFAULT_ZONE) -> tuple[int, int]:
    """Epoch milliseconds of local midnight of ``day`` and of the next day."""
    first = dt.date.fromisoformat(day)
    midnights = [
        dt.datetime.combine(first + dt.timedelta(days=n), dt.time.min, ZoneInfo(zone)) for n in (0, 1)
    ]
    return tuple(int(m.timestamp() * 1000) for m in midnights)


def in_day(epoch_ms: Column, day: str, zone: str = DEFAULT_ZONE) -> Column:
    start, end = day_bounds_ms(day, zone)
    return F.coalesce((epoch_ms >= start) & (epoch_ms < end), F.lit(False))


def positive_or(value: Column, default: int) -> Column:
    """``value``, or ``default`` where it is NULL or zero."""
    return F.coalesce(F.nullif(value.cast("int"), F.lit(0)), F.lit(default))


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row generator.

    The optimizer moves filters below a projection by repeating its expressions, which for
    parsed messages means parsing again per mention. Filters stay above a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
