"""Take type texts of several databases apart into name, length, precision and scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.functions.typemap import INTEGER_TYPES

# Type text patterns of the databases.
DECIMAL_TEXT = r"(?i)^decimal\((\d+),\s*(\d+)\)$"
DECIMAL_PREFIX = r"(?i)^decimal\((\d+),\s*(\d+)\)"
SIZED_TEXT = r"(?i)^(char|varchar)\((\d+)\)$"
FIXED_STRING = r"(?i)^fixedstring\((\d+)\)"
ORACLE_NUMBER = r"(?i)^NUMBER\((\d+)(?:,\s*(\d+))?\)$"
ORACLE_SIZED = r"(?i)^(VARCHAR2|NVARCHAR2|CHAR|NCHAR|RAW)\((\d+)(?:\s+BYTE|\s+CHAR)?\)$"
ORACLE_TIMESTAMP = r"(?i)^(TIMESTAMP)(?:\((\d+)\))?( WITH TIME ZONE| WITH LOCAL TIME ZONE)?$"
ORACLE_LENGTH_TYPES = ["VARCHAR2", "NVARCHAR2", "CHAR", "NCHAR", "RAW"]


def _group(text: Column, pattern: str, index: int) -> Column:
    """Group as a number; NULL where the pattern or the group does not match."""
    return F.nullif(F.regexp_extract(text, pattern, index), F.lit("")).cast("int")


def _descriptor(data_type: Column, text: Column, length: Column, precision: Column, scale: Column) -> Column:
    return F.struct(
        data_type.alias("data_type"),
        text.alias("column_type"),
        length.cast("int").alias("max_length"),
        precision.cast("int").alias("numeric_precision"),
        scale.cast("int").alias("numeric_scale"),
    )


def _trimmed(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit("")))


def store_descriptor(text: Column) -> Column:
    """Type text as the analytical store describes its own columns."""
    text = _trimmed(text)
    lower = F.lower(text)
    base = F.regexp_replace(lower, r"\(\d+\)", "")
    name = (
        F.when(lower.rlike(DECIMAL_TEXT), "decimal")
        .when(lower.rlike(SIZED_TEXT), F.regexp_extract(lower, SIZED_TEXT, 1))
        .when(base.isin([*INTEGER_TYPES, "boolean"]), base)
        .otherwise(lower)
    )
    return _descriptor(
        name, text, _group(lower, SIZED_TEXT, 2), _group(lower, DECIMAL_TEXT, 1), _group(lower, DECIMAL_TEXT, 2)
    )


def oracle_descriptor(text: Column, data_length: Column, precision: Column, scale: Column) -> Column:
    """Oracle type text; lengths and precisions outside the text come from the catalog row."""
    text = _trimmed(text)
    upper = F.upper(text)
    name = (
        F.when(text.rlike(ORACLE_SIZED), F.lower(F.regexp_extract(text, ORACLE_SIZED, 1)))
        .when(text.rlike(ORACLE_NUMBER), "number")
        .when(text.rlike(ORACLE_TIMESTAMP), "timestamp")
        .otherwise(F.lower(text))
    )
    bare_length = F.when(upper.isin(ORACLE_LENGTH_TYPES), F.nullif(data_length.cast("int"), F.lit(0)))
    bare_number = upper == "NUMBER"
    return _descriptor(
        name,
        text,
        F.coalesce(_group(text, ORACLE_SIZED, 2), bare_length),
        F.coalesce(_group(text, ORACLE_NUMBER, 1), F.when(bare_number, precision.cast("int"))),
        F.when(text.rlike(ORACLE_NUMBER), F.coalesce(_group(text, ORACLE_NUMBER, 2), F.lit(0))).when(
            bare_number, scale.cast("int")
        ),
    )


def odps_descriptor(text: Column) -> Column:
    text = _trimmed(text)
    lower = F.lower(text)
    size = _group(lower, r"^(?:string|varchar|char).*?\((\d+)\)", 1)
    name = (
        F.when(lower.rlike(DECIMAL_TEXT), "decimal")
        .when(size.isNotNull(), F.substring_index(lower, "(", 1))
        .otherwise(lower)
    )
    return _descriptor(name, text, size, _group(lower, DECIMAL_TEXT, 1), _group(lower, DECIMAL_TEXT, 2))


def clickhouse_descriptor(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    lower = F.lower(text)
    return _descriptor(
        F.substring_index(lower, "(", 1),
        text,
        _group(lower, FIXED_STRING, 1),
        _group(lower, DECIMAL_PREFIX, 1),
        _group(lower, DECIMAL_PREFIX, 2),
    )


def db2_descriptor(text: Column, length: Column, scale: Column) -> Column:
    lower = F.lower(F.coalesce(text, F.lit("")))
    is_text = lower.isin("varchar", "char", "graphic")
    is_decimal = lower.isin("decimal", "numeric")
    return _descriptor(
        lower,
        F.coalesce(text, F.lit("")),
        F.when(is_text, length),
        F.when(is_decimal, length),
        F.when(is_decimal, F.coalesce(scale.cast("int"), F.lit(0))),
    )
