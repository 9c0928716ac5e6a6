"""Row images of change events: parsed cells that keep their JSON type.

With known columns an image is a struct of variants, without them a map. In both an absent
cell is NULL and an explicit null is a variant null, which is not NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def image_type(columns: Sequence[str] | None) -> str:
    if columns is None:
        return "map<string,variant>"
    return "struct<" + ",".join(f"`{c}`:variant" for c in columns) + ">"


def raw_cell(image: Column, name: str, kind: T.DataType) -> Column:
    """The variant of a cell; NULL where the image does not carry it."""
    if isinstance(kind, T.StructType):
        return image[name] if name in kind.fieldNames() else F.lit(None).cast("variant")
    return F.try_element_at(image, F.lit(name))


def is_filled(image: Column, kind: T.DataType) -> Column:
    """Does the image carry any cell?"""
    if isinstance(kind, T.StructType):
        cells = [image[name].isNotNull() for name in kind.fieldNames()]
        filled = cells[0]
        for cell in cells[1:]:
            filled = filled | cell
        return F.coalesce(filled, F.lit(False))
    return F.coalesce(F.size(image) > 0, F.lit(False))


def carries(image: Column, names: Sequence[str], kind: T.DataType) -> Column:
    """Does the image carry all these cells?"""
    both = F.lit(True)
    for name in names:
        both = both & raw_cell(image, name, kind).isNotNull()
    return both


def is_given(raw: Column) -> Column:
    """A value is there: neither absent nor null."""
    return raw.isNotNull() & ~F.is_variant_null(raw)


def typed(raw: Column, data_type: T.DataType) -> Column:
    """A cell in the target type; text keeps nested JSON, booleans become 1 and 0 in text."""
    if isinstance(data_type, T.StringType):
        flag = F.try_variant_get(raw, "$", "int").cast("string")
        return F.when(F.schema_of_variant(raw) == "BOOLEAN", flag).otherwise(F.try_variant_get(raw, "$", "string"))
    if isinstance(data_type, (T.TimestampType, T.DateType)):
        return F.try_variant_get(raw, "$", "string").try_cast(data_type)
    return F.try_variant_get(raw, "$", data_type.simpleString())
