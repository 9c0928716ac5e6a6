"""Copy a table only when its structure agrees with the target's."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidegate.operators import schema
from tidegate.sources import tables


@dataclass(frozen=True)
class Result:
    table: str
    consistent: bool
    executed: bool
    differences: DataFrame
    reason: str = ""


def run(
    source: DataFrame, path: str, table: str, source_columns: DataFrame, target_columns: DataFrame,
    source_type: str = "mysql", force: bool = False, preview: bool = False, truncate: bool = True,
    columns: Sequence[str] | None = None,
) -> Result:
    """Gate, then copy the projected columns. ``preview`` stops after the gate, ``force`` ignores it.

    ``table`` may be qualified by schema and database. A name that stands for several tables of a catalog is an error:
    the columns of one are not those of another.
    """
    of_table = schema.named(table)
    for side in (source_columns, target_columns):
        if side.where(of_table).select(*schema.TABLE).distinct().limit(2).count() > 1:
            raise ValueError(f"{table!r} stands for several tables: name schema and database")
    left, right = source_columns.where(of_table), target_columns.where(of_table)
    verdict = schema.all_consistent(schema.gate(left, right, source_type)).first()
    consistent = bool(verdict["consistent"]) and verdict["tables"] > 0
    found = schema.diff(left, right, source_type)
    if preview:
        return Result(table, consistent, False, found, "preview")
    if not consistent and not force:
        return Result(table, False, False, found, "structures differ")
    tables.load(source.select(*columns) if columns else source, path, truncate)
    return Result(table, consistent, True, found)
