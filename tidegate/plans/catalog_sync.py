"""Refresh the stored catalog from a snapshot of a database's own catalog, and export it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from tidegate.operators import catalog

KEYS = {
    "tables": catalog.TABLE,
    "columns": catalog.COLUMN,
    "indexes": catalog.COLUMN,
    "constraints": catalog.COLUMN,
}


def run(
    existing: Mapping[str, DataFrame], snapshot: Mapping[str, DataFrame], allow_empty: bool = False
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Merged catalog tables and their change counts, per kind.

    Which schemas a snapshot covers is read off its tables, so a table that lost its last
    index loses it here too.
    """
    covered = snapshot["tables"]
    if covered.isEmpty() and not allow_empty:
        raise ValueError("the snapshot is empty; pass allow_empty to clear the catalog")
    merged, stats = {}, {}
    for kind, keys in KEYS.items():
        labelled = catalog.sync(existing[kind], snapshot[kind], keys, covered=covered, allow_empty=True)
        merged[kind] = catalog.after_sync(labelled)
        stats[kind] = catalog.sync_stats(labelled)
    return merged, stats


def export(
    tables: DataFrame, columns: DataFrame, indexes: DataFrame, constraints: DataFrame, folder: str,
    file_format: str = "csv",
) -> list[str]:
    """The four catalog sheets as files."""
    sheets = {
        "tables": catalog.export_tables(tables, columns),
        "columns": catalog.export_columns(columns),
        "indexes": catalog.export_indexes(indexes),
        "constraints": catalog.export_constraints(constraints),
    }
    for name, sheet in sheets.items():
        sheet.write.mode("overwrite").format(file_format).option("header", "true").save(f"{folder}/{name}")
    return sorted(sheets)
