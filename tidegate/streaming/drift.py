"""Notice that a source's structure has moved away from what a running stream declares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tidegate.operators import schema


class SchemaDrift(RuntimeError):
    """The source has changed; the stream stops before it writes the batch."""


def check(declared: DataFrame, current: DataFrame, change_format: str) -> DataFrame:
    """Differences between the declared and the current columns of one or more jobs."""
    return schema.drift(declared, current, change_format)


def guard(
    declared: DataFrame, current: Callable[[], DataFrame], change_format: str
) -> Callable[[DataFrame, int], None]:
    """A per-batch check: read the catalog again and stop on any difference.

    The lists compared are the columns of the streamed table, a few thousand rows at most.
    """

    def before(_raw: DataFrame, batch: int) -> None:
        found = check(declared, current(), change_format)
        if not found.isEmpty():
            raise SchemaDrift(f"batch {batch}: the source structure differs from the declared one")

    return before
