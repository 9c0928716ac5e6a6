"""The daily change batch: one local day of a raw change table into keyed targets."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidegate.functions.values import DEFAULT_ZONE, in_day, yesterday
from tidegate.operators import changes as ch
from tidegate.operators.changes import Route
from tidegate.sources import bronze
from tidegate.sources.keyed_table import KeyedTable
from tidegate.streaming.apply import decode


# Fixed value: the stream that a table's days belong to.
DAYS = "days"


def day_changes(raw: DataFrame, route: Route, day: str, zone: str = DEFAULT_ZONE) -> DataFrame:
    """Classified changes of a topic; those of other days are marked, not dropped."""
    return decode(raw, route, in_day(F.col("event_ms"), day, zone))


def run(
    spark: SparkSession, bronze_path: str, routes: Sequence[Route], target_root: str, day: str | None = None,
    zone: str = DEFAULT_ZONE, dry_run: bool = False, parts: int | None = None,
) -> dict[str, dict[str, int]]:
    """Apply a day (default: yesterday in the zone) and return the counters per target.

    The bronze table keeps every record under its event date, so an early run loses nothing
    and a repeated run of a day replaces what it wrote before. The counters are taken while
    the changes are written; ``dry_run`` counts only.
    """
    day = day or yesterday(zone)
    counters = {}
    for route in routes:
        raw = bronze.read_day(spark, bronze_path, day, [route.topic])
        classified = day_changes(raw, route, day, zone)
        if dry_run:
            counters[route.table] = ch.action_counts(classified).first().asDict()
            continue
        seen = Observation(f"{route.table} {day}")
        changes = ch.project(classified, route).observe(seen, *ch.counters(ch.ACTION, ("rejected",)))
        table = KeyedTable(spark, f"{target_root}/{route.table}", route, parts)
        # the day number keeps batches in date order
        table.append(int(day.replace("-", "")), changes, DAYS)
        counters[route.table] = dict(seen.get)
        table.compact()
    return counters


def replay(raw: DataFrame, route: Route, table: KeyedTable, since_ms: int, name: str | None = None) -> str:
    """Take a topic's records from a record time on once more, for a column added since then.

    Each replay is a stream of its own, so it replaces no other batch; under a ``name`` it replaces its own last run.
    """
    name = name or f"replay-{uuid.uuid4().hex}"
    table.append(0, ch.project(decode(bronze.since(raw, since_ms), route), route), name)
    return name
