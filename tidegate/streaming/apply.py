"""Continuous change application: decode each micro-batch and append it to a keyed table.

The stream keeps no keyed state of its own; the target is the state. Offsets advance only
after the batch is written, and a repeated batch replaces what it wrote before, so each change
takes effect once. A restart with the same checkpoint goes on where the last one stopped; one with another
checkpoint is another stream, whose batches stand beside those of the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegate.operators.changes import ACTION, Route, counters, project
from tidegate.sources import canal, debezium, position
from tidegate.sources.keyed_table import KeyedTable

# Fixed value: time between two batches of a continuous run.
INTERVAL = "10 seconds"
USABLE = ("upsert", "delete", "truncate")


def decode(raw: DataFrame, route: Route, in_window: Column | None = None) -> DataFrame:
    """Classified changes of one topic in the route's format."""
    of_topic = raw.where(F.col("topic") == route.topic)
    if route.change_format == "canal":
        return canal.classify(canal.decode(of_topic, route.schema.fieldNames()), route.keys)
    return debezium.classify(debezium.decode(of_topic, route.schema.fieldNames()), in_window, route.keys)


def _strict(changes: DataFrame) -> DataFrame:
    """Fail the write on the first unreadable message, so its batch is never published."""
    unreadable = F.raise_error(F.concat_ws(" ", F.lit("unreadable change message:"), "_reason", "_raw_value"))
    checked = F.when(F.col(ACTION) == "bad_message", unreadable.cast("string")).otherwise(F.col(ACTION))
    return changes.withColumn(ACTION, checked)


def batch_writer(
    table: KeyedTable, stream: str, skip_bad: bool = False,
    before: Callable[[DataFrame, int], None] | None = None, compact_every: int | None = 64,
    on_counts: Callable[[int, dict], None] | None = None,
) -> Callable[[DataFrame, int], None]:
    """What happens to one micro-batch of the named stream.

    Unreadable messages stop the stream, or go to the quarantine with ``skip_bad``. Every
    ``compact_every`` batches are folded into the state.
    """

    def write(raw: DataFrame, batch: int) -> None:
        if before is not None:
            before(raw, batch)
        changes = project(decode(raw, table.route), table.route)
        # counted while the batch is written, not by a second pass
        counts = Observation(f"batch-{batch}")
        observed = (changes if skip_bad else _strict(changes)).observe(
            counts,
            *counters(ACTION, ("rejected",)),
            F.count_if(~F.col(ACTION).isin(*USABLE)).alias("quarantined"),
        )
        table.append(batch, observed, stream)
        if on_counts is not None:
            on_counts(batch, counts.get)
        if compact_every and batch % compact_every == compact_every - 1:
            table.compact()

    return write


def start(
    stream: DataFrame, table: KeyedTable, checkpoint: str, drain: bool = False, interval: str = INTERVAL,
    **policy,
) -> StreamingQuery:
    """Run the stream: every ``interval``, or until the input is drained and then stop."""
    name = position.begun(stream.sparkSession, checkpoint).stream
    writer = stream.writeStream.foreachBatch(batch_writer(table, name, **policy)).option(
        "checkpointLocation", checkpoint
    )
    trigger = writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=interval)
    return trigger.start()


def append_stream(
    stream: DataFrame, path: str, checkpoint: str, partition: tuple[str, ...] = (), drain: bool = False,
    interval: str = INTERVAL,
) -> StreamingQuery:
    """Exactly-once append of a stream to Parquet, for bronze tables and recorded requests."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if partition:
        writer = writer.partitionBy(*partition)
    trigger = writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=interval)
    return trigger.start()
