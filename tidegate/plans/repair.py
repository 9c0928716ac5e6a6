"""Bring a drifted stream back: stop, evolve the target, check again, resume.

``repair`` does so once, ``supervise`` whenever it is needed while a stream runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidegate.operators import schema
from tidegate.streaming import control, drift

# Seconds between two looks at the source, and repairs of one stream that may follow each other.
LOOK_SECONDS = 600.0
REPAIRS = 5


@dataclass
class Report:
    steps: list[str] = field(default_factory=list)
    blocked: bool = False
    query: StreamingQuery | None = None


def repair(
    query: StreamingQuery | None, declared: DataFrame, source_columns: Callable[[], DataFrame],
    target_columns: Callable[[], DataFrame], evolve: Callable[[DataFrame], None],
    resume: Callable[[], StreamingQuery], change_format: str, source_type: str = "mysql",
    primary_keys: DataFrame | None = None, force: bool = False,
) -> Report:
    """Stop the stream, apply the alignment plan, and resume on the same checkpoint.

    ``evolve`` receives the planned actions. When the gate still finds differences the stream
    stays stopped; its checkpoint keeps the position.
    """
    report = Report()
    current = source_columns()
    if drift.check(declared, current, change_format).isEmpty():
        report.steps.append("unchanged")
        report.query = query
        return report
    if query is not None and query.isActive:
        control.stop(query)
    report.steps.append("stopped")
    keys = primary_keys
    if keys is None:
        keys = current.sparkSession.createDataFrame([], "table_name string, column_names array<string>")
    evolve(schema.plan(current, target_columns(), keys, source_type))
    report.steps.append("evolved")
    verdict = schema.all_consistent(schema.gate(current, target_columns(), source_type)).first()
    if not verdict["consistent"] and not force:
        report.steps.append("blocked")
        report.blocked = True
        return report
    report.query = resume()
    report.steps.append("resumed")
    return report


def _drifted(query: StreamingQuery, seconds: float) -> tuple[bool, bool]:
    """Whether the query has ended, and whether a change of structure ended it; other failures are raised."""
    try:
        return query.awaitTermination(seconds), False
    except StreamingQueryException as error:
        if drift.SchemaDrift.__name__ not in str(error):
            raise
        return True, True


def supervise(
    start: Callable[[], StreamingQuery], mend: Callable[[StreamingQuery], Report], changed: Callable[[], bool],
    look: float = LOOK_SECONDS, repairs: int = REPAIRS,
) -> Report:
    """Keep a stream running while its source's structure changes.

    ``mend`` is a call of ``repair``; it follows when the stream's own guard stopped a batch, or when a look at the
    source, one every ``look`` seconds, finds a change. The resumed query reads on from the same checkpoint, the
    stopped batch included. Ends with the query, or where a repair stays blocked or needs yet another one.
    """
    report = Report(query=start())
    for _ in range(repairs + 1):
        ended, stopped = False, False
        while not ended and not stopped:
            ended, stopped = _drifted(report.query, look)
            if not ended and changed():
                stopped = True
        if not stopped:
            return report
        done = mend(report.query)
        report.steps += done.steps
        report.blocked = done.blocked
        if done.blocked or done.query is None:
            return report
        report.query = done.query
    report.blocked = True
    return report
