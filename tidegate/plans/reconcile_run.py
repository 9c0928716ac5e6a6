"""A reconciliation task from its definition to its recorded run."""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.operators import reconcile as rc
from tidegate.operators import schema
from tidegate.operators.reconcile import Pair
from tidegate.session import scratch_path

Opener = Callable[[str], DataFrame]
# Tables in one plan of a recorded run: planning time grows faster than their number.
GROUP = 40


@dataclass(frozen=True)
class Task:
    """What to compare: a check, its tables (none: the source's whole catalog) and what the check needs."""

    name: str
    kind: str
    tables: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    metric_sql: str = ""
    options: dict = field(default_factory=dict)


def _skipped(spark: SparkSession, task: Task) -> DataFrame:
    return spark.createDataFrame([(t, rc.SKIPPED) for t in task.tables], "`table` string, status string")


CHECKS: dict[str, Callable[[Task, Sequence[Pair]], DataFrame]] = {
    "row_count": lambda task, pairs: rc.row_count(pairs),
    "pk_snapshot": lambda task, pairs: rc.pk_snapshot(pairs, task.keys, **task.options),
    "pk_digest": lambda task, pairs: rc.pk_digest(pairs, task.keys),
    "field_value": lambda task, pairs: rc.field_value(pairs, task.columns),
    "metric": lambda task, pairs: rc.metric(pairs, task.metric_sql),
}


def validate(task: Task) -> None:
    if task.kind not in (*CHECKS, "metadata"):
        raise ValueError(f"unknown check: {task.kind}")
    if task.kind in ("pk_snapshot", "pk_digest") and not task.keys:
        raise ValueError("a key check needs primary key columns")
    if task.kind == "metric" and not task.metric_sql.strip():
        raise ValueError("a metric check needs SQL")


def _open(opener: Opener, table: str) -> tuple[DataFrame | None, str | None]:
    try:
        return opener(table), None
    except (AnalysisException, LookupError, FileNotFoundError) as error:
        return None, str(error).splitlines()[0]


def open_pairs(task: Task, source: Opener, target: Opener) -> list[Pair]:
    """Both sides of every table; a side that is not there leaves the others running."""
    pairs = []
    for table in task.tables:
        (left, left_error), (right, right_error) = _open(source, table), _open(target, table)
        pairs.append(Pair(table, left, right, left_error, right_error))
    return pairs


def resolved(task: Task, source: Opener) -> Task:
    """The task with its tables: those it names, or all that the source's column catalog lists.

    A name that stands in several schemas of the catalog comes with schema, or with database and schema.
    """
    if task.tables:
        return task
    catalog = source("columns")
    known = [c for c in schema.TABLE if c in catalog.columns]
    names = [F.concat_ws(".", *known[n:]) for n in range(len(known))]  # the longest first
    tables = catalog.select(*known).distinct().select(F.array(*names).alias("names"))
    meant = tables.select("names", F.posexplode("names").alias("shorter", "name"))
    once = meant.groupBy("name").agg(F.count("*").alias("n"), F.first("names").alias("names"), F.max("shorter").alias("shorter"))
    shortest = once.where("n = 1").groupBy("names").agg(F.max_by("name", "shorter").alias("name"))
    return replace(task, tables=tuple(r.name for r in shortest.orderBy("name").collect()))


def _metadata(spark: SparkSession, task: Task, source: Opener, target: Opener) -> DataFrame:
    """Structure findings of the task's tables; a table that neither catalog lists is a source error."""
    wanted = spark.createDataFrame([(t,) for t in task.tables], "`table` string")
    (left, left_error), (right, right_error) = _open(source, "columns"), _open(target, "columns")
    if left is None or right is None:
        return wanted.select(
            "table",
            F.lit(rc.SOURCE_ERROR if left is None else rc.TARGET_MISSING).alias("status"),
            F.lit(left_error or right_error).alias("message"),
        )
    listed = rc.metadata(left, right, **task.options).withColumn("table", F.explode(schema.names()))
    return wanted.join(listed, "table", "left").withColumn("status", F.coalesce("status", F.lit(rc.SOURCE_ERROR)))


def details(spark: SparkSession, task: Task, source: Opener, target: Opener) -> DataFrame:
    """One row per finding of the task's check, missing tables included."""
    validate(task)
    task = resolved(task, source)
    if task.kind == "metadata":
        return _metadata(spark, task, source, target)
    if task.kind == "field_value" and not task.columns:
        return _skipped(spark, task)
    pairs = open_pairs(task, source, target)
    opened = [p for p in pairs if p.source is not None or p.target is not None]
    absent = [
        (p.table, rc.SOURCE_ERROR, p.source_message) for p in pairs if p.source is None and p.target is None
    ]
    found = CHECKS[task.kind](task, opened) if opened else None
    if not absent:
        return found
    lost = spark.createDataFrame(absent, "`table` string, status string, message string")
    return lost if found is None else found.unionByName(lost, allowMissingColumns=True)


def _alone(spark: SparkSession, task: Task, source: Opener, target: Opener, failure: Exception) -> DataFrame:
    """The finding for a table whose check failed: by which side, if the source can be read by itself."""
    status = rc.SOURCE_ERROR
    if task.kind in CHECKS:
        left, error = _open(source, task.tables[0])
        try:
            if left is not None:
                CHECKS[task.kind](task, [Pair(task.tables[0], left, None)]).collect()
                status = rc.TARGET_MISSING
        except Exception as found:
            error = str(found)
        failure = error or failure
    text = str(failure).strip().splitlines()
    return spark.createDataFrame([(task.tables[0], status, text[0] if text else "")], "`table` string, status string, message string")


def written(
    spark: SparkSession, task: Task, source: Opener, target: Opener, write: Callable[[DataFrame], None]
) -> None:
    """Check the task's tables in one job; where it fails, each half by itself, down to the table that breaks it.

    Tables are read when their check runs, so that is when a source fails. A failed job writes nothing; of all other
    tables the findings are written.
    """
    try:
        write(details(spark, task, source, target))
    except ValueError:
        raise
    except Exception as failure:
        if len(task.tables) < 2:
            if not task.tables:
                raise
            write(_alone(spark, task, source, target, failure))
            return
        half = len(task.tables) // 2
        for part in (task.tables[:half], task.tables[half:]):
            written(spark, replace(task, tables=part), source, target, write)


def record(
    spark: SparkSession, task: Task, source: Opener, target: Opener, history: str | None = None
) -> dict:
    """Run a task and append its details and its summary to the history folder.

    The details are written once, group by group, and the summary is computed from the written rows, so a
    check runs once. Without a history they go to the shared folder. A table that breaks while it is read
    costs its group a few more jobs, and no other table its finding.
    """
    started = time.time()
    run_id = uuid.uuid4().hex
    ran_at = dt.datetime.now(dt.timezone.utc)
    stamp = lambda df: df.withColumns(
        {"run_id": F.lit(run_id), "task_name": F.lit(task.name), "task_type": F.lit(task.kind)}
    )
    status, error, totals = "success", None, None
    try:
        folder = f"{history}/details/task_type={task.kind}/run={run_id}" if history else scratch_path(spark, "reconcile")
        write = lambda df: stamp(df).drop("task_type").write.mode("append").parquet(folder)
        every = resolved(task, source)
        for at in range(0, len(every.tables), GROUP):
            written(spark, replace(every, tables=every.tables[at : at + GROUP]), source, target, write)
        if not every.tables:
            write(spark.createDataFrame([], "`table` string, status string"))
        rows = spark.read.option("mergeSchema", "true").parquet(folder)
        totals = rc.summary(rows).first().asDict()
    except ValueError:
        raise
    except Exception as failure:
        status, error = "failed", str(failure).splitlines()[0]
    run = {
        "run_id": run_id,
        "task_name": task.name,
        "task_type": task.kind,
        "status": status,
        "error": error,
        "ran_at": ran_at,
        "duration_ms": int((time.time() - started) * 1000),
        **{k: None if totals is None else totals[k] for k in ("total", "ok", "mismatch")},
    }
    if history:
        ddl = (
            "run_id string, task_name string, task_type string, status string, error string, "
            "ran_at timestamp, duration_ms bigint, total bigint, ok bigint, mismatch bigint"
        )
        one = spark.createDataFrame([tuple(run.values())], ddl)
        day = F.date_format("ran_at", "yyyy-MM-dd").alias("run_date")
        one.select("*", day).write.mode("append").partitionBy("run_date").parquet(f"{history}/runs")
    return run | {"totals": totals}


def exit_code(run: dict) -> int:
    """What a scheduler sees: 1 when something differs or the run failed."""
    return 1 if run["status"] != "success" or (run["totals"] or {}).get("different") else 0
