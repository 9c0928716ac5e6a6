"""A keyed target on plain Parquet: hashed parts of the state, and the changes after them.

Four ordinary tables lie below the path:

``changes``  rows of every batch, each under the name of the run that wrote it;
``commits``  one row (stream, batch, run, at) for every batch that was written in full;
``state``    latest row per key, tombstones included, by fold and part (a hash of the key);
``folds``    one row for every version: the parts it wrote, the runs it took in, the last truncate.

A batch is known by its stream and number, so streams that number their batches alike do not meet. Of several runs of
one batch the last counts; what an earlier one left is replaced. The news is what an anti join of commits and folds
leaves. ``compact`` folds it: it reads and writes only the parts the news has keys of, and takes effect with the
row of its version; readers join the state with the newest version of each part. What a died run wrote has no such
row and is never read. Folding a change twice is harmless, as rows keep their order. One writer per table.

Columns may be added and types widened from one run to the next: older files are read in the newer schema, and a
column they don't have counts as not carried by the change.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.operators import changes as ch
from tidegate.operators.changes import ACTION, EPOCH_TYPE, ORDER, ORDER_TYPE, Route

# Stream of batches whose caller names none, and files of small tables that are gathered into one.
UNNAMED = "batches"
SMALL_FILES = 256
COMMITS = "stream string, batch bigint, run string, at bigint"
FOLDS = f"version bigint, fold string, parts int, touched array<int>, runs array<string>, epoch {EPOCH_TYPE}"


class KeyedTable:
    """``parts`` defaults to the session's shuffle partitions; a table with another number is rewritten by its next fold."""

    def __init__(self, spark: SparkSession, path: str, route: Route, parts: int | None = None):
        self.spark, self.path, self.route = spark, path.rstrip("/"), route
        self.parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.keys, self.values = list(route.keys), route.values

    # ----------------------------------------------------------------- schemas

    @property
    def batch_schema(self) -> T.StructType:
        """Rows of a batch; declared, because a batch without changes writes no file."""
        schema = T.StructType([self.route.schema[k] for k in self.keys])
        for name in self.values:
            cell = T.StructType([T.StructField("value", self.route.schema[name].dataType)])
            schema = schema.add(name, cell.add("present", T.BooleanType()))
        schema = schema.add(ACTION, "string").add("_reason", "string").add(ORDER, T._parse_datatype_string(ORDER_TYPE))
        for name in ("_raw_topic", "_raw_key", "_raw_value", "_run", "_usable"):
            schema = schema.add(name, "string")
        return schema

    @property
    def state_schema(self) -> T.StructType:
        schema = T.StructType([self.route.schema[k] for k in self.keys])
        for name in self.values:
            schema = schema.add(name, self.route.schema[name].dataType)
        return schema.add("_deleted", T.BooleanType()).add(ORDER, T._parse_datatype_string(ORDER_TYPE))

    def _rows(self, name: str, schema: T.StructType | str) -> DataFrame:
        """One of the tables, without rows where nothing was written yet."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _add(self, name: str, row: tuple, schema: str) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    # ----------------------------------------------------------------- batches

    def append(self, batch: int, projected: DataFrame, stream: str = UNNAMED) -> None:
        """Write one batch; repeating it replaces it. Rejected changes stay with their reason and text."""
        run = uuid.uuid4().hex
        usable = F.col(ACTION).isin("upsert", "delete", "truncate").cast("string")
        (
            projected.withColumns({"_run": F.lit(run), "_usable": usable})
            .write.mode("append").partitionBy("_run", "_usable").parquet(f"{self.path}/changes")
        )
        self._add("commits", (stream, batch, run, time.time_ns()), COMMITS)

    def commits(self) -> DataFrame:
        """The run that counts for each batch."""
        return self._rows("commits", COMMITS).groupBy("stream", "batch").agg(F.max_by("run", "at").alias("run"))

    def news(self) -> DataFrame:
        """The batches that no version holds yet."""
        folded = self._rows("folds", FOLDS).select(F.explode("runs").alias("run"))
        return self.commits().join(folded, "run", "left_anti")

    def batches(self) -> list[tuple[str, int]]:
        """Stream and number of the news, in order."""
        return sorted((r.stream, r.batch) for r in self.news().collect())

    def _of_runs(self, runs: DataFrame | list[str], usable: bool) -> DataFrame:
        """Rows of these runs. A list names folders alone: a join by run would send each run to one task."""
        rows = self._rows("changes", self.batch_schema).where(F.col("_usable") == str(usable).lower())
        if isinstance(runs, list):
            return rows.where(F.col("_run").isin(runs))
        return rows.join(runs.select(F.col("run").alias("_run")), "_run", "left_semi")

    def _new_runs(self) -> list[str]:
        """One name for each batch since the last fold."""
        return [r.run for r in self.news().select("run").collect()]

    def changes(self) -> DataFrame:
        """The changes that no version holds yet."""
        return self._of_runs(self._new_runs(), True)

    def quarantine(self) -> DataFrame:
        """Rejected changes with their reason and raw text."""
        return self._of_runs(self.commits(), False).drop("_run", "_usable")

    # ------------------------------------------------------------------- state

    def _newest(self) -> T.Row | None:
        """The last fold."""
        return self._rows("folds", FOLDS).orderBy(F.desc("version")).first()

    def version(self) -> int | None:
        newest = self._newest()
        return None if newest is None else newest.version

    def layout(self) -> dict[int, str]:
        """For each part the fold that holds it. As many rows as the table has parts."""
        newest = self._newest()
        if newest is None:
            return {}
        folds = self._rows("folds", FOLDS).where(F.col("parts") == newest.parts).select("version", "fold", F.explode("touched").alias("part"))
        return {r.part: r.fold for r in folds.groupBy("part").agg(F.max_by("fold", "version").alias("fold")).collect()}

    def _snapshot(self, layout: dict[int, str]) -> DataFrame:
        """State rows of these parts. The condition names folders alone, so other files are not opened."""
        rows = self._rows("state", self.state_schema.add("_fold", T.StringType()).add("_part", T.IntegerType()))
        by_fold: dict[str, list[int]] = {}
        for part, fold in layout.items():
            by_fold.setdefault(fold, []).append(part)
        of = [(F.col("_fold") == fold) & F.col("_part").isin(parts) for fold, parts in sorted(by_fold.items())]
        return rows.where(reduce(or_, of, F.lit(False))).drop("_fold", "_part")

    def _part(self, parts: int) -> Column:
        return F.pmod(F.xxhash64(*self._typed_keys()), F.lit(parts)).cast("int")

    def _typed_keys(self) -> list[Column]:
        """Whole numbers hash alike in every width, so that a widened key stays in its part."""
        whole = (T.ByteType, T.ShortType, T.IntegerType)
        return [F.col(k).cast("bigint") if isinstance(self.route.schema[k].dataType, whole) else F.col(k) for k in self.keys]

    def _epoch(self, newest: T.Row | None, news: DataFrame) -> Column:
        """Order of the last truncate, of those that the state has taken in and of the news."""
        folded = F.lit(None).cast(EPOCH_TYPE)
        if newest is not None and newest.epoch is not None:
            folded = F.struct(*[F.lit(v).alias(n) for n, v in newest.epoch.asDict().items()]).cast(EPOCH_TYPE)
        return F.greatest(folded, ch.truncate_epoch(news))

    def compact(self, keep: int = 2) -> int | None:
        """Fold the news into a new version of the parts it touches; returns the version that counts now."""
        runs, newest = self._new_runs(), self._newest()
        if not runs:
            return None if newest is None else newest.version
        version, layout = (0, {}) if newest is None else (newest.version + 1, self.layout())
        fold = uuid.uuid4().hex
        # what is committed from here on stays news
        news = self._of_runs(runs, True)
        epoch = self.spark.range(1).select(self._epoch(newest, news).alias("e")).first()["e"]
        if newest is None or newest.parts == self.parts:
            of_rows = news.where(F.col(ACTION).isin("upsert", "delete"))
            touched = sorted(r[0] for r in of_rows.select(self._part(self.parts)).distinct().collect())
            old = self._snapshot({p: layout[p] for p in touched if p in layout})
        else:
            touched, old = list(range(self.parts)), self._snapshot(layout)
        if touched:
            merged = ch.merge(old, news, self.keys, self.values, self._epoch(newest, news), self.route.whole_images)
            (
                merged.withColumns({"_fold": F.lit(fold), "_part": self._part(self.parts)})
                .hint("rebalance", F.col("_part"))  # whole parts to a task, large ones to several
                .write.mode("append").partitionBy("_fold", "_part").parquet(f"{self.path}/state")
            )
        self._add("folds", (version, fold, self.parts, touched, runs, epoch), FOLDS)
        self.expire(keep)
        return version

    def state(self) -> DataFrame:
        """Latest row per key, tombstones included."""
        newest, news = self._newest(), self.changes()
        epoch = self._epoch(newest, news)
        if newest is None:
            return ch.latest(news, self.keys, self.values, epoch, self.route.whole_images)
        held = self._snapshot(self.layout())
        if news.isEmpty():
            return ch.after_truncate(held, epoch)
        return ch.merge(held, news, self.keys, self.values, epoch, self.route.whole_images)

    def read(self) -> DataFrame:
        """The target as its readers see it."""
        return ch.visible(self.state()).select(*self.route.schema.fieldNames())

    # ------------------------------------------------------------------ upkeep

    def expire(self, keep: int = 2) -> None:
        """Delete the changes that are folded, and parts that none of the last ``keep`` versions reads.

        Keep at least two for readers still on the last one. Rejected changes stay. A file that is deleted late or
        never is only room lost: no row leads to it.
        """
        newest = self._newest()
        if newest is None:
            return
        folds = self._rows("folds", FOLDS)
        last = newest.version - max(keep, 1) + 1  # changes folded since may still be read as news
        done = folds.where(F.col("version") <= last).select(F.explode("runs").alias("run"))
        held = folds.select("parts", "version", "fold", F.explode("touched").alias("part"))
        later = held.select("parts", "part", F.col("version").alias("next"))
        replaced = held.join(later, ["parts", "part"]).where((F.col("next") > F.col("version")) & (F.col("next") <= last))
        layouts = folds.where(F.col("version") <= last).agg(F.max_by("parts", "version")).first()[0]
        former = held.where((F.col("parts") != layouts) & (F.col("version") <= last))
        gone = replaced.select("fold", "part").union(former.select("fold", "part")).distinct()
        self._delete(
            [f"changes/_run={r.run}/_usable=true" for r in done.collect()]
            + [f"state/_fold={r.fold}/_part={r.part}" for r in gone.collect()]
        )
        for name, schema in (("commits", COMMITS), ("folds", FOLDS)):
            self._gather(name, schema)

    def _gather(self, name: str, schema: str) -> None:
        """Many small files as one; a row that stands in both for a while says the same twice."""
        rows = self._rows(name, schema)
        files = rows.inputFiles()
        if len(files) > SMALL_FILES:
            rows.distinct().coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")
            self._delete(files)

    def _delete(self, names: list[str]) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(name if "://" in name or name.startswith(("/", "file:")) else f"{self.path}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
