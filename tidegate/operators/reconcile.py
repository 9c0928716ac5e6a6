"""Compare a source with a target: counts, key digests, profiles, metrics, structure, keys.

Each check works on ``Pair`` objects and returns one row per table (or column, or key). The
aggregates of all tables are unioned before they are compared, so one job covers any number
of tables and every shuffle carries partial aggregates, not rows.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.functions.values import (
    ROW_SEPARATOR,
    canon,
    check_identifier,
    portable_hash,
    row_hash,
    row_text,
)
from tidegate.operators import schema as structure

# The status names.
OK, MISMATCH, SKIPPED, ERROR = "ok", "mismatch", "skipped", "error"
TARGET_MISSING, SOURCE_ERROR = "target_missing", "source_error"

DIFF_BUCKETS = 4096


@dataclass(frozen=True)
class Pair:
    """A table on both sides; a side that could not be opened is None."""

    table: str
    source: DataFrame | None
    target: DataFrame | None
    source_message: str | None = None
    target_message: str | None = None


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def _sides(pair: Pair) -> list[tuple[str, DataFrame]]:
    return [(s, df) for s, df in (("source", pair.source), ("target", pair.target)) if df is not None]


def _of(side: str, column: str) -> Column:
    return F.max(F.when(F.col("side") == side, F.col(column))).alias(f"{side}_{column}")


def _status(same: Column, source_seen: Column, target_seen: Column) -> Column:
    return (
        F.when(~source_seen, SOURCE_ERROR)
        .when(~target_seen, TARGET_MISSING)
        .when(same, OK)
        .otherwise(MISMATCH)
    )


def _paired(frames: Sequence[DataFrame], *columns: str) -> DataFrame:
    return _union(frames).groupBy("table").agg(*[_of(s, c) for c in columns for s in ("source", "target")])


def row_count(pairs: Sequence[Pair]) -> DataFrame:
    """Rows per table on both sides."""
    counts = [
        df.agg(F.count("*").alias("count")).select(
            F.lit(p.table).alias("table"), F.lit(side).alias("side"), "count"
        )
        for p in pairs
        for side, df in _sides(p)
    ]
    same = F.col("source_count") == F.col("target_count")
    return _paired(counts, "count").select(
        "table",
        "source_count",
        "target_count",
        (F.col("target_count") - F.col("source_count")).alias("diff"),
        _status(same, F.col("source_count").isNotNull(), F.col("target_count").isNotNull()).alias("status"),
    )


def _snapshot(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count of the keys and two independent sums of their hashes, as text: no list, at any size."""
    text = row_text(list(keys))
    sums = [F.coalesce(F.sum(portable_hash(t)), F.lit(0)).cast("string") for t in (text, F.concat(text, F.lit(ROW_SEPARATOR)))]
    return df.agg(F.count("*").alias("count"), F.concat_ws(":", *sums).alias("hash"))


def pk_snapshot(pairs: Sequence[Pair], keys: Sequence[str]) -> DataFrame:
    """Whether both sides hold the same primary keys, compared by count and hash sums of all of them."""
    if not keys:
        raise ValueError("a key snapshot needs primary key columns")
    snapshots = [
        _snapshot(df, keys).select(F.lit(p.table).alias("table"), F.lit(side).alias("side"), "count", "hash")
        for p in pairs
        for side, df in _sides(p)
    ]
    same = (F.col("source_count") == F.col("target_count")) & (F.col("source_hash") == F.col("target_hash"))
    return _paired(snapshots, "count", "hash").select(
        "table",
        "source_count",
        "target_count",
        "source_hash",
        "target_hash",
        _status(same, F.col("source_count").isNotNull(), F.col("target_count").isNotNull()).alias("status"),
    )


def pk_digest(pairs: Sequence[Pair], keys: Sequence[str]) -> DataFrame:
    """Order-insensitive key digest without a size limit: count and sum of 60-bit hashes."""
    digests = [
        df.select(portable_hash(row_text(list(keys))).alias("h"))
        .agg(F.count("*").alias("count"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("digest"))
        .select(F.lit(p.table).alias("table"), F.lit(side).alias("side"), "count", "digest")
        for p in pairs
        for side, df in _sides(p)
    ]
    same = (F.col("source_count") == F.col("target_count")) & (
        F.col("source_digest") == F.col("target_digest")
    )
    return _paired(digests, "count", "digest").select(
        "table",
        "source_count",
        "target_count",
        "source_digest",
        "target_digest",
        _status(same, F.col("source_count").isNotNull(), F.col("target_count").isNotNull()).alias("status"),
    )


PROFILE = ("count", "distinct", "min", "max")


def _value_text(df: DataFrame, name: str) -> Column:
    """Text that is equal exactly where the values are."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (F.col(name) + F.lit(0.0)).cast("string")  # one zero
    if isinstance(kind, T.BinaryType):
        return F.hex(name)
    return F.col(name).cast("string")


def _profile_parts(df: DataFrame, columns: Sequence[str]) -> list[DataFrame]:
    """Count, minimum, maximum in one pass; exact distinct counts over (column, value) pairs.

    The pairs are combined before the shuffle, so a value that fills a column travels once per
    task, and wide tables do not multiply the width of a row as several distinct counts in
    one aggregate would.
    """
    aggregates: list[Column] = []
    for i, name in enumerate(columns):
        aggregates += [F.count(name).alias(f"n{i}"), F.min(name).alias(f"lo{i}"), F.max(name).alias(f"hi{i}")]
    entry = lambda i, name: F.struct(
        F.lit(name).alias("column"),
        F.col(f"n{i}").cast("string").alias("count"),
        F.lit(None).cast("string").alias("distinct"),
        F.col(f"lo{i}").cast("string").alias("min"),
        F.col(f"hi{i}").cast("string").alias("max"),
    )
    plain = df.agg(*aggregates).select(F.inline(F.array(*[entry(i, c) for i, c in enumerate(columns)])))
    pairs = F.array(
        *[F.struct(F.lit(i).alias("at"), _value_text(df, c).alias("value")) for i, c in enumerate(columns)]
    )
    distinct = (
        df.select(F.inline(pairs))
        .where(F.col("value").isNotNull())
        .groupBy("at", "value")
        .agg(F.lit(1))
        .groupBy("at")
        .agg(F.count("*").cast("string").alias("distinct"))
        .select(
            F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("at") + 1).alias("column"), "distinct"
        )
    )
    return [plain, distinct]


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, exact distinct count, minimum and maximum per column, as text."""
    both = functools.reduce(
        lambda x, y: x.unionByName(y, allowMissingColumns=True), _profile_parts(df, columns)
    )
    return both.groupBy("column").agg(*[F.max(part).alias(part) for part in PROFILE])


def field_value(pairs: Sequence[Pair], columns: Sequence[str]) -> DataFrame:
    """Field profiles side by side, one row per table and column."""
    if not columns:
        raise ValueError("a field profile needs columns")
    frames = [
        part.select(F.lit(p.table).alias("table"), F.lit(side).alias("side"), "*")
        for p in pairs
        for side, df in _sides(p)
        for part in _profile_parts(df, columns)
    ]
    every = functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
    both = every.groupBy("table", "column").agg(
        *[_of(side, part) for side in ("source", "target") for part in PROFILE],
        F.bool_or(F.col("side") == "source").alias("in_source"),
        F.bool_or(F.col("side") == "target").alias("in_target"),
    )
    # a column without values has no distinct entry
    shown = lambda side, part: (
        F.coalesce(f"{side}_{part}", F.lit("0")) if part == "distinct" else canon(f"{side}_{part}")
    )
    text = lambda side: F.when(
        F.col(f"in_{side}"), F.concat_ws("|", *[shown(side, part) for part in PROFILE])
    )
    return both.select(
        "table", "column", text("source").alias("source_values"), text("target").alias("target_values"),
        "in_source", "in_target",
    ).select(
        "table", "column", "source_values", "target_values",
        _status(
            F.col("source_values") == F.col("target_values"), F.col("in_source"), F.col("in_target")
        ).alias("status"),
    )


def _metric_row(df: DataFrame, template: str, table: str) -> DataFrame:
    """First row of the metric over ``df``, all its values as one text array."""
    # the braces stand for the table under test, whatever qualification the text gives it
    text = template.replace("{schema}.", "").replace("`{table}`", "{table}")
    result = df.sparkSession.sql(text, table=df).limit(1)
    values = F.array(*[canon(F.col(f"`{c}`")) for c in result.columns])
    return result.select(values.alias("values"))


def metric(pairs: Sequence[Pair], template: str) -> DataFrame:
    """A business metric in SQL over ``{schema}.{table}``, its first row compared as text."""
    if not template.strip():
        raise ValueError("a metric check needs SQL")
    for p in pairs:
        check_identifier(p.table)
    frames = [
        _metric_row(df, template, p.table)
        .groupBy()
        .agg(F.coalesce(F.first("values"), F.array().cast("array<string>")).alias("values"))
        .select(F.lit(p.table).alias("table"), F.lit(side).alias("side"), "values")
        for p in pairs
        for side, df in _sides(p)
    ]
    same = F.col("source_values") == F.col("target_values")
    return _paired(frames, "values").select(
        "table",
        F.array_join("source_values", "|").alias("source_values"),
        F.array_join("target_values", "|").alias("target_values"),
        _status(same, F.col("source_values").isNotNull(), F.col("target_values").isNotNull()).alias("status"),
    )


def metadata(
    source_columns: DataFrame, target_columns: DataFrame, source_type: str = "mysql",
    keys: Sequence[str] = structure.TABLE,
) -> DataFrame:
    """Structure per table: columns to add, drop and modify."""
    matched = structure.match_columns(source_columns, target_columns, source_type, "sync", keys)
    counts = matched.groupBy(*keys).agg(
        F.count_if("source_present").alias("source_columns"),
        F.count_if("target_present").alias("target_columns"),
        F.count_if("missing").alias("to_add"),
        F.count_if("extra").alias("to_drop"),
        F.count_if("modify").alias("to_modify"),
    )
    changes = F.col("to_add") + F.col("to_drop") + F.col("to_modify")
    return counts.select(
        "*",
        F.when(F.col("target_columns") == 0, TARGET_MISSING)
        .when(changes == 0, OK)
        .otherwise(MISMATCH)
        .alias("status"),
    )


def summary(details: DataFrame) -> DataFrame:
    """Totals of a run: everything that is not ok is a mismatch, and each status by itself."""
    by = lambda status: F.count_if(F.col("status") == status)
    return details.agg(
        F.count("*").alias("total"),
        by(OK).alias("ok"),
        (F.count("*") - by(OK)).alias("mismatch"),
        by(MISMATCH).alias("different"),
        by(TARGET_MISSING).alias("missing"),
        by(SOURCE_ERROR).alias("errors"),
        by(SKIPPED).alias("skipped"),
    )


def alerts(details: DataFrame) -> DataFrame:
    """Rows that need attention."""
    return details.where(F.col("status") != OK)


def key_diff(
    source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str],
    buckets: int = DIFF_BUCKETS,
) -> DataFrame:
    """Keys that are missing in the target, extra there, or whose rows differ.

    A first pass sums row hashes per key bucket on both sides; only rows of differing
    buckets take part in the per-key pass. Both passes are hash aggregates with map-side
    combine, so a key that fills a third of a side still shuffles as one row per task.
    """
    hashed = lambda df, sign: df.select(
        *keys,
        F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket"),
        row_hash([*keys, *columns]).alias("hash"),
        F.lit(sign).alias("side"),
    )
    both = hashed(source, 1).unionByName(hashed(target, -1))
    # equal sides cancel out: rows and hashes both sum to zero
    differing = (
        both.groupBy("bucket")
        .agg(F.sum("side").alias("rows"), F.sum(F.col("hash") * F.col("side")).alias("hashes"))
        .where((F.col("rows") != 0) | (F.col("hashes") != 0))
        .select("bucket")
    )
    per_side = lambda sign, value: F.sum(F.when(F.col("side") == sign, value).otherwise(0))
    per_key = (
        # at most ``buckets`` rows of one integer
        both.join(F.broadcast(differing), "bucket", "left_semi")
        .groupBy(*keys)
        .agg(
            per_side(1, F.lit(1)).alias("source_rows"),
            per_side(-1, F.lit(1)).alias("target_rows"),
            F.sum(F.col("hash") * F.col("side")).alias("hashes"),
        )
    )
    return per_key.where((F.col("source_rows") != F.col("target_rows")) | (F.col("hashes") != 0)).select(
        *keys,
        F.when(F.col("target_rows") == 0, "missing_in_target")
        .when(F.col("source_rows") == 0, "extra_in_target")
        .otherwise("changed")
        .alias("change"),
        "source_rows",
        "target_rows",
    )


# ------------------------------------------------------------ tree of digests

# Rows of a leaf, about, levels one step descends, and the deepest tree.
LEAF_ROWS = 1024
STEP = 6
DEEPEST = 40


def depth_for(rows: int, leaf_rows: int = LEAF_ROWS) -> int:
    """Levels of a binary tree whose leaves hold about ``leaf_rows`` of ``rows``."""
    return min(max(-(-rows // leaf_rows) - 1, 0).bit_length(), DEEPEST)


def key_digests(df: DataFrame, keys: Sequence[str], columns: Sequence[str], depth: int) -> DataFrame:
    """Leaves of a side's tree: ``leaf, rows, hashes``; a leaf is a run of the keys' hashes.

    One scan with map-side combine. Kept with a run, a side that has not changed since need not be read again. Trees
    of one depth compare; ``coarser`` brings them there.
    """
    leaf = F.shiftrightunsigned(F.xxhash64(*keys), 64 - depth) if depth else F.lit(0).cast("bigint")
    return (
        df.select(leaf.alias("leaf"), row_hash([*keys, *columns]).alias("hash"))
        .groupBy("leaf")
        .agg(F.count("*").alias("rows"), F.sum("hash").alias("hashes"))
    )


def coarser(digests: DataFrame, levels: int) -> DataFrame:
    """The same tree, cut so many levels higher: sums of sums, no scan of the rows."""
    up = digests.select(F.shiftright("leaf", levels).alias("leaf"), "rows", "hashes")
    return up.groupBy("leaf").agg(F.sum("rows").alias("rows"), F.sum("hashes").alias("hashes"))


def differing_leaves(source: DataFrame, target: DataFrame, depth: int, step: int = STEP) -> DataFrame:
    """Leaves whose digests differ, found from the root down: only children of differing nodes are compared."""
    old = source.select("leaf", F.col("rows").alias("n"), F.col("hashes").alias("h"))
    new = target.select("leaf", (-F.col("rows")).alias("n"), (-F.col("hashes")).alias("h"))
    both = old.unionByName(new)
    open_nodes, level = None, 0
    while True:
        level = min(level + step, depth)
        nodes = both.withColumn("node", F.shiftright("leaf", depth - level))
        if open_nodes is not None:
            above = F.shiftright("leaf", depth - level + taken).alias("parent")  # noqa: F821
            nodes = nodes.withColumn("parent", above).join(open_nodes, "parent", "left_semi")
        sums = nodes.groupBy("node").agg(F.sum("n").alias("n"), F.sum("h").alias("h"))
        found = sums.where("n <> 0 or h <> 0").select("node")
        if level == depth:
            return found.select(F.col("node").alias("leaf"))
        taken = min(step, depth - level)
        open_nodes = found.select(F.col("node").alias("parent"))


def key_diff_deep(
    source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str], depth: int,
    source_digests: DataFrame | None = None, target_digests: DataFrame | None = None,
) -> DataFrame:
    """``key_diff`` by trees of digests: any number of differences, and digests of an earlier run where they are given.

    Rows of differing leaves are the only ones that take part in the per-key pass. The leaves are joined, not sent
    to every task, as their number follows the differences.
    """
    if source_digests is None:
        source_digests = key_digests(source, keys, columns, depth)
    if target_digests is None:
        target_digests = key_digests(target, keys, columns, depth)
    leaves = differing_leaves(source_digests, target_digests, depth)
    leaf = F.shiftrightunsigned(F.xxhash64(*keys), 64 - depth) if depth else F.lit(0).cast("bigint")
    left, right = (df.withColumn("_leaf", leaf).join(leaves.select(F.col("leaf").alias("_leaf")), "_leaf", "left_semi").drop("_leaf") for df in (source, target))
    return key_diff(left, right, keys, columns, buckets=1)


# ------------------------------------------------------------------- sketches

# Fixed value: registers of a sketch, as a power of two.
REGISTERS = 12


def distinct_sketches(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One mergeable sketch of the different values of each column: ``column, sketch``. Kept with a run, or by day."""
    sketches = [
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"s{n}"), F.lit(None).cast("binary")).alias("sketch"))
        for n, c in enumerate(columns)
    ]
    made = df.agg(*[F.hll_sketch_agg(_value_text(df, c), REGISTERS).alias(f"s{n}") for n, c in enumerate(columns)])
    return made.select(F.inline(F.array(*sketches)))


def merged_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of parts (days, files) as one for each column."""
    return sketches.groupBy(*by, "column").agg(F.hll_union_agg("sketch").alias("sketch"))


def distinct_values(
    source: DataFrame, target: DataFrame, columns: Sequence[str], source_sketches: DataFrame | None = None,
    target_sketches: DataFrame | None = None,
) -> DataFrame:
    """Whether a column has the same different values on both sides, screened by sketches.

    The estimate of a united sketch follows from the values alone, so estimates that differ prove that the values do,
    and no exact pass is needed (``proved_by`` sketch). Where they are equal, number and hash sum of the values decide (values).
    """
    if source_sketches is None:
        source_sketches = distinct_sketches(source, columns)
    if target_sketches is None:
        target_sketches = distinct_sketches(target, columns)
    # what a sketch estimates depends on the order of its values until it is united with another; a lone one of one
    # part is only copied, so each is united with itself: from there on the estimate follows from the values alone
    estimate = F.hll_sketch_estimate(F.hll_union("sketch", "sketch"))
    estimates = lambda sketches, name: merged_sketches(sketches).select("column", estimate.alias(name))
    screened = estimates(source_sketches, "s").join(estimates(target_sketches, "t"), "column")
    screened = {r["column"]: r.s == r.t for r in screened.collect()}  # one row for each column
    spark = source.sparkSession
    proved = spark.createDataFrame([(c, MISMATCH, "sketch") for c in columns if not screened[c]], "column string, status string, proved_by string")
    equal = [c for c in columns if screened[c]]
    if not equal:
        return proved
    sides = []
    for sign, df in ((1, source), (-1, target)):
        cells = F.array(*[F.struct(F.lit(c).alias("column"), _value_text(df, c).alias("value")) for c in equal])
        sides.append(df.select(F.inline(cells)).where("value is not null").distinct().withColumn("sign", F.lit(sign)))
    listed = spark.createDataFrame([(c,) for c in equal], "column string")
    hashed = F.xxhash64("value").cast("decimal(20,0)") * F.col("sign")
    sums = sides[0].unionByName(sides[1]).groupBy("column").agg(F.sum("sign").alias("n"), F.sum(hashed).alias("h"))
    exact = listed.join(sums, "column", "left").select(
        "column", F.when((F.coalesce("n", F.lit(0)) == 0) & (F.coalesce("h", F.lit(0)) == 0), OK).otherwise(MISMATCH).alias("status"),
        F.lit("values").alias("proved_by"),
    )
    return proved.unionByName(exact)


def recent_runs(runs: DataFrame, newest: int = 10, task: str = "task_name", order: str = "ran_at") -> DataFrame:
    """The latest runs of each task; ties go to the larger run id."""
    latest = Window.partitionBy(task).orderBy(F.col(order).desc(), F.col("run_id").desc())
    return runs.withColumn("recency", F.row_number().over(latest)).where(F.col("recency") <= newest)
