"""Proportional stratified interleaving: shards that all hold the sources in the mixture of the whole.

Each source is shuffled by a seeded hash. Row r of n of a source has the fraction (r - 1/2) / n; sorting all rows
by it interleaves the sources evenly, and cutting that order into equal runs gives every shard the mixture and, at
most one apart, the same number of rows.

Ranks come without a sort of a whole source: rows are dealt by their hash (or fraction) into ranges of about
``RANGE`` rows, the rows before a range are summed over the ranges' counts, and only within a range rows are
numbered. A source with a third of all rows is as many ranges as it needs.

A null source is a source. Repeated rows and null ids are rows like others; rows that are equal in all they are
ordered by take either place. An empty table fills no shard. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.store import saved

RANGE = 2_000


def _before(counts: DataFrame, keys: list[str], part: str) -> DataFrame:
    """To counts (keys, part, n) adds ``before``: the rows of the lower parts of the same keys.

    Parts are summed in groups of 1000 first, so that no window gets more than a thousandth of them.
    """
    counts = counts.withColumn("group", F.floor(F.col(part) / 1000))
    groups = counts.groupBy(*keys, "group").agg(F.sum("n").alias("m"))
    up_to = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    below = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("low", F.coalesce(F.sum("m").over(up_to.partitionBy(*keys)), F.lit(0))).drop("m")
    return counts.join(groups, [*keys, "group"]).select(
        *keys, part, (F.col("low") + F.coalesce(F.sum("n").over(below.partitionBy(*keys, "group")), F.lit(0))).alias("before")
    )


def _part(uniform: Column, rows: Column) -> Column:
    """The range, of about RANGE rows, of a number that is uniform in [0, 1)."""
    return F.floor(uniform * F.ceil(rows / RANGE)).cast("long")


def interleaved(docs: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Per row ``doc_id, size, text_crc32, shard, slot``: slots count from 0 in each shard."""
    key = F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "crc"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("stratum"),
    )
    rows = rows.withColumn("key", key)
    rows = saved(rows, "shard-rows")
    totals = rows.groupBy("stratum").agg(F.count("*").alias("n"))
    totals = saved(totals, "strata")
    total = totals.agg(F.sum("n")).first()[0] or 0
    # the first 12 hexadecimal digits of the key as a fraction
    uniform = F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    parted = rows.join(totals, "stratum").withColumn("part", _part(uniform, F.col("n")))
    counts = parted.groupBy("stratum", "part").agg(F.count("*").alias("n"))
    ranked = (
        parted.join(_before(counts, ["stratum"], "part"), ["stratum", "part"])
        .withColumn("r", F.row_number().over(Window.partitionBy("stratum", "part").orderBy("key", "doc_id", "crc", "size")))
        .select("doc_id", "size", "crc", "stratum", "key", ((F.col("before") + F.col("r") - 0.5) / F.col("n")).alias("fraction"))
    )
    ranked = saved(ranked.withColumn("part", _part(F.col("fraction"), F.lit(total))), "ranked")
    counts = ranked.groupBy("part").agg(F.count("*").alias("n"))
    order = Window.partitionBy("part").orderBy("fraction", "stratum", "key", "doc_id", "crc", "size")
    place = F.col("before") + F.row_number().over(order) - 1
    # row p of N goes to floor(p * shards / N), so a shard begins at ceil(shard * N / shards)
    shard = F.expr(f"place * {shards} div {max(total, 1)}")
    return (
        ranked.join(_before(counts, [], "part"), "part")
        .withColumn("place", place)
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.col("place") - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}"))
        .select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", "slot")
    )
