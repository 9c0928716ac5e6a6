"""Request-log analytics over an event table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.values import DEFAULT_ZONE, local_date

# What is always kept, what is static, and report sizes.
KEPT_PREFIXES = ["/api/", "/admin/"]
STATIC_PREFIXES = ["/static/", "/favicon.ico"]
STATIC_SUFFIXES = [".js", ".css", ".png", ".ico"]
DAYS_DEFAULT = 7
ERROR_STATUS = 400
TOP_PATHS, RECENT = 12, 30


def _any(path: Column, test: str, parts: list[str]) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | getattr(path, test)(part)
    return hit


def is_recorded(path: Column) -> Column:
    """API and admin requests always; others unless they fetch a static file."""
    path = F.coalesce(path, F.lit(""))
    static = _any(path, "startswith", STATIC_PREFIXES) | _any(path, "endswith", STATIC_SUFFIXES)
    return _any(path, "startswith", KEPT_PREFIXES) | ~static


def ingest(requests: DataFrame) -> DataFrame:
    """The requests worth recording."""
    return requests.where(is_recorded(F.col("path")))


def window(requests: DataFrame, now: dt.datetime, days: int | str = DAYS_DEFAULT) -> DataFrame:
    """Requests of the last ``days`` days, any positive number of them."""
    days = int(days)
    if days < 1:
        raise ValueError(f"not a positive number of days: {days}")
    return requests.where(F.col("created_at") >= F.lit(now - dt.timedelta(days=days)))


def _rate(part: Column, total: Column) -> Column:
    """Percent with two digits; exact decimals, zero where nothing was requested."""
    share = (part * 100).cast("decimal(38,0)") / F.nullif(total, F.lit(0).cast("bigint")).cast("decimal(20,0)")
    return F.coalesce(F.round(share, 2), F.lit(0)).cast("double")


def totals(requests: DataFrame) -> DataFrame:
    counted = requests.agg(
        F.count("*").alias("total"),
        # a missing status is no error
        F.count_if(F.coalesce(F.col("status_code") >= ERROR_STATUS, F.lit(False))).alias("errors"),
    )
    return counted.select(
        "total",
        "errors",
        _rate(F.col("errors"), F.col("total")).alias("error_rate"),
        _rate(F.col("total") - F.col("errors"), F.col("total")).alias("success_rate"),
    )


def by_day(requests: DataFrame, zone: str = DEFAULT_ZONE) -> DataFrame:
    return requests.groupBy(local_date(F.col("created_at"), zone).alias("day")).agg(F.count("*").alias("count"))


def path_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("method", "path").agg(F.count("*").alias("count"))


def top_paths(requests: DataFrame, top: int = TOP_PATHS) -> DataFrame:
    """Most requested paths; equal counts go by method and path."""
    return path_counts(requests).orderBy(F.desc("count"), "method", "path").limit(top)


def status_distribution(requests: DataFrame) -> DataFrame:
    return requests.groupBy("status_code").agg(F.count("*").alias("count"))


def recent(requests: DataFrame, newest: int = RECENT, tie: str = "event_id") -> DataFrame:
    """Newest requests; equal times go by the larger id."""
    return (
        requests.orderBy(F.desc("created_at"), F.desc(tie))
        .limit(newest)
        .select(tie, "created_at", "method", "path", "status_code", "duration_ms", "username")
    )
