"""Run a query and its SQL and compare the two results."""

from __future__ import annotations

import datetime as dt
import decimal
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, decimal.Decimal):
        return value.normalize()
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda n: names[n])
    return Counter(tuple(_plain(r[n]) for n in order) for r in rows)


SPARK_KIND = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
              "date": "DATE"}


def differences(spark, con, query, sql, sf) -> list[str]:
    df = query(spark, sf)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    expected = _rows(names, cursor.fetchall())
    found = _rows(df.columns, [tuple(r) for r in df.collect()])
    problems = []
    if sorted(names) != sorted(df.columns):
        problems.append(f"columns: {sorted(df.columns)} against {sorted(names)}")
    for name, kind in df.dtypes:
        if name in kinds and SPARK_KIND.get(kind, kind) != kinds[name].upper():
            problems.append(f"type of {name}: {kind} against {kinds[name]}")
    if found != expected:
        problems.append(
            f"rows: {sum(found.values())} against {sum(expected.values())}; only here "
            f"{list((found - expected).items())[:3]}; only there {list((expected - found).items())[:3]}"
        )
    if not expected:
        problems.append("no rows at all")
    return problems
