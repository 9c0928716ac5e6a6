"""Exact top-k by inner product: norm-sorted candidates, rotated partial sums, residual bounds.

Vectors are rotated onto the singular vectors of the whole table, so that their first coordinates carry most of
every inner product. Candidates go by descending length. For a block of them, the products over the first
coordinates plus the product of the remaining lengths bounds the score (Cauchy-Schwarz); only where that reaches the
query's k-th best so far is the exact score computed. Bounds allow for rounding; scores of integer vectors are exact.

Queries come in blocks of about ``QUERIES``; each is broadcast (its size is bounded by that number) and scans all
candidates in parallel. A task keeps k candidates per query, and a window takes the best of those.

Vectors of different lengths are compared as if filled up with zeros. Null or non-finite vectors are for the caller to
leave out. A query's own row is every row with its vec_id. Ties go to the smaller vec_id; a query without
candidates has no rows. A candidate row that occurs twice fills two ranks. An empty table has no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.store import saved

QUERIES = 16_384
#: Query-candidate pairs looked at at once.
TILE = 1 << 21
#: The part of the squared lengths that the first coordinates hold.
SHARE = 0.5
ROUNDING = 1e-9


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows, filled up with zeros."""
    lengths = np.array([len(x) for x in column], np.int64) if len(column) else np.zeros(0, np.int64)
    out = np.zeros((len(column), width))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(lengths) and (lengths == width).all():
        return values.reshape(-1, width)
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _moments(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            rows = matrix(batch.column("vector"), width)
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["cell", "value"])

    return run


class Search:
    """The best candidates seen so far for each query of a block."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, rotation: np.ndarray, cut: int, k: int):
        self.ids, self.queries, self.rotation, self.cut, self.k = ids, queries, rotation, cut, k
        turned = queries @ rotation
        self.head = np.ascontiguousarray(turned[:, :cut])
        self.rest = np.linalg.norm(turned[:, cut:], axis=1)
        self.length = np.linalg.norm(queries, axis=1)
        self.least = np.full(len(ids), -np.inf)
        self.best = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        step = max(64, TILE // max(1, len(self.ids)))
        for at in range(0, len(ids), step):
            self._tile(ids[at : at + step], rows[at : at + step])

    def _tile(self, ids: np.ndarray, rows: np.ndarray) -> None:
        lengths = np.linalg.norm(rows, axis=1)
        reach = self.length * lengths.max()
        live = np.flatnonzero(reach * (1 + ROUNDING) + ROUNDING >= self.least)
        if not len(live):
            return
        turned = rows @ self.rotation
        bound = self.head[live] @ turned[:, : self.cut].T
        bound += np.outer(self.rest[live], np.linalg.norm(turned[:, self.cut :], axis=1))
        bound += (ROUNDING * (1 + reach[live]))[:, None]
        may = bound >= self.least[live, None]
        for q, mask in zip(live[may.any(axis=1)].tolist(), may[may.any(axis=1)], strict=True):
            at = np.flatnonzero(mask)
            at = at[ids[at] != self.ids[q]]
            scores = rows[at] @ self.queries[q]
            known, values = self.best[q]
            known, values = np.append(known, ids[at]), np.append(values, scores)
            order = np.lexsort((known, -values))[: self.k]
            self.best[q] = known[order], values[order]
            if len(order) == self.k:
                self.least[q] = values[order[-1]]


RESULT = "query_id long, vec_id long, score long"


def _search(block, rotation: np.ndarray, cut: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = block.value
        search = Search(ids, queries, rotation, cut, k)
        for batch in batches:
            if batch.num_rows:
                search.add(batch.column("vec_id").to_numpy(), matrix(batch.column("vector"), len(rotation)))
        for q, (known, values) in zip(ids.tolist(), search.best, strict=True):
            if len(known):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q] * len(known), pa.int64()), pa.array(known), pa.array(values.astype(np.int64))],
                    ["query_id", "vec_id", "score"],
                )

    return run


def best(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` of ``vectors`` (vec_id, vector: whole numbers) for the rows that are queries."""
    spark = vectors.sparkSession
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    vectors = vectors.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "vector", is_query.alias("q"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = vectors.withColumn("length", length).repartitionByRange(tasks, F.desc("length"), "vec_id")
    ordered = saved(ordered.sortWithinPartitions(F.desc("length"), "vec_id"), "by-length")
    width, queries = ordered.agg(F.max(F.size("vector")), F.count_if("q")).first()
    if not width or not queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cells = ordered.mapInArrow(_moments(width), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    moments = np.zeros(width * width)
    for cell, value in cells.collect():
        moments[cell] = value
    values, rotation = np.linalg.eigh(moments.reshape(width, width))
    values, rotation = values[::-1].clip(0), np.ascontiguousarray(rotation[:, ::-1])
    cut = int(np.searchsorted(np.cumsum(values), SHARE * values.sum())) + 1
    blocks, found = -(-queries // QUERIES), None
    for b in range(blocks):
        own = ordered.filter("q").filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).dropDuplicates(["vec_id"])
        own = own.select("vec_id", "vector").toArrow().combine_chunks()
        if not own.num_rows:
            continue
        block = own.column("vec_id").to_numpy(), matrix(pa.concat_arrays(own.column("vector").chunks), width)
        part = ordered.mapInArrow(_search(spark.sparkContext.broadcast(block), rotation, cut, k), RESULT)
        found = part if found is None else found.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
