"""Rows told apart by their key before they are shuffled.

A bit map of the hashed keys goes to all tasks. It has at most 16 MB (2**27 slots): with more than some ten million
keys it fills up, and more rows count as possible. It never misses a key, so what it rules out needs no join; what
it lets through still has to meet the keys themselves.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm import text as tx
from tidegate.llm.repeats import BitMap, bit_map


def hashed(key: str) -> Column:
    return F.xxhash64(key).alias("hash")


def taken(keys: DataFrame) -> Broadcast[BitMap]:
    """The bit map of ``keys``, a saved table of one column."""
    return keys.sparkSession.sparkContext.broadcast(bit_map(keys.select(hashed(keys.columns[0]))))


def possibly(key: str, keys: DataFrame) -> Column:
    """Whether column ``key`` may be among ``keys``, a saved table of one column of the same type."""
    known = taken(keys)

    @F.arrow_udf("boolean")
    def has(hashes: pa.Array) -> pa.Array:
        return pa.array(known.value.has(hashes.to_numpy(zero_copy_only=False).view(tx.U)))

    return has(hashed(key))
