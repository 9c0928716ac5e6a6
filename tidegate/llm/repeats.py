"""Substring dedup by super-k-mers: finds every run of words that stands in the corpus more than once.

A window is ``width`` consecutive words. Its minimiser is the leftmost of its runs of ``SEED`` words with the
smallest hash, so equal windows have equal minimisers. Consecutive windows that share a minimiser's place travel
as one packed string to the bucket of that minimiser, where sorting counts windows.

First only minimisers are counted. A window whose minimiser stands nowhere else has no second occurrence, and
strings of such windows stay at home. They are told by a bit map of at most 2**27 bits: where it fills up, more
strings travel, and the result is the same. Equal strings are combined before the shuffle, so a passage of
thousands of documents is one string with a count. A bucket of more than ``CROWD`` different strings (a line common
in different surroundings) is dealt out by single windows instead.

Sorting goes by 64-bit hashes; windows with equal hashes count as equal only if their bytes are.

A null text has no words. Rows are told apart by doc_id and text; repeated rows count as occurrences of their own.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm import text as tx
from tidegate.llm.store import saved

SEED = 8
#: Bits of a slot number in the bit map, at least and at most.
SLOTS = 20, 27
CROWD = 2000


class Split:
    """Words, and super-k-mers by their first window and number of windows, of some texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int):
        self.data = data
        self.starts, self.ends, self.bounds = tx.word_spans(data, offsets)
        words = tx.spans_hash(data, self.starts, self.ends)
        self.first = self.count = np.zeros(0, np.int64)
        self.minimiser = np.zeros(0, tx.U)
        seed = min(SEED, width)
        seeds = tx.windows_hash(words, seed)
        span = width - seed + 1  # seeds in a window
        windows = len(seeds) - span + 1
        if windows <= 0:
            return
        place = np.arange(len(seeds))
        low, at, have = seeds, place, 1
        while have < span:  # the minimum over ever longer runs of seeds
            step = min(have, span - have)
            left, right = low[: len(low) - step], low[step:]
            at = np.where(left <= right, at[: len(at) - step], at[step:])
            low = np.minimum(left, right)
            have += step
        owner = tx.owners(self.bounds)
        inside = owner[:windows] == owner[width - 1 :]
        fresh = np.ones(windows, bool)
        fresh[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
        first = np.flatnonzero(fresh & inside)
        ends = np.flatnonzero(np.append(fresh[1:] | ~inside[1:], True) & inside) + 1
        self.first, self.count, self.minimiser, self.owner = first, ends - first, low[first], owner

    def packed(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one blank between them, and where each begins and ends."""
        lengths = self.ends - self.starts
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        out = np.full(ends[-1] + 1 if len(ends) else 0, 0x20, np.uint8)
        inside = np.flatnonzero(~tx.BLANK[self.data])
        out[inside + np.repeat(starts - self.starts, lengths)] = self.data[inside]
        return out.tobytes(), starts, ends


class BitMap:
    """Which slots (the last bits: the first ones of a minimum are mostly zero) of 64-bit hashes are taken."""

    def __init__(self, slots: int):
        self.slots = slots
        self.words = np.zeros(1 << (slots - 5), np.uint32)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes & tx.U((1 << self.slots) - 1)
        return (self.words[slot >> tx.U(5)] >> (slot & tx.U(31)).astype(np.uint32)) & 1 == 1


def _minimisers(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tx.pieces(batches, "text"):
            values, counts = np.unique(Split(*tx.bytes_of(piece.column("text")), width).minimiser, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], ["minimiser", "n"])

    return run


def _row_hash(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return tx.spans_hash(data, offsets[:-1], offsets[1:]).view(np.int64)


STRINGS = "minimiser long, words binary, id long, text_hash long, first int, count int"


def _strings(width: int, repeated):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tx.pieces(batches, "text"):
            data, offsets = tx.bytes_of(piece.column("text"))
            split = Split(data, offsets, width)
            keep = np.flatnonzero(repeated.value.has(split.minimiser))
            if not len(keep):
                continue
            buffer, starts, ends = split.packed()
            first, count = split.first[keep], split.count[keep]
            owner = split.owner[first]
            cut = [buffer[a:b] for a, b in zip(starts[first], ends[first + count + width - 2], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(split.minimiser[keep].view(np.int64)),
                    pa.array(cut, pa.binary()),
                    piece.column("id").take(pa.array(owner)),
                    pa.array(_row_hash(data, offsets)[owner]),
                    pa.array((first - split.bounds[owner]).astype(np.int32)),
                    pa.array(count.astype(np.int32)),
                ],
                ["minimiser", "words", "id", "text_hash", "first", "count"],
            )

    return run


def _ranges(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of each run of set flags that have one owner."""
    if not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = owner[1:] != owner[:-1]
    begin = flags & np.append(True, ~flags[:-1] | cut)
    end = flags & np.append(~flags[1:] | cut, True)
    return np.flatnonzero(begin), np.flatnonzero(end)


def repeated_windows(strings: list[bytes], counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the strings, in order: the string's number, and whether the window stands anywhere else."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    offsets = np.cumsum([0, *map(len, strings)])
    starts, ends, bounds = tx.word_spans(data, offsets)
    hashes = tx.windows_hash(tx.spans_hash(data, starts, ends), width)
    owner = tx.owners(bounds)
    at = np.flatnonzero(owner[: len(hashes)] == owner[width - 1 :]) if len(hashes) else np.zeros(0, np.int64)
    flags = counts[owner[at]] > 1
    order = np.argsort(hashes[at], kind="stable")
    h = hashes[at][order]
    same = np.flatnonzero(h[1:] == h[:-1])
    buffer = data.tobytes()
    begin, end = starts[at[order]], ends[at[order] + width - 1]
    for k in same:
        if buffer[begin[k] : end[k]] == buffer[begin[k + 1] : end[k + 1]]:
            flags[order[k]] = flags[order[k + 1]] = True
        else:  # different windows with one hash: look through all of that hash
            run = np.flatnonzero(h == h[k])
            seen: dict[bytes, int] = {}
            for r in run:
                other = seen.setdefault(buffer[begin[r] : end[r]], r)
                if other != r:
                    flags[order[r]] = flags[order[other]] = True
    return owner[at], flags


FOUND = "words binary, lo int, hi int"


def _counted(width: int):
    """Per string the ranges of its windows that are repeated; rows come sorted by minimiser, whole buckets at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.whole_groups(batches, "minimiser"):
            strings = [x.as_py() for x in batch.column("words")]
            owner, flags = repeated_windows(strings, batch.column("n").to_numpy(zero_copy_only=False), width)
            lo, hi = _ranges(flags, owner)
            base = np.searchsorted(owner, owner[lo]) if len(lo) else lo
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("words").take(pa.array(owner[lo])),
                    pa.array((lo - base).astype(np.int32)),
                    pa.array((hi - base).astype(np.int32)),
                ],
                ["words", "lo", "hi"],
            )

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes the words of the ranges (lo, hi) of windows and names what is left."""
    for piece in tx.pieces(batches, "text"):
        data, offsets = tx.bytes_of(piece.column("text"))
        starts, ends, bounds = tx.word_spans(data, offsets)
        buffer = data.tobytes()
        removed, texts = [], []
        for d, ranges in enumerate(piece.column("ranges").to_pylist()):
            a, b = bounds[d], bounds[d + 1]
            if ranges:
                change = np.zeros(b - a + 1, np.int64)
                np.add.at(change, [r["lo"] for r in ranges], 1)
                np.add.at(change, [r["hi"] for r in ranges], -1)
                at = a + np.flatnonzero(np.cumsum(change)[:-1] == 0)
            else:
                at = np.arange(a, b)
            removed.append(int(b - a - len(at)))
            texts.append(b" ".join([buffer[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]))
        yield pa.RecordBatch.from_arrays(
            [
                piece.column("doc_id"),
                pa.array(np.diff(bounds).astype(np.int64)),
                pa.array(removed, pa.int64()),
                pa.array(texts, pa.binary()),
            ],
            ["doc_id", "n_words", "n_removed", "kept"],
        )


def bit_map(hashes: DataFrame) -> BitMap:
    """The slots of the 64-bit hashes (a column ``hash``); sixteen slots for each of them, within the bounds."""
    least, most = SLOTS
    out = BitMap(min(max((16 * hashes.count()).bit_length(), least), most))
    words = (
        hashes.select(F.col("hash").bitwiseAND(F.lit((1 << out.slots) - 1)).alias("slot"))
        .groupBy(F.shiftright("slot", 5).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, int(slot % 32)))").alias("bits"))
        .toArrow()
    )
    out.words[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return out


def _identity() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id")


def without_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """Per document ``doc_id, n_words, n_removed, kept``: its words (UTF-8, one blank between them) that no repeated window covers."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _identity(), "text")
    minimisers = texts.mapInArrow(_minimisers(width), "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n"))
    repeated = saved(minimisers.filter("n > 1").select("minimiser"), "repeated")
    repeated = docs.sparkSession.sparkContext.broadcast(bit_map(repeated.toDF("hash")))
    strings = saved(texts.mapInArrow(_strings(width, repeated), STRINGS), "strings")
    different = strings.groupBy("minimiser", "words").agg(F.count("*").alias("n"))
    different = saved(different, "different")
    crowds = different.groupBy("minimiser").agg(F.count("*").alias("m")).filter(F.col("m") > CROWD).select("minimiser")
    crowds = saved(crowds, "crowds")
    found = (
        different.join(crowds, "minimiser", "left_anti")
        .repartition("minimiser")
        .sortWithinPartitions("minimiser")
        .mapInArrow(_counted(width), FOUND)
    )
    alone = different.join(crowds, "minimiser", "left_semi").select("words", "n", F.split(F.col("words").cast("string"), " ").alias("w"))
    alone = alone.select(
        "words", "n", F.posexplode(F.expr(f"transform(sequence(1, size(w) - {width - 1}), i -> array_join(slice(w, i, {width}), ' '))")).alias("lo", "window")
    )
    twice = alone.groupBy("window").agg(F.sum("n").alias("total")).filter("total > 1").select("window")
    found = found.union(alone.join(twice, "window", "left_semi").select("words", "lo", F.col("lo").alias("hi")))
    found = saved(found.select(F.unhex(F.md5("words")).alias("name"), "lo", "hi"), "repeats")
    ranges = (
        strings.select(F.unhex(F.md5("words")).alias("name"), "id", "text_hash", "first")
        .join(found, "name")
        .select("id", "text_hash", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi") + width).alias("hi"))
        .groupBy("id", "text_hash")
        .agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    )
    ranges = saved(ranges, "ranges")
    hashed = texts.mapInArrow(_with_hash, "doc_id long, id long, text string, text_hash long")
    return hashed.join(ranges, ["id", "text_hash"], "left").select("doc_id", "text", "ranges").mapInArrow(
        _kept, "doc_id long, n_words long, n_removed long, kept binary"
    )


def _with_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in tx.pieces(batches, "text"):
        hashes = pa.array(_row_hash(*tx.bytes_of(piece.column("text"))))
        yield pa.RecordBatch.from_arrays([*piece.columns, hashes], [*piece.schema.names, "text_hash"])

