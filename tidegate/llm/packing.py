"""Hierarchical best-fit packing of token sequences.

Texts are tokenized once; documents longer than ``capacity`` are cut, the first piece taking the odd length. Each
task packs its pieces by best fit, longest first. Bins that are nearly full are final; the others become items of
the next round, in which fewer tasks pack them again, until one task is left or nothing merges. A task holds at most
``ITEMS`` lengths at once, whatever the size of the input. Every round is written to the shared folder, so that a
lost executor doesn't change where pieces went.

Null text is an empty document: it has only the end token. Rows with one doc_id are packed each on its own. Extra
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm import text as tx
from tidegate.llm.store import saved

ITEMS = 1 << 17
#: Free tokens with which a bin counts as nearly full.
NEARLY = 2
FAN_IN = 16
#: Bins that a round leaves for each bin it took; above, further rounds would merge almost nothing.
GAIN = 0.99
CACHED = 500_000

#: In a word: white space of any kind, separators that libraries class differently, special tokens.
_ODD = re.compile(r"[\s\x1c-\x1f\x85]|<\|")


class _OddError(Exception):
    pass


class _Known(dict):
    """Ids of words, found when first asked for."""

    def __init__(self, encode, before: str):
        self.encode, self.before = encode, before

    def __missing__(self, word: str) -> bytes:
        if not word or _ODD.search(word):
            raise _OddError
        if len(self) > CACHED:
            self.clear()
        found = self[word] = array("I", self.encode(self.before + word)).tobytes()
        return found


class Encoder:
    """Token ids (little-endian uint32 bytes) of texts.

    A byte-level pre-tokenizer cuts before every single blank and around every single line end that stand between
    words, so the ids of a word don't depend on its neighbours: they are looked up once and kept. Any other text is
    encoded as a whole. The ranks are those of the tokenizer's own vocabulary; texts that may hold special tokens go
    to the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        of_char = {c: b for b, c in _byte_chars().items()}
        assert set(of_char) == set(ByteLevel.alphabet())
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(of_char[c] for c in t): n for t, n in self.tokenizer.get_vocab().items() if t not in special}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.first, self.rest = _Known(self.encode, ""), _Known(self.encode, " ")
        self.line_end = array("I", self.encode("\n")).tobytes()

    def _line(self, line: str) -> bytes:
        words = line.split(" ")
        return self.first[words[0]] + b"".join(map(self.rest.__getitem__, words[1:]))

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        try:
            return self.line_end.join(map(self._line, text.split("\n")))
        except _OddError:
            if "<|" in text:
                return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            return array("I", self.encode(text)).tobytes()


# fixed values: how byte-level tokenizers cut text before merging
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_chars() -> dict[int, str]:
    """The characters that byte-level vocabularies write bytes with: printable ones for themselves, others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(rest)}


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(path), np.array([end], "<u4").tobytes()
        for batch in tx.pieces(batches, "text", 4 << 20):
            out: list[list] = [[] for _ in range(5)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py() or "") + last
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    length = (n % capacity or capacity) if not start else capacity
                    row = doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])
                    for values, value in zip(out, row, strict=True):
                        values.append(value)
                    start, piece = start + length, piece + 1
            kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(out, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit of the lengths, longest first: bin and offset of each, and the fill of the bins."""
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free room
    rooms: list[int] = []  # the rooms that some bin has, ascending
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for k in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[k])
        at = bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms[at]
            b = open_at[room].pop()
            if not open_at[room]:
                rooms.pop(at)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[k], offsets[k] = b, fill[b]
        fill[b] += length
        left = room - length
        if left:
            if not open_at[left]:
                rooms.insert(bisect_left(rooms, left), left)
            open_at[left].append(b)
    return bins, offsets, np.array(fill, np.int64)


def _packed(capacity: int, level: int, columns: list[str]):
    """Packs the rows of a task by their ``length``; bins are numbered by level, task and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = (level << 56) | (TaskContext.get().partitionId() << 32)
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal serial
            rows = pa.Table.from_batches(held).combine_chunks()
            bins, offsets, fill = best_fit(rows.column("length").to_numpy(), capacity)
            for name, values in (("bin", bins + serial), ("offset", offsets), ("fill", fill[bins])):
                rows = rows.append_column(name, pa.array(values))
            serial += len(fill)
            held.clear()
            yield from rows.select([*columns, "bin", "offset", "fill"]).to_batches()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ITEMS:
                yield from flush()
        if held and any(b.num_rows for b in held):
            yield from flush()

    return run


def packed(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """Per piece ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    names = [f.split()[0] for f in PIECES.split(", ")]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = saved(texts.mapInArrow(_pieces(path, capacity, end), PIECES), "pieces")
    tasks = max(1, -(-pieces.count() // ITEMS))
    placed = saved(
        pieces.repartition(tasks).mapInArrow(_packed(capacity, 0, names), f"{PIECES}, bin long, offset long, fill long"),
        "packed",
    )
    level, moves, items = 0, None, placed
    while True:
        items = items.filter(F.col("fill") < capacity - NEARLY).select("bin", F.col("fill").alias("length")).distinct()
        items = saved(items, "underfull")
        least = items.agg(F.min("length")).first()[0] or 0
        items = items.filter(F.col("length") + least <= capacity)  # no room for any of the others: done
        many = items.count()
        # a task never takes more than its share, however many bins stay underfull
        level, tasks = level + 1, max(1, tasks // FAN_IN, -(-many // ITEMS))
        merged = saved(
            items.withColumnRenamed("bin", "item")
            .repartition(tasks)
            .mapInArrow(_packed(capacity, level, ["item", "length"]), "item long, length long, bin long, offset long, fill long"),
            "merged",
        )
        step = merged.select("item", F.col("bin").alias("to"), F.col("offset").alias("by"))
        if moves is None:
            moves = step
        else:
            onward = step.toDF("to", "next", "further")
            moves = moves.join(onward, "to", "left").select(
                "item", F.coalesce("next", "to").alias("to"), (F.col("by") + F.coalesce("further", F.lit(0))).alias("by")
            )
        if tasks == 1 or merged.select("bin").distinct().count() > GAIN * many:
            break
        moves, items = saved(moves, "moves"), merged
    return placed.join(moves, placed["bin"] == moves["item"], "left").select(
        *names, F.coalesce("to", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset")
    )
