"""Benchmark decontamination by spaced-seed hashing.

A seed is the hash of the words that a fixed mask takes from a stretch of text; substituted words at the places
it skips don't change it. Training texts are scanned for the seeds of the benchmark. Around each hit the item is
laid over the text at that shift, and counts as found where ``least`` hundredths of ``window`` consecutive words
(of the whole item, if it is shorter) are equal. The masks find every overlap of 15 words with up to three substitutions,
and every one that 80 hundredths allow in shorter items; those of 10 and 11 words need stretches of three words for it.

The benchmark is broadcast in blocks of about ``BLOCK_WORDS`` words, whatever its size; each block scans the texts
once, and texts are never shuffled. ``decontaminated`` takes the blocks one after the other in one worker of a task,
which holds the index of one and the texts of ``PASS`` at most: beyond these, what is kept is written before the next
pass. Words are lower-cased A-Z and end at white space or ASCII punctuation. Null
texts have no words. Of items of fewer than ``LEAST_WORDS`` words all words must be equal; items without words never
match. Equal items match each, repeated rows are judged one by one. Without documents or items there are no overlaps;
extra columns are ignored (or kept, by ``decontaminated``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm import text as tx
from tidegate.llm.store import saved

#: Word places that a seed looks at.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 4, 5))
LEAST_WORDS = 8
#: Stretches of 1, 2, ... words, for short items only.
STRETCHES = tuple(tuple(range(n)) for n in range(1, LEAST_WORDS))
BLOCK_WORDS = 200_000
#: Blocks that a pass over the documents takes.
PASS = 64
FILTER_BITS = 22

# white space and ASCII punctuation both end words; letters are lower-cased
PLAIN = tx.LOWER.copy()
PLAIN[[b for b in range(33, 127) if not chr(b).isalnum()]] = 0x20
_WEIGHT = tx.mix(np.arange(1, 17, dtype=tx.U) * tx.U(0x632BE59BD9B4E019)) | tx.U(1)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the number of words before each text."""
    data, offsets = tx.bytes_of(texts)
    data = PLAIN[data]
    starts, ends, bounds = tx.word_spans(data, offsets)
    return tx.spans_hash(data, starts, ends), bounds


def _takes(number: int, lengths: np.ndarray) -> np.ndarray:
    """Whether items of these numbers of words have seeds of mask ``number``."""
    if number < len(MASKS):
        return lengths >= LEAST_WORDS
    n = len(STRETCHES[number - len(MASKS)])
    return (lengths == n) | ((n == 3) & ((lengths == 10) | (lengths == 11)))


def _seeds(words: np.ndarray, number: int) -> np.ndarray:
    """The seed of mask ``number`` at each word that it fits behind."""
    mask = (MASKS + STRETCHES)[number]
    n = max(len(words) - mask[-1], 0)
    out = np.full(n, number, tx.U)
    for k, at in enumerate(mask):
        out += words[at : at + n] * _WEIGHT[k]
    return tx.mix(out)


class Items(NamedTuple):
    """A block of the benchmark: its words, and the places of each seed, by ascending seed."""

    ids: list
    words: np.ndarray
    bounds: np.ndarray
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray
    masks: list[int]  # the numbers of the masks that the items take


def items_of(ids: list, texts: pa.Array) -> Items:
    words, bounds = words_of(texts)
    owner = tx.owners(bounds)
    seeds, item, place, masks = [], [], [], []
    for number, mask in enumerate(MASKS + STRETCHES):
        takes = _takes(number, np.diff(bounds))
        if takes.any():
            masks.append(number)
        found = _seeds(words, number)
        at = np.arange(len(found))
        ok = (owner[: len(found)] == owner[mask[-1] :]) & takes[owner[: len(found)]] if len(found) else at > 0
        seeds.append(found[ok])
        item.append(owner[at[ok]])
        place.append(at[ok] - bounds[owner[at[ok]]])
    seeds, item, place = (np.concatenate(x) for x in (seeds, item, place))
    order = np.argsort(seeds, kind="stable")
    return Items(ids, words, bounds, seeds[order], item[order], place[order], masks)


class Scan:
    """Looks for the items of a block in texts."""

    def __init__(self, items: Items, window: int, least: int):
        self.items, self.window, self.least = items, window, least
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        self.bits[items.seeds >> tx.U(64 - FILTER_BITS)] = True

    def _shifts(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows (text, item, place of the item's first word in the text), each once."""
        items, owner, out = self.items, tx.owners(bounds), [np.zeros((0, 3), np.int64)]
        for number in items.masks:
            mask = (MASKS + STRETCHES)[number]
            seeds = _seeds(words, number)
            at = np.flatnonzero(self.bits[seeds >> tx.U(64 - FILTER_BITS)])
            at = at[owner[at] == owner[at + mask[-1]]]
            lo = np.searchsorted(items.seeds, seeds[at], "left")
            n = np.searchsorted(items.seeds, seeds[at], "right") - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            hit = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            at = np.repeat(at, n)
            out.append(np.stack([owner[at], items.item[hit], at - bounds[owner[at]] - items.place[hit]], axis=1))
        return np.unique(np.concatenate(out), axis=0)

    def __call__(self, texts: pa.Array) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, first word in the text, first word in the item, words, equal words), the best per pair."""
        words, bounds = words_of(texts)
        best: dict[tuple[int, int], tuple[int, int, int, int, int, int]] = {}
        for d, k, shift in self._shifts(words, bounds).tolist():
            item = self.items.words[self.items.bounds[k] : self.items.bounds[k + 1]]
            text = words[bounds[d] : bounds[d + 1]]
            a, b = max(0, -shift), min(len(item), len(text) - shift)
            width = min(self.window, len(item))
            if b - a < width:
                continue
            same = item[a:b] == text[a + shift : b + shift]
            sums = np.cumsum(np.append(0, same))
            least = self.least if len(item) >= LEAST_WORDS else 100
            good = np.flatnonzero(100 * (sums[width:] - sums[:-width]) >= least * width)
            if len(good):
                lo, hi = int(good[0]), int(good[-1]) + width
                row = d, k, a + lo + shift, a + lo, hi - lo, int(sums[hi] - sums[lo])
                if (d, k) not in best or row[5] > best[d, k][5]:
                    best[d, k] = row
        return list(best.values())


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list, pa.Array]]:
    """The benchmark in blocks of about BLOCK_WORDS words: only one is on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    letters = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-letters // (4 * BLOCK_WORDS)))
    for k in range(n):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow().combine_chunks()
        if block.num_rows:
            yield block.column("item_id").to_pylist(), pa.concat_arrays(block.column("text").chunks)


def _pairs(block, window: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan(block.value, window, least)
        for piece in tx.pieces(batches, "text"):
            found = scan(piece.column("text"))
            d, k, *rest = zip(*found, strict=True) if found else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id").take(pa.array(d, pa.int64())),
                    pa.array([block.value.ids[x] for x in k], pa.int64()),
                    *(pa.array(x, pa.int64()) for x in rest),
                ],
                ["doc_id", "item_id", "doc_start", "item_start", "words", "equal_words"],
            )

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 15, least: int = 80) -> DataFrame:
    """A row per document and item it holds: ``doc_id, item_id, doc_start, item_start, words, equal_words``."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, doc_start long, item_start long, words long, equal_words long"
    found = spark.createDataFrame([], schema)
    for block in _blocks(benchmark):
        items = spark.sparkContext.broadcast(items_of(*block))
        found = found.union(texts.mapInArrow(_pairs(items, window, least), schema))
    return found


def _clean(blocks: list, window: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = None
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for block in blocks:
                if scan is None or len(blocks) > 1:
                    scan = None  # the last block's index goes before the next one is made
                    scan = Scan(items_of(*block.value), window, least)
                at = 0
                for piece in tx.pieces([batch], "text"):
                    keep[[at + row[0] for row in scan(piece.column("text"))]] = False
                    at += piece.num_rows
            at = 0
            for piece in tx.pieces([batch], "text"):
                yield piece.filter(pa.array(keep[at : at + piece.num_rows]))
                at += piece.num_rows

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 15, least: int = 80) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    blocks = [docs.sparkSession.sparkContext.broadcast(block) for block in _blocks(benchmark)]
    for k in range(0, len(blocks), PASS):
        if k:
            docs = saved(docs, "decontaminated")
        docs = docs.mapInArrow(_clean(blocks[k : k + PASS], window, least), docs.schema)
    return docs
