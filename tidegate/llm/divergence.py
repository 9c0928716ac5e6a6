"""How far the sources of a language differ in their words: an exact recount into slots of minimal perfect hashes.

1. Each language keeps the terms that at least ``least`` of its documents hold; counted per slice of texts, then summed.
2. The kept terms of a language are dealt to shards by hash. A task builds a shard's minimal perfect hash: levels of bit
   maps, in each of which the terms that meet no other have their bit; a term's slot is the number of set bits before
   its own. The shard stores its terms by slot, so a lookup is verified and other words are turned away.
3. Shards are broadcast in blocks of bounded size. The second pass over the texts looks every different word of a slice
   up once and adds its occurrences to the dense slots of the group (lang, source); what is not zero is summed by Spark.
4. A kept term's share in a group is ``1 + floor(scale * (count + smoothing) / (N + smoothing * V))``. Part ``pair``
   sums the differences of shares over all kept terms, for tiles of sources and slots. Part ``term`` names the
   terms whose share in a group is above that in its language.

Null texts, languages and sources are ''. A repeated row is a document of its own. Ties are ordered by the bytes of the
item. Groups without terms and languages that keep none take part, their shares are those of count 0; with no kept term
all differences are 0. An empty table gives an empty result; extra columns are ignored. Counts are 64-bit whole numbers.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm import text as tx
from tidegate.llm.store import importable, saved

#: Bytes of text in one slice; terms of a shard, about; bytes of shards that are broadcast at once.
SLICE, SHARD, BLOCK_BYTES = 8 << 20, 1 << 17, 64 << 20
#: Slots that a task holds before it hands on what it counted.
SLOTS = 1 << 22
#: Sources of one tile, its slots, and slots that are compared at once.
TILE, PART, STEP = 256, 8192, 2048
#: Levels of a perfect hash, and bits for each term of a level. Terms left after the last level are listed.
LEVELS, ROOM = 32, 2

#: A letter or a byte of a character beyond ASCII, lower-cased; any other byte is a blank.
TERM = np.full(256, 0x20, np.uint8)
TERM[0x80:] = np.arange(0x80, 0x100)
for _a, _z in ("az", "AZ"):
    TERM[ord(_a) : ord(_z) + 1] = np.arange(ord("a"), ord("z") + 1)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """For each term, in order, its number among the different ones and the number of its text; the different ones."""
    data, offsets = tx.bytes_of(texts)
    data = TERM[data]
    starts, ends, bounds = tx.word_spans(data, offsets)
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    buffers = [None, pa.py_buffer(at), pa.py_buffer(data[data != 0x20])]
    every = pa.Array.from_buffers(pa.large_string(), len(starts), buffers).dictionary_encode()
    return every.indices.to_numpy().astype(np.int64), every.dictionary, tx.owners(bounds)


def hashes(terms: pa.Array) -> np.ndarray:
    out = [np.zeros(0, tx.U)]
    for k in range(0, len(terms), 1 << 17):
        data, offsets = tx.bytes_of(terms.slice(k, 1 << 17))
        out.append(tx.spans_hash(data, offsets[:-1], offsets[1:]))
    return np.concatenate(out)


def shard_of(h: np.ndarray, shards) -> np.ndarray:
    return (tx.mix(h + tx.U(0x5EED)) % np.asarray(shards).astype(tx.U)).astype(np.int64)


class Perfect:
    """Slots 0 to n - 1 for n different terms, and the term of each slot."""

    def __init__(self, terms: pa.Array):
        terms = terms.cast(pa.large_string())
        h, left = hashes(terms), np.arange(len(terms))
        self.sizes: list[int] = []
        words, order = [], []
        while len(left) and len(self.sizes) < LEVELS:
            size = -(-ROOM * len(left) // 64) * 64
            at = self._place(h[left], len(self.sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            placed = alone[at]
            order.append(left[placed][np.argsort(at[placed])])
            left = left[~placed]
            self.sizes.append(size)
        self.bits = np.concatenate([*words, np.zeros(0, np.uint64)])
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits).astype(np.int64))])[:-1].astype(np.int32)
        self.terms = terms.take(pa.array(np.concatenate([*order, left])))
        ranked = len(terms) - len(left)
        self.rest = {t: ranked + k for k, t in enumerate(self.terms.slice(ranked).to_pylist())}

    @staticmethod
    def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
        return (tx.mix(h + tx.U(level + 1)) % tx.U(size)).astype(np.int64)

    def slots(self, terms: pa.Array, h: np.ndarray) -> np.ndarray:
        """The slot of each term, -1 for those that have none."""
        out, left, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
        for level, size in enumerate(self.sizes):
            at = self._place(h[left], level, size) + base
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.before[at >> 6] + below)[hit]
            left, base = left[~hit], base + size
        if self.rest:
            out[left] = [self.rest.get(t, -1) for t in terms.take(pa.array(left)).to_pylist()]
        found = np.flatnonzero(out >= 0)
        same = pc.equal(terms.take(pa.array(found)), self.terms.take(pa.array(out[found])))
        out[found[~same.to_numpy(zero_copy_only=False)]] = -1
        return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, term, documents) of each slice."""
    for piece in tx.pieces(batches, "text", SLICE):
        code, terms, owner = terms_of(piece.column("text"))
        langs = piece.column("lang").dictionary_encode()
        many = max(len(terms), 1)
        pairs = np.unique(owner * many + code)  # a document counts once
        lang = langs.indices.to_numpy()[pairs // many]
        key, documents = np.unique(lang * many + pairs % many, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [langs.dictionary.take(pa.array(key // many)), terms.take(pa.array(key % many)).cast(pa.string()), pa.array(documents)],
            ["lang", "term", "documents"],
        )


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = hashes(batch.column("term").cast(pa.large_string()))
        shard = shard_of(h, batch.column("shards").to_numpy())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], [*batch.schema.names, "shard"])


def _perfect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in tx.runs(batches, ("lang", "shard")):
        made = Perfect(t.column("term").combine_chunks())
        yield pa.RecordBatch.from_pylist(
            [{**{c: t.column(c)[0].as_py() for c in ("lang", "shard", "shards")}, "n": len(made.terms), "hash": pickle.dumps(made)}]
        )


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            terms = pickle.loads(row["hash"]).terms.cast(pa.string())
            n = len(terms)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["lang"]] * n, pa.string()), pa.array(np.full(n, row["shard"])), pa.array(np.arange(n)), terms],
                ["lang", "shard", "slot", "term"],
            )


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """The perfect hashes (lang, shard, shards, n, hash) of the terms that ``least`` documents of their language hold."""
    kept = (
        docs.select("lang", "text").mapInArrow(_frequencies, "lang string, term string, documents long")
        .groupBy("lang", "term").agg(F.sum("documents").alias("documents")).filter(F.col("documents") >= least)
    )
    kept = saved(kept.select("lang", "term"), "kept-terms")
    shards = kept.groupBy("lang").agg(F.ceil(F.count("*") / SHARD).alias("shards"))
    dealt = kept.join(shards, "lang").mapInArrow(_dealt, "lang string, term string, shards long, shard long")
    built = dealt.repartition("lang", "shard").sortWithinPartitions("lang", "shard", "term")
    return saved(built.mapInArrow(_perfect, "lang string, shard long, shards long, n long, hash binary"), "perfect-hashes")


class Block:
    """Shards that are broadcast together."""

    def __init__(self, rows: Iterable):
        self.parts: dict[str, list[tuple[int, Perfect]]] = {}
        self.shards: dict[str, int] = {}
        for row in rows:
            self.parts.setdefault(row.lang, []).append((row.shard, pickle.loads(row.hash)))
            self.shards[row.lang] = row.shards

    def slots(self, lang: str) -> int:
        return sum(len(p.terms) for _, p in self.parts[lang])

    def found(self, lang: str, terms: pa.Array, h: np.ndarray) -> np.ndarray:
        """Slots of terms among those of all the language's shards in this block, one shard after the other."""
        shard, out, base = shard_of(h, self.shards[lang]), np.full(len(h), -1, np.int64), 0
        for number, part in self.parts[lang]:
            own = np.flatnonzero(shard == number)
            at = part.slots(terms.take(pa.array(own)), h[own])
            out[own] = np.where(at < 0, -1, at + base)
            base += len(part.terms)
        return out

    def counted(self, lang: str, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Shard, slots and counts of what is not zero."""
        base = 0
        for number, part in self.parts[lang]:
            own = counts[base : base + len(part.terms)]
            at = np.flatnonzero(own)
            yield number, at, own[at]
            base += len(part.terms)


CELLS = "lang string, source string, shard long, slot long, count long"


def _recounted(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(pickle.loads(shared.value))
        dense: dict[tuple[str, str], np.ndarray] = {}
        held = 0

        def emptied() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in dense.items():
                for shard, at, count in block.counted(lang, counts):
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()),
                            pa.array(np.full(n, shard)), pa.array(at), pa.array(count),
                        ],
                        ["lang", "source", "shard", "slot", "count"],
                    )
            dense.clear()

        for piece in tx.pieces(batches, "text", SLICE):
            code, terms, owner = terms_of(piece.column("text"))
            groups: dict[tuple[str, str], int] = {}
            pairs = zip(piece.column("lang").to_pylist(), piece.column("source").to_pylist(), strict=True)
            group = np.array([groups.setdefault(p, len(groups)) for p in pairs], np.int64)
            many = max(len(terms), 1)
            key, count = np.unique(group[owner] * many + code, return_counts=True)
            bounds = np.searchsorted(key, np.arange(len(groups) + 1) * many)
            h, slot_of = hashes(terms), {}
            for g, (lang, source) in enumerate(groups):
                if lang not in block.parts:
                    continue
                if lang not in slot_of:
                    slot_of[lang] = block.found(lang, terms, h)
                if (lang, source) not in dense:
                    size = block.slots(lang)
                    if held and held + size > SLOTS:
                        yield from emptied()
                        held = 0
                    dense[lang, source] = np.zeros(size, np.int64)
                    held += size
                own = slice(bounds[g], bounds[g + 1])
                slot = slot_of[lang][key[own] % many]
                dense[lang, source][slot[slot >= 0]] += count[own][slot >= 0]
        yield from emptied()

    return run


def _blocks(built: DataFrame) -> Iterator[list]:
    block, size = [], 0
    for row in built.toLocalIterator():
        if block and size + len(row.hash) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(row)
        size += len(row.hash)
    if block:
        yield block


def recount(docs: DataFrame, built: DataFrame) -> DataFrame:
    """Rows (lang, source, shard, slot, count) of the kept terms that a group holds; one pass for each block."""
    spark = docs.sparkSession
    cells = spark.createDataFrame([], CELLS)
    for block in _blocks(built):
        shared = spark.sparkContext.broadcast(pickle.dumps(block))
        found = docs.select("lang", "source", "text").mapInArrow(_recounted(shared), CELLS)
        found = found.groupBy("lang", "source", "shard", "slot").agg(F.sum("count").alias("count"))
        cells = cells.union(saved(found, "recount"))
        shared.unpersist()
    return cells


def share(count: Column, total: Column, terms: Column, scale: int, smoothing: int) -> Column:
    """Exact for whole numbers: the product does not fit 64 bits."""
    product = F.lit(scale).cast("decimal(12,0)") * (count + smoothing).cast("decimal(20,0)")
    quotient = F.call_function("div", product, (total + terms * smoothing).cast("decimal(20,0)"))
    return F.lit(1) + quotient


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per tile of sources and slots the sums of differences of each pair of sources.

    Rows come sorted by lang, shard, part, tile and step; step -1 tells the sources and their share of a term they don't hold.
    """
    names = ["lang", "source", "item", "value"]
    tile, sources, rest, own, n = None, [], None, None, 0
    sums: np.ndarray | None = None
    done = 0

    def finished() -> Iterator[pa.RecordBatch]:
        if sums is None:
            return
        # slots that no source of the tile holds a term of, and the steps that had no row at all
        total = sums + (n - done) * np.abs(rest[:, None] - rest[None, :])
        a, b = np.nonzero(np.triu(np.ones_like(total, bool), 1) & ((own[:, None] != own[None, :]) | (tile[3] == tile[4])))
        columns = ([tile[0]] * len(a), [sources[k] for k in a], [sources[k] for k in b], total[a, b])
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for t in tx.runs(batches, ("lang", "shard", "part", "i", "j", "step")):
        key = tuple(t.column(c)[0].as_py() for c in ("lang", "shard", "part", "i", "j"))
        if t.column("step")[0].as_py() < 0:
            yield from finished()
            tile, sources = key, t.column("source").to_pylist()
            rest, own = t.column("p").to_numpy(), t.column("own").to_numpy()
            n, done = t.column("slot")[0].as_py(), 0
            sums = np.zeros((len(sources), len(sources)), np.int64)
            place = {s: k for k, s in enumerate(sources)}
            continue
        row = np.array([place[s] for s in t.column("source").to_pylist()], np.int64)
        slots, at = np.unique(t.column("slot").to_numpy(), return_inverse=True)
        p = np.repeat(rest[:, None], len(slots), axis=1)
        p[row, at] = t.column("p").to_numpy()
        for k in range(len(p) - 1):
            sums[k, k + 1 :] += np.abs(p[k + 1 :] - p[k]).sum(axis=1)
        done += len(slots)
    yield from finished()


def audited(docs: DataFrame, least: int = 30, top: int = 50, scale: int = 10**9, smoothing: int = 5) -> DataFrame:
    """Rows (lang, source, part, item, value, rank)."""
    importable(docs.sparkSession)
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    built = kept_terms(texts, least)
    cells = saved(recount(texts, built), "cells")
    shards = built.select("lang", "shard", "n")
    terms = built.select("lang", "shard", "hash").mapInArrow(_stored, "lang string, shard long, slot long, term string")

    kept = shards.groupBy("lang").agg(F.sum("n").alias("v"))
    totals = cells.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = texts.groupBy("lang", "source").count().drop("count").join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = saved(groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v"))), "groups")
    p = lambda count, total="total": share(F.col(count), F.col(total), F.col("v"), scale, smoothing)

    # terms above the language's share
    whole = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    in_lang = cells.groupBy("lang", "shard", "slot").agg(F.sum("count").alias("lang_count"))
    in_lang = in_lang.join(terms, ["lang", "shard", "slot"])
    above = (
        cells.join(groups, ["lang", "source"]).join(whole, "lang").join(in_lang, ["lang", "shard", "slot"])
        .select("lang", "source", F.col("term").alias("item"), (p("count") - p("lang_count", "lang_total")).alias("value"))
        .filter("value > 0")
    )
    in_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_term = above.withColumn("rank", F.row_number().over(in_group)).filter(F.col("rank") <= top)

    # differences between sources
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    placed = groups.filter("v > 0").join(tiles, "lang").withColumn("own", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
    parts = shards.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PART))))
    absent = placed.join(parts, "lang").select(
        "lang", "source", "shard", "part", "own", "tiles", F.lit(-1).cast("long").alias("step"),
        F.least(F.lit(PART).cast("long"), F.col("n") - F.col("part") * PART).alias("slot"),
        share(F.lit(0), F.col("total"), F.col("v"), scale, smoothing).alias("p"),
    )
    present = cells.join(placed, ["lang", "source"]).select(
        "lang", "source", "shard", F.floor(F.col("slot") / PART).alias("part"), "own", "tiles",
        F.floor(F.col("slot") / STEP).alias("step"), "slot", p("count").alias("p"),
    )
    tiled = present.union(absent).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
    tiled = tiled.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")
    key = ["lang", "shard", "part", "i", "j"]
    sums = (
        tiled.repartition(*key).sortWithinPartitions(*key, "step", "slot")
        .mapInArrow(_differences, "lang string, source string, item string, value long")
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    )
    sums = saved(sums, "differences")
    both = sums.union(sums.select("lang", "item", "source", "value"))
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    by_pair = others.join(both, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    by_pair = by_pair.withColumn("rank", F.row_number().over(in_group))

    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(by_pair, "pair").union(columns(by_term, "term"))
