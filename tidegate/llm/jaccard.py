"""Exact Jaccard join of documents on word shingles, by size-banded tiles of hashed bitmaps.

``joined(docs)`` links two documents whose shingle sets have at least ``percent`` hundredths of their union in common,
and names the component of each. Nothing is estimated: every linked pair of different sets meets in a tile.

1. Equal sets are one node, found by fingerprint, so a group of copies of any size costs one row.
2. Two linked sets share a shingle among the first ``n - ceil(n * percent / 100) + 1`` of each in any common order.
   The order is by how often a shingle's cell of a count table was seen, then by hash: shingles of passages that many
   documents hold come last and seldom count among the first.
3. Sets that share such a shingle are its bucket. Each set is compared with the smallest and the largest node of each of
   its buckets: two rows for each member, and all there is to compare in buckets of up to three. Of the pairs that the
   bitmaps (see 4) leave, those with the largest shared number of buckets are confirmed first; the others only where
   they join different components.
4. Larger buckets that still hold different components are cut into bands of size (two linked sets are in one band or in
   neighbours) and these into tiles of bounded size. In a tile a pair's bitmaps bound its overlap from above: half of
   the two sizes less the differing bits. What the bound lets pass is intersected as sorted arrays.

Null and wordless texts have the empty set and stay alone. Rows with one id and different texts are different
documents; they and repeated rows each get a row of the result. A null id takes no part, and its component is null. An
empty table gives an empty result, extra columns are ignored. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm import text as tx
from tidegate.llm.graph import components
from tidegate.llm.near import shingle_sets
from tidegate.llm.repeats import SLOTS, BitMap
from tidegate.llm.store import importable, records_at_once, saved

#: Cells of the count table, and of one of the chunks it travels in. Two bytes a cell in a task, one when sent along;
#: what one task sees more often than MOST counts as that, which only bears on the order of shingles.
CELLS, CHUNK, MOST = 1 << 23, 1 << 16, (1 << 16) - 1
#: Shingles that a task gathers before it adds them to its cells.
GATHERED = 1 << 19
#: Bytes of text that a task works on at a time, and rows that travel to it at once: with those, an executor's memory
#: for the texts, bitmaps and sets on their way.
PIECE, RECORDS = 1 << 18, 1000
#: Members, and shingles of all members, of one block; two blocks meet in a tile.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
#: Bits of a bitmap at most; longer sets share bits, and the bound stays one.
WIDEST = 1 << 16
#: Sets that a task remembers in order to send copies once.
REMEMBERED = 1 << 20


def _fingerprints(h: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """Hash of each set; an empty set has 0."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros(len(bounds) - 1, np.int64)
    if len(full):
        out[full] = tx.mix(np.add.reduceat(tx.mix(h + tx.U(k)), bounds[:-1][full])).view(np.int64)
    return out


MEASURED = "doc_id long, n long, node long, check long, chunk int, counts binary"


def _measured(size: int):
    """Per document the size and fingerprints of its set; per task, chunk by chunk, how often each cell was seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("check", pa.int64()),
             ("chunk", pa.int32()), ("counts", pa.binary())]
        )
        cells, held, waiting = np.zeros(CELLS, np.uint16), [], 0

        def gather() -> None:
            at, n = np.unique(np.concatenate(held), return_counts=True)
            cells[at] = np.minimum(cells[at] + n, MOST)

        for piece in tx.pieces(batches, "text", PIECE):
            h, bounds = shingle_sets(piece.column("text"), size)
            nothing = pa.nulls(piece.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id").cast(pa.int64()),
                    pa.array(np.diff(bounds).astype(np.int64)),
                    pa.array(_fingerprints(h, bounds, 1)),
                    pa.array(_fingerprints(h, bounds, 2)),
                    nothing.cast(pa.int32()),
                    nothing.cast(pa.binary()),
                ],
                schema=schema,
            )
            held.append((h & tx.U(CELLS - 1)).astype(np.uint32))
            waiting += len(h)
            if waiting >= GATHERED:
                gather()
                held, waiting = [], 0
        if waiting:
            gather()
        for k in range(CELLS // CHUNK):
            part = cells[k * CHUNK : (k + 1) * CHUNK]
            if part.any():
                packed = pa.compress(part.tobytes(), codec="zstd", asbytes=True)
                yield pa.RecordBatch.from_pylist([{"chunk": k, "counts": packed}], schema=schema)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the chunks that one task received, one row for each number."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, packed in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
            part = np.frombuffer(pa.decompress(packed.as_buffer(), 2 * CHUNK, codec="zstd"), np.uint16)
            total[k] = total.get(k, 0) + part.astype(np.int64)
    for k, counts in total.items():
        yield pa.RecordBatch.from_pylist([{"chunk": k, "counts": counts.tobytes()}])


def _graded(mean: float):
    """Sums the sums, and how far above the mean each cell is, in quarters of a power of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(part.as_buffer(), np.int64)
        for k, counts in total.items():
            grade = np.clip(np.round(4 * np.log2(np.maximum(counts, 1) / mean)), 0, 255).astype(np.uint8)
            yield pa.RecordBatch.from_pylist([{"chunk": k, "counts": grade.tobytes()}])

    return run


def _levels(measured: DataFrame) -> np.ndarray:
    """The grade of each cell: 8 MB, whatever the texts."""
    seen = measured.agg(F.sum("n")).first()[0] or 0
    salt = F.pmod(F.xxhash64("counts"), F.lit(16))
    grades = (
        measured.filter("chunk is not null").select("chunk", "counts")
        .repartition(F.col("chunk"), salt).mapInArrow(_added, "chunk long, counts binary")
        .repartition("chunk").mapInArrow(_graded(max(seen / CELLS, 1.0)), "chunk long, counts binary")
    )
    out = np.zeros(CELLS, np.uint8)
    for k, grade in grades.toLocalIterator():
        out[k * CHUNK : (k + 1) * CHUNK] = np.frombuffer(grade, np.uint8)
    return out


def first_shingles(h: np.ndarray, bounds: np.ndarray, levels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each set two linked sets share one of, and the sets' numbers, set by set."""
    counts = np.diff(bounds)
    owner = tx.owners(bounds)
    # hashes ascend within a set already
    order = np.argsort((owner << 8) + levels[(h & tx.U(CELLS - 1)).astype(np.int64)], kind="stable")
    rank = np.arange(len(h)) - bounds[:-1][owner]
    kept = rank < (counts - -(-counts * percent // 100) + 1)[owner]
    return h[order][kept], owner[kept]


def _bit_map(values: DataFrame) -> BitMap:
    """Of the one column of ``values``; 16 MB at most. Where it is too small it also holds values that are not there."""
    name = values.columns[0]
    out = BitMap(min(max((16 * values.count()).bit_length(), SLOTS[0]), SLOTS[1]))
    slot = F.col(name).bitwiseAND(F.lit((1 << out.slots) - 1))
    bits = F.bit_or(F.expr("shiftleft(1L, int(slot % 32))")).alias("bits")
    words = values.select(slot.alias("slot")).groupBy(F.shiftright("slot", 5).alias("word")).agg(bits).toArrow()
    out.words[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return out


def _prefixes(size: int, percent: int, levels: Broadcast, shared: Broadcast | None = None):
    """Rows (token, node, n), of the shared tokens if they are told; copies that one task meets send theirs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for piece in tx.pieces(batches, "text", PIECE):
            h, bounds = shingle_sets(piece.column("text"), size)
            node = _fingerprints(h, bounds, 1)
            fresh = np.zeros(len(node), bool)
            for d, value in enumerate(node.tolist()):
                if value not in seen:
                    seen.add(value)
                    fresh[d] = True
            if len(seen) > REMEMBERED:
                seen.clear()
            token, owner = first_shingles(h, bounds, levels.value, percent)
            keep = fresh[owner]
            if shared is not None:
                keep &= shared.value.has(token)
            token, owner = token[keep], owner[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(token.view(np.int64)), pa.array(node[owner]), pa.array(np.diff(bounds)[owner].astype(np.int32))],
                ["token", "node", "n"],
            )

    return run


def bitmap(h: np.ndarray) -> bytes:
    """The set's hashed bitmap, about two bits for each of its shingles."""
    width = min(max(64, 1 << (2 * len(h) - 1).bit_length()), WIDEST)
    bits = np.zeros(width, np.uint8)
    bits[(h & tx.U(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bits: list[bytes]) -> np.ndarray:
    """Bitmaps brought to the width of the narrowest, as rows of 64-bit words."""
    width = min(map(len, bits))
    rows = [np.bitwise_or.reduce(np.frombuffer(b, np.uint64).reshape(-1, width // 8), axis=0) for b in bits]
    return np.stack(rows)


def most_common(x: np.ndarray, y: np.ndarray, n_x, n_y) -> np.ndarray:
    """What sets with these bitmaps have in common at most: a differing bit is a shingle of one of them alone."""
    differing = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
    return (n_x + n_y - differing) // 2


SETS = "node long, n int, bits binary, shingles binary"


def _chosen(node: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """Hash of a set and a document that has it."""
    return tx.mix(tx.mix(doc_id.view(tx.U)) + node.view(tx.U))


def _with_chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = _chosen(*(batch.column(c).to_numpy() for c in ("node", "doc_id")))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["chosen"])


def _sets(size: int, chosen: Broadcast):
    """Bitmap and shingles of the sets of the chosen documents, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for piece in tx.pieces(batches, "text", PIECE):
            h, bounds = shingle_sets(piece.column("text"), size)
            node = _fingerprints(h, bounds, 1)
            doc_id = piece.column("doc_id").cast(pa.int64()).to_numpy()
            full = np.flatnonzero((np.diff(bounds) > 0) & chosen.value.has(_chosen(node, doc_id)))
            fresh = []
            for d in full.tolist():
                if (value := int(node[d])) not in seen:
                    seen.add(value)
                    fresh.append(d)
            if len(seen) > REMEMBERED:
                seen.clear()
            own = [h[bounds[d] : bounds[d + 1]] for d in fresh]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(node[fresh], pa.int64()),
                    pa.array(np.diff(bounds)[fresh].astype(np.int32)),
                    pa.array([bitmap(s) for s in own], pa.binary()),
                    pa.array([s.tobytes() for s in own], pa.binary()),
                ],
                ["node", "n", "bits", "shingles"],
            )

    return run


def _likely(percent: int):
    """Of pairs with both sets' bitmaps those that may be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            columns = (batch.column(c).to_pylist() for c in ("bits_u", "bits_v", "n_u", "n_v"))
            for bits_u, bits_v, n_u, n_v in zip(*columns, strict=True):
                x, y = _folded([bits_u, bits_v])
                both = most_common(x, y, n_u, n_v)
                keep.append(bool(100 * both >= percent * (n_u + n_v - both)))
            yield batch.select(["u", "v", "shared"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(percent: int):
    """Of pairs with both sets' shingles those that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_u"), batch.column("set_v"), strict=True):
                a, b = np.frombuffer(a.as_buffer(), tx.U), np.frombuffer(b.as_buffer(), tx.U)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    sets = _only(sets, pairs.select(F.explode(F.array("u", "v")).alias("node")))
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}"))
    found = pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v").mapInArrow(_linked(percent), "u long, v long")
    return saved(found, "links")


def _only(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets of these nodes, filtered before they are shuffled where the nodes are few."""
    return sets.join(saved(nodes.select("node").distinct(), "nodes"), "node", "left_semi")


def _band(percent: int) -> Column:
    """Number of a set's size band: a band reaches up to slightly more than the largest ratio of two linked sets."""
    return F.floor(F.log("n") / (math.log(100 / percent) * 1.0001 if percent < 100 else 1e-9)).cast("long").alias("band")


def _tiles(members: DataFrame, payload: DataFrame, percent: int) -> DataFrame:
    """Members (token, node, n, c) by pairs (i, j) of blocks of their bucket's bands, with their node's ``payload``.

    A band holds its own sets and, as guests, those of the band below. All pairs of its blocks are tiles, so that a
    crowded bucket is dealt to many tasks, each with bounded rows. What is compared joins them only when the tiles
    are settled, and travels once.
    """
    own = members.withColumn("band", _band(percent)).withColumn("guest", F.lit(False))
    placed = own.union(own.withColumn("band", F.col("band") + 1).withColumn("guest", F.lit(True)))
    many = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    # bands without sets of their own, or of one component, compare nothing
    counts = (
        placed.groupBy("token", "band")
        .agg(many.alias("blocks"), F.min(F.when(~F.col("guest"), F.col("n"))).alias("smallest"), F.min("c").alias("lo"), F.max("c").alias("hi"))
        .filter("smallest is not null and lo <> hi").drop("lo", "hi")
    )
    tiled = placed.join(counts, ["token", "band"]).filter(F.col("n") * 100 >= F.col("smallest") * percent).drop("smallest")
    tiled = tiled.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    tiled = tiled.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")
    key = ["token", "band", "i", "j"]
    return tiled.join(payload, "node").repartition(*key).sortWithinPartitions(*key, "node")


def _compared(percent: int, exact: bool):
    """Compares what stands in one tile and is in different components.

    Without ``exact``: the members (token, node) that have a partner by the bound of the bitmaps; where ``near`` names
    the buckets of each member, only in the first bucket of a pair. With it: the linked pairs, by intersection.
    """

    def tile(t: pa.Table) -> list[tuple[int, int]]:
        node, c, n, own, guest = (t.column(x).to_numpy() for x in ("node", "c", "n", "own", "guest"))
        if len(node) < 2 or c.min() == c.max() or guest.all():
            return []
        n = n.astype(np.int64)
        across = t.column("i")[0].as_py() != t.column("j")[0].as_py()
        bits = _folded(t.column("bits").to_pylist())
        token = t.column("token")[0].as_py()
        near = [np.array(x, np.int64) for x in t.column("near").to_pylist()] if "near" in t.column_names else None
        sets = [np.frombuffer(x.as_buffer(), tx.U) for x in t.column("shingles")] if exact else []
        out: set[tuple[int, int]] = set()
        for x in range(len(node) - 1):
            rest = slice(x + 1, None)
            may = (c[rest] != c[x]) & ~(guest[rest] & guest[x])
            if across:
                may &= own[rest] != own[x]
            y = np.flatnonzero(may) + x + 1
            y = y[100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])]
            if len(y):
                both = most_common(bits[y], bits[x], n[y], n[x])
                y = y[100 * both >= percent * (n[x] + n[y] - both)]
            for k in y.tolist():
                if exact:
                    both = len(np.intersect1d(sets[x], sets[k], assume_unique=True))
                    if 100 * both >= percent * (len(sets[x]) + len(sets[k]) - both):
                        out.add((int(node[x]), int(node[k])))
                elif near is None or np.intersect1d(near[x], near[k], assume_unique=True)[0] == token:
                    out |= {(token, int(node[x])), (token, int(node[k]))}
        return list(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tx.runs(batches, ("token", "band", "i", "j")):
            found = tile(t)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])

    return run


def joined(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` its ``doc_id, n_shingles, component_id``."""
    with records_at_once(importable(docs.sparkSession), RECORDS):
        return _joined(docs, size, percent)


def _joined(docs: DataFrame, size: int, percent: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = saved(texts.mapInArrow(_measured(size), MEASURED), "measured")
    facts = measured.filter("chunk is null").select("doc_id", "n", "node", "check")
    named = texts.filter("doc_id is not null")
    levels = context.broadcast(_levels(measured))

    tokens = lambda shared: named.mapInArrow(_prefixes(size, percent, levels, shared), "token long, node long, n int")
    ends = (F.min(F.struct("node", "n")).alias("lo"), F.max(F.struct("node", "n")).alias("hi"))
    buckets = saved(tokens(None).groupBy("token").agg(*ends).filter("lo.node <> hi.node"), "buckets")
    shared = context.broadcast(_bit_map(buckets.select("token")))
    members = saved(tokens(shared).join(buckets, "token").distinct(), "members")
    shared.unpersist()
    active = saved(members.select("node").distinct(), "active")
    chosen = facts.filter("doc_id is not null").join(active, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    chosen = context.broadcast(_bit_map(chosen.mapInArrow(_with_chosen, "chosen long")))
    sets = saved(named.mapInArrow(_sets(size, chosen), SETS), "sets")
    again = saved(sets.groupBy("node").count().filter("count > 1").select("node"), "sets-again")  # few: of several tasks
    sets = sets.join(again, "node", "left_anti").union(sets.join(again, "node", "left_semi").dropDuplicates(["node"]))
    chosen.unpersist()
    levels.unpersist()
    alike = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    pairs = (
        members.select("node", "n", F.explode(F.array("lo", "hi")).alias("end")).filter("node <> end.node")
        .filter(alike("n", "end.n"))
        .groupBy(F.least("node", "end.node").alias("u"), F.greatest("node", "end.node").alias("v")).agg(F.count("*").alias("shared"))
    )
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    likely = pairs.join(side("u"), "u").join(side("v"), "v")
    likely = saved(likely.mapInArrow(_likely(percent), "u long, v long, shared long"), "likely")
    best = likely.groupBy(F.col("v").alias("node")).agg(F.max_by("u", F.struct("shared", "u")).alias("u"))
    links = _confirmed(best.select("u", F.col("node").alias("v")), sets, percent)
    label = saved(components(links), "components")
    of = lambda x: label.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    apart = likely.join(of("u"), "u", "left").join(of("v"), "v", "left")
    more = _confirmed(apart.filter(F.coalesce("c_u", "u") != F.coalesce("c_v", "v")), sets, percent)
    if not more.isEmpty():
        links = links.union(more)
        label = saved(components(links), "components")

    placed = saved(
        members.join(label, "node", "left").select("token", "node", "n", F.coalesce("component", "node").alias("c")), "placed"
    )
    mixed = (
        placed.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("sets"))
        .filter("lo <> hi and sets > 3").select("token")
    )
    bits = sets.select("node", "bits")
    members_left = lambda rows, payload: saved(
        _tiles(rows, payload, percent).mapInArrow(_compared(percent, False), "token long, node long").distinct(), "near"
    )
    near = members_left(saved(placed.join(mixed, "token", "left_semi"), "apart"), bits)
    # the same once more, each pair in one bucket, before whole sets travel
    buckets_of = near.groupBy("node").agg(F.collect_list("token").alias("near"))
    near = members_left(saved(near.join(placed, ["token", "node"]), "apart"), bits.join(buckets_of, "node"))
    rows = saved(near.join(placed, ["token", "node"]), "apart")
    tiles = _tiles(rows, _only(sets, near).select("node", "bits", "shingles"), percent)
    more = saved(tiles.mapInArrow(_compared(percent, True), "u long, v long"), "links")
    if not more.isEmpty():
        label = saved(components(links.union(more)), "components")

    # a component is named by its smallest id
    grouped = facts.filter("n > 0").groupBy("node", "check").agg(F.min("doc_id").alias("least"))
    grouped = grouped.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = grouped.groupBy("component").agg(F.min("least").alias("name"))
    grouped = grouped.join(names, "component").select("node", "check", "name")
    return facts.join(grouped, ["node", "check"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("name", "doc_id")).alias("component_id"),
    )
