"""MinHash near-duplicates: universal hash minima, bands, verification, components.

``linked(docs)`` gives each document the component it belongs to when two documents are linked by a Jaccard
similarity of their word-shingle sets of at least ``percent`` hundredths. Equal sets meet by fingerprint first, so
groups of copies of any size cost one row. The different sets then meet in bands of their minima (a pair at the
threshold shares none once in 2 * 10**7), and every link is confirmed on the full sets.

A band's bucket may be large, so its members are first compared with one of them: each set with the hub it shares
most bands with. Components of these links come next. Pairs of one bucket that are then still in different
components are compared block by block: by their signatures, which rule most out, then by their full sets. None is
left out, and only links are emitted.

Null or wordless texts have no set and stay alone. Rows with one doc_id are one document; a null doc_id takes no
part and gets a null component. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm import text as tx
from tidegate.llm.graph import components
from tidegate.llm.repeats import BitMap
from tidegate.llm.sift import hashed, possibly, taken
from tidegate.llm.store import saved

ROWS = 6
#: How often a pair exactly at the threshold may share no band; the number of bands follows.
MISS = 5e-8
#: Members of a bucket in one block; two blocks are compared at a time. Where only signatures travel (half a kilobyte
#: a member) a block holds WIDER times as many.
BLOCK, WIDER = 512, 4
#: Standard deviations by which an estimate from signatures may fall short before a pair is dropped.
SLACK = 6.0


def bands_for(percent: int) -> int:
    """36 for a threshold of 85 hundredths, 56 for 80."""
    return max(1, math.ceil(math.log(MISS) / math.log1p(-min((percent / 100) ** ROWS, 1 - 1e-9))))


def hash_functions(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of k universal hash functions."""
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint32)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' distinct shingle hashes, ascending within a text, and where each text begins."""
    data, offsets = tx.bytes_of(texts)
    starts, ends, bounds = tx.word_spans(data, offsets)
    words = tx.spans_hash(tx.LOWER[data], starts, ends)
    counts = np.diff(bounds)
    lengths = np.minimum(counts, size)
    hashes, texts_of = [], []
    for length in range(1, size + 1):
        windows = tx.windows_hash(words, length) + tx.U(length)
        own = np.flatnonzero(lengths == length)
        if not len(own):
            continue
        if length < size:  # the whole short text
            at = bounds[own]
            owner = own
        else:
            full = np.where(lengths == length, np.maximum(counts - length + 1, 0), 0)
            owner = np.repeat(np.arange(len(full)), full)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full) + bounds[owner]
        hashes.append(windows[at])
        texts_of.append(owner)
    if not hashes:
        return np.zeros(0, tx.U), np.zeros(len(offsets), np.int64)
    h, owner = np.concatenate(hashes), np.concatenate(texts_of)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[fresh], owner[fresh]
    return h, np.searchsorted(owner, np.arange(len(offsets)))


FP = ["n_shingles", "fp_a", "fp_b"]
MARKS = "doc_id long, n_shingles long, fp_a long, fp_b long"
BANDS = "node long, n_shingles long, fp_a long, fp_b long, bands array<long>"
SETS = "node long, n_shingles long, bands array<long>, sig binary, shingles binary"


def _fingerprints(h: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """Number of shingles and two sums of their hashes, null without shingles."""
    counts = np.diff(bounds)
    full = np.flatnonzero(counts)
    out = [pa.array(counts.astype(np.int64))]
    for k in range(2):
        sums = np.zeros(len(counts), np.int64)
        if len(full):
            sums[full] = np.add.reduceat(tx.mix(h + tx.U(k + 1)), bounds[:-1][full]).view(np.int64)
        out.append(pa.array(sums, mask=counts == 0))
    return out


def _minima(h: np.ndarray, bounds: np.ndarray, many: int) -> tuple[list, list]:
    """Bands and signatures of the sets, None without shingles."""
    factor, shift = hash_functions(ROWS * many)
    counts = np.diff(bounds)
    full = np.flatnonzero(counts)
    n = len(full)
    bands, sigs = [None] * len(counts), [None] * len(counts)
    if n:
        at = bounds[:-1][full]
        low = (h >> tx.U(32)).astype(np.uint32)
        minima = np.empty((n, ROWS * many), np.uint32)
        for k in range(ROWS * many):
            minima[:, k] = np.minimum.reduceat(low * factor[k] + shift[k], at)
        rows = minima.reshape(n, many, ROWS).astype(tx.U)
        band = np.broadcast_to(np.arange(many, dtype=tx.U), (n, many)).copy()
        for r in range(ROWS):
            band = tx.mix(band + rows[:, :, r])
        band = band.view(np.int64)
        short = (minima >> np.uint32(8)).astype(np.uint8)
        for k, d in enumerate(full):
            bands[d], sigs[d] = band[k], short[k].tobytes()
    return bands, sigs


def _marks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tx.pieces(batches, "text"):
            found = _fingerprints(*shingle_sets(piece.column("text"), size))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *found], ["doc_id", *FP])

    return run


def _bands(size: int, percent: int, among: Broadcast[BitMap], wanted: bool):
    """Bands of the rows whose ``hash`` may be ``among`` those of a bit map, or surely is not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tx.pieces(batches, "text"):
            piece = piece.filter(pa.array(among.value.has(piece.column("hash").to_numpy().view(tx.U)) == wanted))
            if not piece.num_rows:
                continue
            h, bounds = shingle_sets(piece.column("text"), size)
            bands = pa.array(_minima(h, bounds, bands_for(percent))[0], pa.list_(pa.int64()))
            found = _fingerprints(h, bounds)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *found, bands], ["node", *FP, "bands"])

    return run


def _sets(size: int, percent: int):
    """Sets, bands and signatures of the rows whose text has the fingerprint named beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tx.pieces(batches, "text"):
            h, bounds = shingle_sets(piece.column("text"), size)
            bands, sigs = _minima(h, bounds, bands_for(percent))
            sets = [h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            own = np.ones(piece.num_rows, bool)
            for name, found in zip(FP, _fingerprints(h, bounds), strict=True):
                own &= pa.compute.equal(found, piece.column(name)).fill_null(False).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    piece.column("n_shingles"),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sigs, pa.binary()),
                    pa.array(sets, pa.binary()),
                ],
                ["node", "n_shingles", "bands", "sig", "shingles"],
            ).filter(pa.array(own))

    return run


def _least_agreement(percent: int) -> float:
    """Equal signature bytes below which the threshold is ruled out."""
    wanted, k = percent / 100, ROWS * bands_for(percent)
    return k * (wanted - SLACK * (wanted * (1 - wanted) / k) ** 0.5)


def _agreeing(percent: int):
    """Keeps the pairs whose signatures don't rule the threshold out."""
    least, k = _least_agreement(percent), ROWS * bands_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (
                    np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, k)
                    for c in ("sig_u", "sig_v")
                )
                yield batch.select(["u", "v"]).filter(pa.array((a == b).sum(axis=1) >= least))

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_u"), batch.column("set_v"), strict=True):
                a, b = np.frombuffer(a.as_buffer(), tx.U), np.frombuffer(b.as_buffer(), tx.U)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (u, v) of nodes those that are linked."""
    facts = sketches.select("node", "n_shingles", "sig")
    likely = (
        pairs.join(facts.toDF("u", "n_u", "sig_u"), "u")
        .join(facts.toDF("v", "n_v", "sig_v"), "v")
        .filter(F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent)
        .select("u", "v", "sig_u", "sig_v")
        .mapInArrow(_agreeing(percent), "u long, v long")
    )
    likely = saved(likely, "likely")
    sets = sets.filter(possibly("node", saved(likely.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "ends")))
    return saved(
        likely.join(sets.toDF("u", "set_u"), "u")
        .join(sets.toDF("v", "set_v"), "v")
        .mapInArrow(_confirmed(percent), "u long, v long"),
        "links",
    )


def _tiles(members: DataFrame, payload: DataFrame, block: int) -> DataFrame:
    """Members (band, node, c) by pairs (i, j) of blocks of their bucket: bounded groups.

    Members of one component need no comparison, so the largest component of a bucket has blocks of its own, which
    meet those of the other members alone. All pairs of the others' blocks are tiles. A bucket of one block is one tile.
    Their node's ``payload`` joins them when the tiles are settled, and travels once.
    """
    parts = members.groupBy("band", "c").agg(F.count("*").alias("n"))
    counts = parts.groupBy("band").agg(F.sum("n").alias("all"), F.max(F.struct("n", "c")).alias("largest"))
    blocks = lambda n: F.ceil(n / block).cast("int")
    one = F.col("all") <= block
    counts = counts.select(
        "band",
        F.when(~one, F.col("largest.c")).alias("main"),
        F.when(one, 1).otherwise(blocks(F.col("all") - F.col("largest.n"))).alias("others"),
        F.when(one, 0).otherwise(blocks(F.col("largest.n"))).alias("mains"),
    )
    placed = members.join(counts, "band").withColumn("main", F.coalesce(F.col("c") == F.col("main"), F.lit(False)))
    dealt = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    own = F.when(F.col("main"), F.col("others") + dealt("mains")).otherwise(dealt("others"))
    last = F.col("others") + F.when(F.col("main"), 0).otherwise(F.col("mains")) - 1
    tiled = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    tiled = tiled.drop("main", "others", "mains")
    tiled = tiled.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")
    return tiled.join(payload, "node").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "node")


def _compared(percent: int, exact: bool):
    """Compares what stands in one tile of a bucket, each pair in the first band that its sets share; band 0 stands for none.

    Without ``exact``: the members with a partner in another component that signatures don't rule out.
    With it: the linked pairs, by their full sets.
    """
    least = _least_agreement(percent)

    def tile(t: pa.Table) -> list[tuple[int, int]]:
        node, c, n, own = (t.column(x).to_numpy() for x in ("node", "c", "n_shingles", "own"))
        if c.min() == c.max():
            return []
        across = t.column("i")[0].as_py() != t.column("j")[0].as_py()
        band = t.column("band")[0].as_py()
        bands = np.array(t.column("bands").to_pylist(), np.int64)
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, ROWS * bands_for(percent))
        before = int(np.flatnonzero(bands[0] == band)[0])
        sets = [np.frombuffer(x.as_buffer(), tx.U) for x in t.column("shingles")] if exact else None
        out = []
        for x in range(len(node) - 1):
            rest = slice(x + 1, None)
            may = (c[rest] != c[x]) & (100 * np.minimum(n[rest], n[x]) >= percent * np.maximum(n[rest], n[x]))
            if across:
                may &= own[rest] != own[x]
            y = np.flatnonzero(may) + x + 1
            if len(y):
                y = y[(sig[y] == sig[x]).sum(axis=1) >= least]
            if len(y) and before:
                y = y[~((bands[y, :before] == bands[x, :before]) & (bands[x, :before] != 0)).any(axis=1)]
            if not len(y):
                continue
            if not exact:
                out += [(band, int(node[x])), *((band, int(k)) for k in node[y])]
                continue
            every, at = np.concatenate([sets[k] for k in y]), np.cumsum([0, *(len(sets[k]) for k in y)])[:-1]
            found = np.minimum(np.searchsorted(sets[x], every), len(sets[x]) - 1)
            both = np.add.reduceat((sets[x][found] == every).astype(np.int64), at)
            linked = 100 * both >= percent * (n[x] + n[y] - both)
            out += [(int(node[x]), int(k)) for k in node[y[linked]]]
        return out if exact else list(set(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tx.runs(batches, ("band", "i", "j")):
            found = tile(t)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])

    return run


def linked(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per document ``doc_id, n_shingles, component_id``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = saved(texts.mapInArrow(_marks(size), MARKS), "marks")
    with_set = marks.filter("doc_id is not null and fp_a is not null")
    of_set = saved(with_set.groupBy(*FP).agg(F.min("doc_id").alias("node")), "sets-of-copies")
    nodes = saved(of_set.groupBy("node").agg(F.min(F.struct(*FP)).alias("set")).select("node", "set.*"), "nodes")
    # a document that is one row and its set's node needs no join to be told from copies
    rows = with_set.groupBy(F.col("doc_id").alias("node")).agg(F.count("*").alias("rows"))
    rows = rows.join(nodes.select("node", F.lit(True).alias("first")), "node", "left")
    others = taken(saved(rows.filter("rows > 1 or first is null").select("node"), "others"))
    given = texts.filter("doc_id is not null")
    alone, others = (given.select("*", hashed("doc_id")).mapInArrow(_bands(size, percent, others, x), BANDS) for x in (False, True))
    others = others.dropDuplicates(["node", *FP]).join(nodes, ["node", *FP], "left_semi")
    members = alone.union(others.select(*alone.columns)).select("node", F.explode("bands").alias("band"))
    bucket = Window.partitionBy("band")
    members = members.select("band", "node", F.min("node").over(bucket).alias("hub"), F.count("*").over(bucket).alias("n"))
    members = saved(members.filter("n > 1").drop("n"), "members")
    active = saved(members.select("node").distinct().join(nodes, "node"), "active").withColumnRenamed("node", "doc_id")
    sets = saved(
        given.filter(possibly("doc_id", active.select("doc_id")))
        .join(active, "doc_id")
        .dropDuplicates(["doc_id", "text"])
        .mapInArrow(_sets(size, percent), SETS),
        "sets",
    )
    sketch, sets = sets.drop("shingles"), sets.select("node", "shingles")
    stars = (
        members.filter("node <> hub")
        .groupBy("node", "hub")
        .count()
        .groupBy("node")
        .agg(F.max(F.struct("count", -F.col("hub"))).alias("best"))
        .select(F.col("node").alias("u"), (-F.col("best.col2")).alias("v"))
    )
    first = _links(stars, sketch, sets, percent)
    label = saved(components(first), "components")
    placed = members.join(label, "node", "left").select("band", "node", F.coalesce("component", "node").alias("c"))
    placed = saved(placed, "placed")
    mixed = placed.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("band")
    apart = saved(placed.join(mixed, "band", "left_semi"), "apart")
    # of a node's bands those count here that sets of different components share
    shared = apart.groupBy("node").agg(F.collect_set("band").alias("shared"))
    bands = F.transform("bands", lambda b: F.when(F.array_contains("shared", b), b).otherwise(F.lit(0)))
    sketch = saved(sketch.join(shared, "node").withColumn("bands", bands).drop("shared"), "signatures")
    near = _tiles(apart, sketch, BLOCK * WIDER).mapInArrow(_compared(percent, False), "band long, node long").distinct()
    near = saved(near, "near")
    ends = possibly("node", saved(near.select("node").distinct(), "ends"))
    payload = sketch.filter(ends).join(sets.filter(ends), "node")
    near = near.join(placed, ["band", "node"])
    second = saved(_tiles(near, payload, BLOCK).mapInArrow(_compared(percent, True), "u long, v long"), "links")
    label = components(first.union(second))
    of_set = of_set.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return marks.join(of_set, FP, "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    )
