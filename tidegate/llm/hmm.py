"""A hidden Markov language model of words, trained by Baum-Welch over all training texts.

States emit word classes. A word that makes up one in ``FREQUENT`` of all training tokens, or more, is a class of
its own; every other word belongs to the class of its last three bytes (hashed to ``SUFFIXES`` classes), within which
it has its smoothed share. So the parameters have a fixed size, and the words' counts, which grow with the corpus,
stay distributed: each chunk of texts asks for the counts of its own words by a join.

Texts are coded once, in chunks of bounded size, as one row each: the chunk's different words and the texts as
numbers of these. Baum-Welch takes its expected counts from these rows, task by task, over stretches of ``STRETCH`` tokens;
the sums of the tasks are added up and give the next parameters. The likelihood of a text is exact: the scaled
forward recursion runs over the whole text, and the classes' shares of its words are added.

A null text has only its end token. A null doc_id is not held out. Words are lower-cased A-Z; words are told apart
by 64-bit hashes. Repeated rows train and are scored one by one. An empty table has no scores; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm import text as tx
from tidegate.llm.store import saved

FREQUENT = 4096
SUFFIXES = 1024
STRETCH = 64
CHUNK = 3 << 20
#: Bits of a count beside the place of its word; frequent words, whose counts are largest, are not asked for.
COUNT_BITS = 40
STATES = 8
ROUNDS = 4
END_HASH = np.uint64(0x9C1E57A3D0B4F26B)

CODED = (
    "chunk long, ids array<long>, held array<boolean>, lengths array<int>, tokens binary,"
    " words array<long>, suffixes array<int>, counts array<int>"
)


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 32
    for piece in tx.pieces(batches, "text", CHUNK):
        data, offsets = tx.bytes_of(piece.column("text"))
        data = tx.LOWER[data]
        starts, ends, bounds = tx.word_spans(data, offsets)
        # the last three bytes of each word
        suffix = np.zeros(len(ends), tx.U)
        for back in (1, 2, 3):
            inside = ends - back >= starts
            suffix |= np.where(inside, data[np.maximum(ends - back, 0)], 0).astype(tx.U) << tx.U(8 * back)
        suffix = (tx.mix(suffix) % tx.U(SUFFIXES)).astype(np.int32)
        # an end token after each text
        hashes = np.insert(tx.spans_hash(data, starts, ends), bounds[1:], END_HASH)
        suffix = np.insert(suffix, bounds[1:], 0)
        lengths = np.diff(bounds) + 1
        held = piece.column("held").to_numpy(zero_copy_only=False).astype(bool)
        words, first, tokens = np.unique(hashes, return_index=True, return_inverse=True)
        counts = np.bincount(tokens[np.repeat(~held, lengths)], minlength=len(words))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([chunk]),
                _list(piece.column("doc_id")),
                _list(piece.column("held")),
                _list(pa.array(lengths.astype(np.int32))),
                pa.array([tokens.astype(_width(len(words))).tobytes()], pa.binary()),
                _list(pa.array(words.view(np.int64))),
                _list(pa.array(suffix[first])),
                _list(pa.array(counts.astype(np.int32))),
            ],
            ["chunk", "ids", "held", "lengths", "tokens", "words", "suffixes", "counts"],
        )
        chunk += 1


def _width(words: int) -> str:
    """Numbers of a chunk's words take two bytes where that is enough."""
    return "<u2" if words <= 1 << 16 else "<u4"


def _list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


class Classes(NamedTuple):
    """The frequent words, sorted by hash, and after them the suffix classes."""

    frequent: np.ndarray

    @property
    def size(self) -> int:
        return len(self.frequent) + SUFFIXES

    def of(self, words: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
        out = suffixes + len(self.frequent)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, words), len(self.frequent) - 1)
            out = np.where(self.frequent[at] == words, at, out)
        return out


class Parameters(NamedTuple):
    start: np.ndarray  # of a text
    middle: np.ndarray  # of a stretch inside a text
    move: np.ndarray
    emit: np.ndarray  # classes x states


def initial(weights: np.ndarray, states: int, seed: int = 7) -> Parameters:
    rng = np.random.default_rng(seed)
    emit = (weights + 1)[:, None] * np.exp(0.5 * rng.standard_normal((len(weights), states)))
    move = np.full((states, states), 0.2 / max(states - 1, 1)) + (0.8 - 0.2 / max(states - 1, 1)) * np.eye(states)
    same = np.full(states, 1 / states)
    return Parameters(same, same, move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def expected(p: Parameters, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Baum-Welch's expected counts of some texts, in one array: starts, occupancies, moves, emissions, log likelihood."""
    k = len(p.start)
    begins = np.cumsum(lengths) - lengths
    parts = -(-lengths // STRETCH)
    text = np.repeat(np.arange(len(lengths)), parts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    size = np.minimum(lengths[text] - number * STRETCH, STRETCH)
    order = np.argsort(-size, kind="stable")
    begin, size, opening = (begins[text] + number * STRETCH)[order], size[order], (number == 0)[order]
    live = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size[0]))]  # stretches longer than t
    alpha, scale, emitted = [], [], []
    a = np.where(opening[:, None], p.start, p.middle).astype(np.float32)
    emit, move = p.emit.astype(np.float32), p.move.astype(np.float32)
    for t, n in enumerate(live):
        b = emit[classes[begin[:n] + t]]
        a = (a[:n] if not t else a[:n] @ move) * b
        c = a.sum(axis=1, keepdims=True)
        a = a / c
        alpha.append(a)
        scale.append(c)
        emitted.append(b)
    moves, emissions = np.zeros((k, k)), np.zeros((len(p.emit), k))
    gammas, at = [None] * len(live), [begin[:n] + t for t, n in enumerate(live)]
    beta = np.ones((live[-1], k), np.float32)
    for t in range(len(live) - 1, -1, -1):
        if t < len(live) - 1:
            later = live[t + 1]
            onward = emitted[t + 1] * beta / scale[t + 1]
            moves += alpha[t][:later].T @ onward
            beta = np.ones((live[t], k), np.float32)
            beta[:later] = onward @ move.T
        gammas[t] = alpha[t] * beta
    first = gammas[0]
    gamma, seen = np.concatenate(gammas), classes[np.concatenate(at)]
    for s in range(k):
        emissions[:, s] = np.bincount(seen, weights=gamma[:, s], minlength=len(p.emit))
    likelihood = sum(float(np.log(c).sum()) for c in scale)
    return np.concatenate(
        [first[opening].sum(axis=0), gamma.sum(axis=0), (moves * p.move).ravel(), emissions.ravel(), [likelihood]]
    )


def maximised(sums: np.ndarray, states: int, weights: np.ndarray) -> Parameters:
    start, middle, rest = sums[:states] + 0.1, sums[states : 2 * states] + 0.1, sums[2 * states : -1]
    move = rest[: states * states].reshape(states, states) + 0.1
    # a hundredth of a token of each class, so that none is impossible
    emit = rest[states * states :].reshape(-1, states) + 0.01
    return Parameters(start / start.sum(), middle / middle.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def forward(p: Parameters, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log likelihood of each whole text by the scaled forward recursion, all texts of a chunk at once."""
    order = np.argsort(-lengths, kind="stable")
    begin, size = (np.cumsum(lengths) - lengths)[order], lengths[order]
    out = np.zeros(len(lengths))
    a = np.broadcast_to(p.start, (len(lengths), len(p.start)))
    lives = np.searchsorted(-size, -np.arange(size[0]), "left") if len(size) else []
    for t, n in enumerate(lives):
        a = (a[:n] if not t else a[:n] @ p.move) * p.emit[classes[begin[:n] + t]]
        c = a.sum(axis=1)
        a = a / c[:, None]
        out[:n] += np.log(c)
    back = np.empty(len(lengths))
    back[order] = out
    return back


def _chunks(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        row = {name: batch.column(name)[k] for name in batch.schema.names}
        yield {name: value.values if isinstance(value, pa.ListScalar) else value for name, value in row.items()}


def _sequence(row: dict, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """The class of each of the chunk's words, and the words' numbers along the texts."""
    of_word = classes.of(row["words"].to_numpy().view(tx.U), row["suffixes"].to_numpy())
    return of_word, np.frombuffer(row["tokens"].as_buffer(), _width(len(of_word)))


def _expectation(parameters, classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            for row in _chunks(batch):
                of_word, tokens = _sequence(row, classes.value)
                lengths = row["lengths"].to_numpy()
                train = ~row["held"].to_numpy(zero_copy_only=False).astype(bool)
                if train.any():
                    sequence = of_word[tokens][np.repeat(train, lengths)]
                    sums = expected(parameters.value, sequence, lengths[train])
                    total = sums if total is None else total + sums
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() % 32]), pa.array([total.tobytes()], pa.binary())], ["part", "sums"]
            )

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for value in batch.column("sums"):
            sums = np.frombuffer(value.as_buffer())
            total = sums.copy() if total is None else total + sums
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])


CLASSED = "chunk long, ids array<long>, held array<boolean>, lengths array<int>, tokens binary, classes array<int>"


def _classed(classes):
    """Chunks with their words' classes in place of the words: less to shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(_chunks(batch)):
                of_word, _ = _sequence(row, classes.value)
                kept = batch.slice(k, 1).select(["chunk", "ids", "held", "lengths", "tokens"])
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, _list(pa.array(of_word.astype(np.int32)))], [*kept.schema.names, "classes"]
                )

    return run


class Facts(NamedTuple):
    tokens: int
    words: int
    counts: np.ndarray  # of the frequent words
    class_tokens: np.ndarray  # of the suffix classes
    class_words: np.ndarray


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(parameters, classes, facts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, groups, f = parameters.value, classes.value, facts.value
        frequent = len(groups.frequent)
        for batch in batches:
            for row in _chunks(batch):
                of_word = row["classes"].to_numpy()
                tokens = np.frombuffer(row["tokens"].as_buffer(), _width(len(of_word)))
                lengths = row["lengths"].to_numpy()
                counts = np.zeros(len(of_word), np.int64)
                own = of_word < frequent
                counts[own] = f.counts[of_word[own]]
                if row["answers"] is not None:
                    answers = row["answers"].to_numpy()
                    counts[answers >> COUNT_BITS] = answers & ((1 << COUNT_BITS) - 1)
                base = np.log10((counts + 0.5) / (f.tokens + 0.5 * (f.words + 1)))
                group = np.maximum(of_word - frequent, 0)
                share = np.log10((counts + 0.5) / (f.class_tokens[group] + 0.5 * (f.class_words[group] + 1)))
                share[own] = 0
                ends = np.cumsum(lengths)

                def total(values, ends=ends, lengths=lengths, tokens=tokens):
                    sums = np.append(0, np.cumsum(values[tokens]))
                    return sums[ends] - sums[ends - lengths]

                n = len(lengths)
                score = forward(p, of_word[tokens], lengths) / np.log(10) + total(share)
                yield pa.RecordBatch.from_arrays(
                    [
                        row["ids"],
                        row["held"],
                        pa.array(lengths.astype(np.int64)),
                        pa.array(total((counts > 0).astype(np.int64))),
                        pa.array([f.tokens] * n, pa.int64()),
                        pa.array(total(base)),
                        pa.array(score),
                    ],
                    [x.split()[0] for x in SCORED.split(", ")],
                )

    return run


def scored(docs: DataFrame, held_out: Column, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Per document ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``; learns from those not held out."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held"))
    coded = saved(texts.mapInArrow(_code, CODED), "coded")
    entries = coded.select("chunk", F.posexplode(F.arrays_zip("words", "suffixes", "counts")).alias("place", "e"))
    entries = entries.select("chunk", "place", "e.words", "e.suffixes", "e.counts")
    trained = entries.filter("counts > 0").groupBy("words", "suffixes").agg(F.sum("counts").alias("c"))
    vocabulary = saved(trained, "vocabulary")
    tokens, words = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = vocabulary.filter(F.col("c") * FREQUENT >= max(tokens, 1)).select("words", "c").toArrow()
    hashes, counts = top.column("words").to_numpy().view(tx.U), top.column("c").to_numpy()
    order = np.argsort(hashes)
    classes = Classes(hashes[order])
    seldom = vocabulary.filter(F.col("c") * FREQUENT < max(tokens, 1))
    class_tokens, class_words = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
    for suffix, c, n in seldom.groupBy("suffixes").agg(F.sum("c"), F.count("*")).collect():
        class_tokens[suffix], class_words[suffix] = c, n
    facts = Facts(tokens, words, counts[order], class_tokens, class_words)
    weights = np.concatenate([facts.counts, class_tokens]).astype(float)
    parameters, shared = initial(weights, states), context.broadcast(classes)
    rows = coded.select("held", "lengths", "tokens", "words", "suffixes")
    for _ in range(rounds if tokens else 0):
        step = rows.mapInArrow(_expectation(context.broadcast(parameters), shared), "part long, sums binary")
        # the tasks' sums meet in 32 groups, and these on the driver
        found = step.repartition(32, "part").mapInArrow(_added, "part long, sums binary").toArrow()
        sums = sum(np.frombuffer(x.as_buffer()) for x in found.column("sums"))
        parameters = maximised(sums, states, weights)
    asked = entries.select("chunk", "place", "words").join(seldom.select("words", "c"), "words")
    # place and count of a word in one number: such lists are a quarter of those of structs
    answer = F.expr(f"shiftleft(bigint(place), {COUNT_BITS}) | c")
    answers = asked.groupBy("chunk").agg(F.collect_list(answer).alias("answers"))
    return (
        coded.drop("counts")
        .mapInArrow(_classed(shared), CLASSED)
        .join(answers, "chunk", "left")
        .mapInArrow(_score(context.broadcast(parameters), shared, context.broadcast(facts)), SCORED)
    )
