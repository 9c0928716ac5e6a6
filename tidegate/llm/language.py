"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of the characters of its words, of order four, with a word's ends as characters. Only the
counts of four-character runs come from the corpus, over all training texts; those of lower orders are Kneser-Ney's
continuation counts. Every run counts, however rare: discounts and continuation counts rest on those seen once or
twice. Models lie in arrays sorted by hash, a column per language, so one binary search serves all languages; they
grow with the different runs of the languages, not with the texts.

A text's language is the one with the lowest cross-entropy per character. A sixteenth of the labelled texts is kept
from counting and calibrates: the temperature that turns cross-entropies into a probability (the score), and the
cross-entropy above which a text is rejected, per language and by length, as short texts vary more. The limit of 4^b
characters comes from the first 4^b characters of all texts set aside that are that long: it rejects ``REJECTED`` of
them, or what lies more than ``SPREADS`` times as far above the median as the ninth decile does, whichever is lower:
few wrongly labelled texts move neither median nor decile. Texts that another language's model fits better do not
calibrate, as they would not be judged by this limit either.

A null text, or one without a letter, is ``und`` with score 0 and rejected; so is everything if nothing is
labelled. Null labels don't train. Rows are predicted one by one, repeated or not. Of equal cross-entropies the
language that comes first by name counts. An empty table has no predictions; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm import text as tx

ORDER = 4
#: Share of a language's own texts that its limit may reject.
REJECTED = 0.001
SPREADS = 8.0
#: The least distance of the ninth decile from the median, and the fewest texts that tell both.
LEAST_SPREAD, LEAST_TEXTS = 0.1, 30
#: Limits are for texts of at least 1, 4, 16, ... characters.
LENGTHS = 4 ** np.arange(8)
#: Words whose score a task remembers.
KNOWN = 300_000
BEGIN, END = 1, 2
TEMPERATURES = np.geomspace(0.01, 30, 40)


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The four-character runs of the words' letters, packed into 64 bits, and the number of runs of each word."""
    clean = ["".join(filter(str.isalpha, w)).lower() for w in words]
    lengths = np.array([len(w) + 1 if w else 0 for w in clean], np.int64)
    text = "".join(f"\x01\x01\x01{w}\x02" for w in clean if w)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(tx.U)
    codes = np.where(codes < 0x10000, codes, 0xE000 + codes % tx.U(0x1900)).astype(tx.U)
    if not len(codes):
        return np.zeros(0, tx.U), lengths
    packed = codes[3:].copy()
    for back in (1, 2, 3):
        packed |= codes[3 - back : len(codes) - back] << tx.U(16 * back)
    return packed[codes[3:] != BEGIN], lengths


class Distinct(NamedTuple):
    words: list[str]
    hashes: np.ndarray
    number: np.ndarray  # of each word of the texts
    bounds: np.ndarray


def distinct_words(texts: pa.Array) -> Distinct:
    data, offsets = tx.bytes_of(texts)
    starts, ends, bounds = tx.word_spans(data, offsets)
    hashes, first, number = np.unique(tx.spans_hash(data, starts, ends), return_index=True, return_inverse=True)
    buffer = data.tobytes()
    words = [buffer[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    return Distinct(words, hashes, number, bounds)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in tx.pieces(batches, "text", 4 << 20):
        langs = piece.column("lang").dictionary_encode()
        of_text, names = langs.indices.to_numpy(), langs.dictionary.to_pylist()
        found = distinct_words(piece.column("text"))
        runs, lengths = grams_of(found.words)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        of_word = np.repeat(of_text, np.diff(found.bounds))
        for k, name in enumerate(names):
            n = np.bincount(found.number[of_word == k], minlength=len(found.words))[owner]
            values, inverse = np.unique(runs[n > 0], return_inverse=True)
            counts = np.bincount(inverse, weights=n[n > 0], minlength=len(values)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(values)), pa.array(values.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"]
            )


class Model(NamedTuple):
    """By order from 2: hashes of runs and their discounted shares, hashes of contexts and their weights of lower orders."""

    langs: list[str]
    single: tuple[np.ndarray, np.ndarray]
    orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    temperature: float = 1.0
    limits: np.ndarray = np.zeros((0, len(LENGTHS)))


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once else 0.5


def _columns(parts: list[tuple[np.ndarray, np.ndarray]], default: float) -> tuple[np.ndarray, np.ndarray]:
    """One array sorted by hash from an array per language."""
    hashes = np.unique(np.concatenate([h for h, _ in parts])) if parts else np.zeros(0, tx.U)
    out = np.full((len(hashes) + 1, len(parts)), default, np.float32)  # the last row stands for what isn't there
    for k, (h, values) in enumerate(parts):
        out[np.searchsorted(hashes, h), k] = values
    return hashes, out


def fitted(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model of four-character runs and their counts per language."""
    langs, tables, single = sorted(counts), [[[], []] for _ in range(ORDER - 1)], []
    for lang in langs:
        runs, n = counts[lang]
        for order in range(ORDER, 0, -1):
            d = _discount(n)
            if order > 1:
                context, at = np.unique(runs >> tx.U(16), return_inverse=True)
                total = np.bincount(at, weights=n)
                share, weight = np.maximum(n - d, 0) / total[at], d * np.bincount(at) / total
                tables[order - 2][0].append((tx.mix(runs), share))
                tables[order - 2][1].append((tx.mix(context), weight))
                runs, n = np.unique(runs & tx.U((1 << 16 * (order - 1)) - 1), return_counts=True)
            else:
                single.append((tx.mix(runs), (np.maximum(n - d, 0) + d * len(n) / 65536) / max(n.sum(), 1)))
    orders = [(*_columns(share, 0), *_columns(weight, 1)) for share, weight in tables]
    return Model(langs, _columns(single, 1 / 65536 / 100), orders)


def _at(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each hash stands; the row after the last if nowhere."""
    at = np.searchsorted(hashes, wanted)
    hit = at < len(hashes)
    hit[hit] = hashes[at[hit]] == wanted[hit]
    return np.where(hit, at, len(hashes))


def _entropy(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = sums[:, -1].round()
    return -sums[:, :-1] / np.maximum(n, 1)[:, None], n


class Scorer:
    """Cross-entropies of texts; words scored once are remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.hashes = np.zeros(0, tx.U)
        self.scores = np.zeros((0, len(model.langs) + 1))

    def _words(self, words: list[str]) -> np.ndarray:
        """Per word the log probability in each language and the number of characters."""
        runs, lengths = grams_of(words)
        runs, back = np.unique(runs, return_inverse=True)
        p = self.model.single[1][_at(self.model.single[0], tx.mix(runs & tx.U(0xFFFF)))].astype(float)
        for order, (h, share, contexts, weight) in enumerate(self.model.orders, 2):
            own = runs & tx.U((1 << 16 * order) - 1)
            p = share[_at(h, tx.mix(own))] + weight[_at(contexts, tx.mix(own >> tx.U(16)))] * p
        logs = np.vstack([np.zeros(p.shape[1]), np.cumsum(np.log(p)[back], axis=0)])
        ends = np.cumsum(lengths)
        return np.column_stack([logs[ends] - logs[ends - lengths], lengths])

    def _sums(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the words before each word of log probabilities and characters, and where texts begin and end."""
        found = distinct_words(texts)
        new = np.flatnonzero(_at(self.hashes, found.hashes) == len(self.hashes))
        if len(new):
            if len(self.hashes) > KNOWN:
                self.hashes, self.scores, new = self.hashes[:0], self.scores[:0], np.arange(len(found.hashes))
            hashes = np.append(self.hashes, found.hashes[new])
            order = np.argsort(hashes)
            self.hashes = hashes[order]
            self.scores = np.vstack([self.scores, self._words([found.words[k] for k in new])])[order]
        rows = self.scores[_at(self.hashes, found.hashes)][found.number]
        return np.vstack([np.zeros(rows.shape[1]), np.cumsum(rows, axis=0)]), found.bounds

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy of each text in each language, and its number of characters."""
        sums, bounds = self._sums(texts)
        return _entropy(sums[bounds[1:]] - sums[bounds[:-1]])

    def beginnings(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By length: its number, the texts that long, and their words' cross-entropies up to there."""
        sums, bounds = self._sums(texts)
        n = sums[:, -1].round()
        for k, length in enumerate(LENGTHS):
            at = np.searchsorted(n, n[bounds[:-1]] + length)
            long = np.flatnonzero(at <= bounds[1:])
            yield k, long, _entropy(sums[at[long]] - sums[bounds[:-1][long]])[0]


def _shares(entropy: np.ndarray, n: np.ndarray, temperature) -> np.ndarray:
    """Probabilities of the languages."""
    z = -np.asarray(temperature) * entropy * np.sqrt(n)[:, None]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _calibration(model):
    """By true language: its number, cross-entropies of its texts by number of length; log likelihoods by temperature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        langs = {name: k for k, name in enumerate(model.value.langs)}
        for piece in tx.pieces(batches, "text", 4 << 20):
            entropy, n = scorer(piece.column("text"))
            true = np.array([langs.get(x, -1) for x in piece.column("lang").to_pylist()])
            ok = np.flatnonzero((true >= 0) & (n > 0))
            if not len(ok):
                continue
            fit = [np.log(_shares(entropy[ok], n[ok], t)[np.arange(len(ok)), true[ok]] + 1e-12).sum() for t in TEMPERATURES]
            found = [(np.full(len(fit), -1), np.arange(len(fit)), np.array(fit))]
            own = (true >= 0) & (n > 0) & (entropy.argmin(axis=1) == true)
            for length, texts, beginning in scorer.beginnings(piece.column("text")):
                mine = own[texts]
                lang = true[texts[mine]]
                found.append((lang, np.full(len(lang), length), beginning[mine][np.arange(len(lang)), lang]))
            columns = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["lang", "stat", "value"]
            )

    return run


def _limits(spreads: dict[tuple[int, int], tuple[int, float, float, float]], langs: int) -> np.ndarray:
    """Per language and length the highest cross-entropy accepted, from (language or -1 for all, length): number of
    texts, median, ninth decile, and quantile at 1 - ``REJECTED``. Too few texts take those of all languages, then the
    limit of the next shorter length, which is no lower for texts that vary less."""
    limits = np.full((langs, len(LENGTHS)), np.inf)
    for lang in range(langs):
        for length in range(len(LENGTHS)):
            tried = [spreads[k, length] for k in (lang, -1) if (k, length) in spreads]
            told = next((x for x in tried if x[0] >= LEAST_TEXTS), None)
            if told is None and length:
                limits[lang, length] = limits[lang, length - 1]
                continue
            if told is None and tried:
                told = tried[-1]
            if told is not None:
                n, median, decile, top = told
                limit = median + SPREADS * max(decile - median, LEAST_SPREAD)
                limits[lang, length] = min(limit, top) if n * REJECTED >= 1 else limit
    return limits


def trained(docs: DataFrame) -> Model:
    """The calibrated model of labelled documents (text, lang)."""
    spark = docs.sparkSession
    labelled = docs.select("text", "lang").filter("text is not null and lang is not null")
    aside = F.pmod(F.xxhash64("text"), F.lit(16)) == 0
    counts = labelled.filter(~aside).mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counts.toArrow().combine_chunks()
    by_lang = {}
    if found.num_rows:
        names = pa.concat_arrays(found.column("lang").chunks).dictionary_encode()
        of_run = names.indices.to_numpy()
        runs, n = found.column("gram").to_numpy().view(tx.U), found.column("n").to_numpy().astype(float)
        by_lang = {lang: (runs[of_run == k], n[of_run == k]) for k, lang in enumerate(names.dictionary.to_pylist())}
    if not by_lang:
        return Model([], (np.zeros(0, tx.U), np.zeros((1, 0), np.float32)), [])
    model = fitted(by_lang)
    held = spark.sparkContext.broadcast(model)
    rows = labelled.filter(aside).mapInArrow(_calibration(held), "lang long, stat long, value double")
    quantiles = F.percentile_approx("value", [0.5, 0.9, 1 - REJECTED], 100_000)
    fits, spreads = np.zeros(len(TEMPERATURES)), {}
    for fit, stat, lang, n, total, (median, decile, top) in (
        rows.withColumn("fit", F.col("lang") < 0)
        .rollup("fit", "stat", "lang")
        .agg(F.count("*"), F.sum("value"), quantiles)
        .filter("stat is not null")
        .collect()
    ):
        if fit:
            fits[stat] = total
        else:
            spreads[-1 if lang is None else lang, stat] = n, median, decile, top
    limits = _limits(spreads, len(model.langs))
    return model._replace(temperature=float(TEMPERATURES[int(np.argmax(fits))]) if fits.any() else 1.0, limits=limits)


def _predict(model, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, langs = Scorer(model.value), [*model.value.langs, "und"]
        limits = np.vstack([model.value.limits, np.full(len(LENGTHS), -np.inf)])
        for piece in tx.pieces(batches, "text", 4 << 20):
            best = np.full(piece.num_rows, len(langs) - 1)
            score, lowest = np.zeros(piece.num_rows), np.full(piece.num_rows, np.inf)
            length = np.zeros(piece.num_rows, int)
            if len(langs) > 1:
                entropy, n = scorer(piece.column("text"))
                some = np.flatnonzero(n > 0)
                length[some] = np.searchsorted(LENGTHS, n[some], "right") - 1
                best[some], lowest[some] = entropy[some].argmin(axis=1), entropy[some].min(axis=1)
                score[some] = _shares(entropy[some], n[some], model.value.temperature).max(axis=1) if len(some) else 0
            yield pa.RecordBatch.from_arrays(
                [
                    *(piece.column(c) for c in columns),
                    pa.array([langs[k] for k in best], pa.string()),
                    pa.array(score),
                    pa.array(lowest),
                    pa.array(lowest <= limits[best, length]),
                ],
                [*columns, "lang_pred", "score", "cross_entropy", "accepted"],
            )

    return run


def identified(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """The given columns of each document with ``lang_pred, score, cross_entropy, accepted``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(*dict.fromkeys([*columns, "text"]))
    schema = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in columns)
    return chosen.mapInArrow(
        _predict(held, columns), f"{schema}, lang_pred string, score double, cross_entropy double, accepted boolean"
    )


def fold(parts: int) -> Column:
    """The remainder that deals documents into parts; null ids go to part 0."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)), F.lit(0))
