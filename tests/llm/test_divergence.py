"""The recount of terms per source against brute force."""

import re
from collections import Counter, defaultdict
from random import Random

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, empty, rows

from tidegate.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, least, top, scale=10**9, smoothing=5):
    """docs: (text, lang, source)."""
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        groups.add((lang, source))
        seen[lang].update(set(terms))
        counts[lang, source].update(terms)
        counts[lang, None].update(terms)
    kept = {lang: {t for t, n in c.items() if n >= least} for lang, c in seen.items()}

    def shares(lang, source):
        own = {t: counts[lang, source][t] for t in kept[lang]}
        total = sum(own.values()) + smoothing * len(own)
        return {t: 1 + scale * (n + smoothing) // total for t, n in own.items()}

    out = set()
    for lang, source in groups:
        p, q = shares(lang, source), shares(lang, None)
        pairs = []
        for other_lang, other in groups:
            if other_lang == lang and other != source:
                o = shares(lang, other)
                pairs.append((-sum(abs(p[t] - o[t]) for t in p), other.encode()))
        terms = [(q[t] - p[t], t.encode()) for t in p if counts[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out |= {(lang, source, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(found)}
    return out


def texts():
    random = Random(9)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("ei", "Ou", "漢", "é", "zz")]
    for k in range(160):
        lang, source = random.choice(["en", "fr", None, ""]), random.choice("pqrstuv")
        own = words[(ord(source) % 5) * 3 :]
        yield " ".join(random.choices(own, k=random.randrange(40))) + " 12-x_y", lang, source


@pytest.mark.parametrize("limits", [{}, {"SHARD": 5, "TILE": 2, "PART": 4, "STEP": 2, "BLOCK_BYTES": 1}])
def test_audit(spark, limits, monkeypatch):
    for name, value in limits.items():
        monkeypatch.setattr(divergence, name, value)
    docs = [*texts(), (None, "en", "p"), ("", "xx", None), ("rare", "xx", "a"), ("rare", "xx", "b"), (None, None, None)]
    table = spark.createDataFrame(docs, "text string, lang string, source string").selectExpr("*", "1 as term", "2 as p")
    for least, top in ((6, 4), (1, 50), (10**6, 5)):
        found = [tuple(r) for r in divergence.audited(table, least, top).select("lang", "source", "part", "item", "value", "rank").collect()]
        assert len(found) == len(set(found))
        assert set(found) == brute(docs, least, top)


def test_large_counts_are_exact(spark):
    count, total = 123_456_789_012_345, 987_654_321_098_765
    df = spark.createDataFrame([(count, total, 77)], "c long, n long, v long")
    p = divergence.share(df["c"], df["n"], df["v"], 10**9, 5)
    assert df.select(p).first()[0] == 1 + 10**9 * (count + 5) // (total + 5 * 77)


@pytest.mark.parametrize("levels", [32, 1])
def test_perfect_hash(monkeypatch, levels):
    monkeypatch.setattr(divergence, "LEVELS", levels)
    known, other = ([f"{p}{k}é" for k in range(5000)] for p in "ab")
    made = divergence.Perfect(pa.array(known))
    every = pa.array(known + other, pa.large_string())
    slots = made.slots(every, divergence.hashes(every))
    assert sorted(slots[:5000]) == list(range(5000)) and set(slots[5000:]) == {-1}
    assert made.terms.take(pa.array(slots[:5000])).to_pylist() == known
    # a stored term with the hash of another word is told apart
    monkeypatch.setattr(divergence, "hashes", lambda terms: np.zeros(len(terms), np.uint64))
    same = divergence.Perfect(pa.array(["x", "y"]))
    assert same.slots(pa.array(["y", "z", "x"], pa.large_string()), np.zeros(3, np.uint64)).tolist() == [1, -1, 0]


def test_terms():
    code, terms, owner = divergence.terms_of(pa.array(["Ab,c1ab", None, "", "é漢-ÉC"]))
    assert [terms[k].as_py() for k in code] == ["ab", "c", "ab", "é漢", "Éc"] and owner.tolist() == [0, 0, 0, 3, 3]


def test_awkward_tables(spark):
    assert divergence.audited(empty(spark)).count() == 0
    found = {tuple(r) for r in divergence.audited(documents(spark), least=2).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert found == brute([(r[1], r[2], r[3]) for r in rows()], 2, 50)
