"""The exact Jaccard join against brute force."""

from random import Random

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, empty, prose, rows
from pyspark.sql import functions as F
from test_documents import brute_components, shingles

from tidegate.llm import jaccard


def families(seed):
    """Texts with a passage in common, and copies of each with more and more words replaced or cut off."""
    random = Random(seed)
    passage = prose(60, seed)
    for k in range(8):
        words = f"{prose(60 + 25 * k, seed + k)} {passage}".split()
        for _ in range(5):
            yield " ".join(words)
            for _ in range(random.randrange(1, 5)):
                words[random.randrange(len(words))] = f"new{random.randrange(10**6)}"
            words = words[: len(words) - random.randrange(6)]


@pytest.mark.parametrize(("size", "percent", "block"), [(5, 80, 512), (3, 60, 4), (1, 100, 512), (2, 34, 3)])
def test_joined(spark, size, percent, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    awkward = [(r[0], r[1]) for r in rows()] + [(100 + k, t) for k, t in enumerate(families(5))]
    docs = spark.createDataFrame(awkward, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("token", F.lit("x"))
    found = jaccard.joined(docs, size, percent).collect()
    assert len(found) == len(awkward)
    expected = brute_components(awkward, size, percent)
    for doc_id, n, component in found:
        assert (n, component) == expected[doc_id] if doc_id is not None else component is None
    assert len({c for _, c in expected.values()}) < len(expected)


def test_clashing_ids_are_different_documents(spark):
    a, b = prose(50, 1), prose(50, 2)
    docs = spark.createDataFrame([(7, a), (7, b), (3, a), (9, b), (9, b)], "doc_id long, text string")
    found = sorted(tuple(r) for r in jaccard.joined(docs).collect())
    assert found == [(3, 46, 3), (7, 46, 3), (7, 46, 7), (9, 46, 7), (9, 46, 7)]


def test_bitmaps_bound_the_overlap():
    random = Random(3)
    for _ in range(200):
        pool = np.array([random.getrandbits(64) for _ in range(300)], np.uint64)
        a, b = (np.unique(pool[: random.randrange(1, 300)]) for _ in range(2))
        b = np.unique(np.append(b[random.randrange(len(b)) :], np.uint64(random.getrandbits(64))))
        x, y = jaccard._folded([jaccard.bitmap(a), jaccard.bitmap(b)])
        assert jaccard.most_common(x, y, len(a), len(b)) >= len(np.intersect1d(a, b))


def test_frequent_shingles_are_not_among_the_first():
    h = np.arange(1, 11, dtype=np.uint64)
    levels = np.zeros(jaccard.CELLS, np.uint8)
    levels[[1, 2, 3]] = 8
    token, owner = jaccard.first_shingles(h, np.array([0, 10]), levels, 80)
    assert token.tolist() == [4, 5, 6] and owner.tolist() == [0, 0, 0]


def test_tables_without_rows_or_with_extra_columns(spark):
    assert jaccard.joined(empty(spark)).count() == 0
    found = jaccard.joined(documents(spark)).collect()
    assert len(found) == len(rows())
    assert {r.n_shingles for r in found if r.doc_id in (5, 6, 7)} == {0}
    assert {r.n_shingles for r in found if r.doc_id in (8, 9)} == {len(shingles("word", 5))}


@pytest.mark.parametrize(("before", "meanwhile"), [("10000", "1000"), ("0", "1000"), ("300", "300")])
def test_jobs_of_the_join_send_few_rows_at_once(spark, monkeypatch, before, meanwhile):
    name, old, met = "spark.sql.execution.arrow.maxRecordsPerBatch", jaccard.saved, set()

    def saved(df, what):
        met.add(spark.conf.get(name))
        if what == "members" and before == "300":
            raise RuntimeError(what)
        return old(df, what)

    monkeypatch.setattr(jaccard, "saved", saved)
    given = spark.conf.get(name)
    spark.conf.set(name, before)
    try:
        docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
        if before == "300":
            with pytest.raises(RuntimeError):
                jaccard.joined(docs)
        else:
            assert {r.component_id for r in jaccard.joined(docs).collect()} == {1}
        assert met == {meanwhile} and spark.conf.get(name) == before
    finally:
        spark.conf.set(name, given)


def test_texts_are_worked_on_in_small_pieces():
    texts = [prose(400, k) for k in range(600)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(600)), "text": texts})
    found = [b.column("doc_id").to_pylist() for b in jaccard._measured(5)(iter([batch])) if not b.column("doc_id").null_count]
    assert sum(found, []) == list(range(600)) and len(found) > 3
    assert max(sum(len(texts[k].encode()) for k in ids) for ids in found) <= 1 << 18
