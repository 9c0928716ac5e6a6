"""URL rules, top-k search, components, the pipeline, and the queries against their SQL."""

import re
from collections import Counter

import numpy as np
import pytest
from cases import documents, empty, prose
from oracle import connect, differences
from pyspark.sql import functions as F
from test_documents import brute_components

import corpus_pipeline
from tidegate.llm import graph, repeats, topk, urls
from tidegate.llm.queries import ORACLES, QUERIES, RULES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    assert differences(spark, connect(SMALL), QUERIES[name], ORACLES[name], SMALL) == []


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


# --- components --------------------------------------------------------------------------------------------------


def test_components(spark):
    path = [(k, k + 1) for k in range(40)]
    star = [(100, k) for k in range(101, 160)]
    edges = spark.createDataFrame([*path, *star, (200, 201), (201, 200), (300, 300)], "u long, v long")
    found = dict(graph.components(edges).collect())
    assert {found[k] for k in range(41)} == {0}
    assert {found[k] for k in range(100, 160)} == {100}
    assert found[200] == found[201] == 200
    assert 300 not in found
    assert graph.components(edges.limit(0)).count() == 0


# --- urls --------------------------------------------------------------------------------------------------------

PAGES = [
    (1, "https://a.Example.com/en/1", None),
    (2, "http://www.example.com/en/2?x=1#y", "<p>"),
    (3, "http://shop.example.net/es/3", ""),
    (4, "http://other.org/4", '<link rel="canonical" href="http://shop.example.net/es/3/">'),
    (5, "http://third.org/5", "<META http-equiv='refresh' content='0; URL=http://other.org/4#top'>"),
    (6, "http://sixth.com/6", '<link href="//third.org/5" rel=canonical>'),
    (7, None, '<link rel="canonical" href="http://other.org/4">'),
    (8, "no scheme", None),
    (9, "://", None),
    (10, "x://HOST", None),
    (11, "http://com/x", None),
    (12, "http://example.com", None),
    (13, "http://notexample.com/en/", None),
    (14, "http://free.org/a", '<meta property="og:url" content="http://shop.example.net/fr/1">'),
    (14, "http://free.org/a", None),
    (None, "http://alone.org/?utm_source=x", None),
    (15, "http://mixed.org/1", '<link rel="canonical" href="http://ok.com/">'),
    (16, "http://mixed2.org/1", '<link rel="canonical" href="http://mixed.org/1"><meta http-equiv=refresh content="1;url=http://a.net/es/">'),
]


def test_urls(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("node", F.lit(1)).withColumn("own", F.lit(2))
    rows = urls.judged(pages, RULES).collect()
    assert len(rows) == len(PAGES)
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert found[1] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert found[2] == ("www.example.com", "/en/2", "www.example.com/en/", "allow")
    assert found[3] == ("shop.example.net", "/es/3", "net/es/", "block")
    # 6 is explicitly allowed, so its aliases that no rule fits are not blocked, though 3 is
    assert [found[k][2:] for k in (4, 5, 6)] == [(None, "allow"), (None, "allow"), ("com/", "allow")]
    assert found[7] == found[8] == ("", "", None, "allow")
    assert found[9] == ("", "", None, "allow")
    assert found[10] == ("host", "", None, "allow")
    assert found[11][2:] == ("com/", "allow")
    assert found[12] == ("example.com", "", None, "allow")
    assert found[13][2:] == ("com/", "allow")
    assert found[14][2:] == (None, "block")
    assert found[15][3] == found[16][3] == "allow"
    without = [r for r in PAGES if r[0] != 6]
    rows = urls.judged(spark.createDataFrame(without, "page_id long, url string, html string"), RULES).collect()
    found = {r.page_id: r.verdict for r in rows}
    assert found[4] == found[5] == "block"  # aliases of 3, one over the other
    more = spark.createDataFrame([("http://alone.org/", "http://a.net/fr/x"), (None, "http://b.org")], "url string, target string")
    rows = urls.judged(pages, RULES, redirects=more).collect()
    assert {r.verdict for r in rows if r.page_id is None} == {"block"}
    assert urls.judged(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in urls.judged(pages, ()).collect()} == {"allow"}


# --- top-k -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [16384, 3])
def test_topk(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", block)
    rng = np.random.default_rng(3)
    vectors = rng.integers(-9, 9, (400, 6))
    vectors[50:80] = vectors[7]  # ties
    vectors[100] = 0
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(400, []), (401, [3]), (None, [1] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").withColumn("length", F.lit(1)).withColumn("q", F.lit(2))
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.best(df, F.col("vec_id") % 40 == 0, 5).collect()}
    full = np.vstack([vectors, np.zeros((1, 6), int), [[3, 0, 0, 0, 0, 0]]])
    expected = {}
    for q in range(0, 402, 40):
        scores = full @ full[q]
        order = sorted((k for k in range(402) if k != q), key=lambda k: (-scores[k], k))[:5]
        expected |= {(q, n): (k, int(scores[k])) for n, k in enumerate(order, 1)}
    assert found == expected
    assert topk.best(df.limit(0), F.lit(True), 5).count() == 0
    assert topk.best(df.filter("vec_id = 40"), F.lit(True), 5).count() == 0


# --- pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline_on_awkward_rows(spark):
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        assert stage(spark, empty(spark), SMALL).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty(spark), SMALL).count() == 0


def test_pipeline(spark):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    found = corpus_pipeline.run(spark, SMALL)
    assert found.count() > 0
    ids = {r[0] for r in found.select("doc_id").distinct().collect()}
    assert ids <= {r[0] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect()}


def test_pipeline_takes_out_copies_and_benchmark(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").filter("length(text) > 150").first().text
    clean = [(k, " ".join(f"{w}x" for w in prose(60, 40 + k).split()), "en", "a", 1) for k in range(3)]
    rows = [*clean, (10, clean[0][1], "en", "a", 1), (11, f"{prose(30, 9)} {item}", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = corpus_pipeline.without_near_duplicates(spark, docs, SMALL)
    assert sorted(r.doc_id for r in docs.collect()) == [0, 1, 2, 11]
    docs = corpus_pipeline.without_benchmark(spark, docs, SMALL)
    assert sorted(r.doc_id for r in docs.collect()) == [0, 1, 2]


def test_pipeline_keeps_different_texts_under_one_id(spark):
    base = prose(80, 21)
    near = base.replace(base.split()[40], "other", 1)
    rows = [(7, base), (7, prose(80, 22)), (7, prose(80, 22)), (3, near), (9, prose(80, 23)), (None, base), (11, None), (12, ""), (12, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as component_id", "'x' as lang")
    found = corpus_pipeline.without_near_duplicates(spark, docs, SMALL)
    # brute force over the different rows: each linked group keeps its smallest id
    different = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], r[1] or ""))
    groups = brute_components([(k, t) for k, (_, t) in enumerate(different)], 5, 80)
    kept = Counter(different[k] for k in {component for _, component in groups.values()})
    assert Counter((r.doc_id, r.text) for r in found.collect()) == kept + Counter([(None, base)])
    assert (3, near) in kept and (7, base) not in kept and len(kept) == 5
    assert found.columns == docs.columns


@pytest.mark.parametrize("slots", [repeats.SLOTS, (5, 5)])
def test_pipeline_shuffles_only_texts_that_go_or_repeat(spark, monkeypatch, slots):
    monkeypatch.setattr(repeats, "SLOTS", slots)  # at five, the bit map lets nearly all through
    rows = [(k, prose(40, 300 + k)) for k in range(40)]
    rows += [rows[4], rows[4], (90, rows[7][1]), (-1, rows[8][1] + " end"), (None, rows[9][1]), (60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = corpus_pipeline.without_near_duplicates(spark, docs, SMALL)
    groups = brute_components(rows, 5, 80)
    kept = [r for r in set(rows) if r[0] is None or groups[r[0]][1] == r[0]]
    assert Counter(map(tuple, found.collect())) == Counter(kept) and len(kept) == 43
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert plan[0].startswith("Union") and "Join" not in "".join(plan[: next(k for k, x in enumerate(plan) if "Relation" in x or "RDD" in x)])


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    pairs = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    groups = brute_components(pairs, 5, 80)
    found = corpus_pipeline.without_near_duplicates(spark, docs, SMALL)
    assert sorted(r.doc_id for r in found.collect()) == sorted({component for _, component in groups.values()})
    masked = {r.doc_id: r.text for r in corpus_pipeline.without_private_data(spark, docs, SMALL).collect()}
    for doc_id, text in pairs:
        mails = re.findall(r"(?:[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", text)
        assert all(m not in masked[doc_id] for m in mails) and (mails or masked[doc_id].count("[EMAIL]") == text.count("[EMAIL]"))


def test_every_link_of_a_page_counts_also_relative_ones(spark, tmp_path):
    tag = '<link rel="canonical" href="{}">'
    blocked = "http://shop.net/es/"  # by rule
    html = [
        ("http://a.org/x/p", tag.format("http://z.org/1") + tag.format(blocked + "a")),  # the second tag
        ("http://a.org/x/q", "<meta http-equiv='refresh' content='0; url=http://z.org/2'><meta http-equiv=refresh content='0;url=" + blocked + "b'>"),
        ("http://a.org/x/r", tag.format("../es/one?id=1#top")),
        ("http://a.org/x/s", tag.format("t")),
        ("http://a.org/x/t", tag.format("./../x/./u/")),
        ("http://a.org/x/u", tag.format("?id=3")),
        ("http://a.org/x/u?id=3", tag.format("//shop.net/fr/c")),
        ("http://shop.net/en/v", tag.format("../../../es/d")),
        ("http://a.org", tag.format("w")),
        ("http://a.org/w", '<meta property="og:url" content="/y/../z"><meta property="og:url" content="http://net/fr/e">'),
        ("http://a.org/z", tag.format("mailto:x@y.z") + tag.format("#part") + tag.format("javascript:void(0)")),
        ("no address", tag.format("x/y")), (None, tag.format("x")), ("http://a.org/clean", None),
    ]
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(html)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    found = sorted(map(tuple, QUERIES["op1_urls"](spark, str(tmp_path)).collect()), key=str)
    con = connect(SMALL)
    con.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(con.execute(ORACLES["op1_urls"]).fetchall(), key=str) == found
    verdicts = {html[p][0]: v for p, _, _, _, v in found}
    for url in ("x/p", "x/q", "x/s", "x/t", "x/u", "x/u?id=3", "w", "z"):
        assert verdicts[f"http://a.org/{url}"] == "block", url
    assert verdicts["http://a.org"] == verdicts["http://shop.net/en/v"] == "block"
    assert verdicts["http://a.org/x/r"] == verdicts["http://a.org/clean"] == verdicts["no address"] == verdicts[None] == "allow"
    assert len(found) == len(html)
