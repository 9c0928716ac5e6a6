import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks import inputs
from tidegate.operators import lineage
from tidegate.operators import requests as rq
from tidegate.plans import lineage_job
from tidegate.session import scratch_path, shared_dir
from tidegate.sources import jdbc, tables


def found(spark, sql, extended=False):
    corpus = spark.createDataFrame([("f.sql", sql)], "path string, sql string")
    rows = lineage.extract(corpus, extended).orderBy("statement", "source_position").collect()
    return [(r.source_table, r.target_table) for r in rows]


@pytest.mark.parametrize(
    ("sql", "edges"),
    [
        ("INSERT INTO dwd.t1 SELECT a.id FROM ods.a JOIN dim.b ON a.bid = b.id WHERE a.dt='x';"
         "CREATE TABLE dws.t2 AS SELECT * FROM ods.c;",
         [("ods.a", "dwd.t1"), ("dim.b", "dwd.t1"), ("ods.c", "dws.t2")]),
        ("SELECT * FROM ods.a LIMIT 10;", []),
        ("INSERT INTO dwd.x SELECT id FROM ods.y;", [("ods.y", "dwd.x")]),
        ("insert ignore into `d`.`t` select 1 from DUAL join \"s\".\"u\" on 1=1", [("s.u", "d.t")]),
        ("INSERT INTO t SELECT ';' FROM a -- ; note\n JOIN b", [("a", "t"), ("b", "t")]),
        ("INSERT INTO t SELECT 'it\\'s; x' FROM a", [("a", "t")]),
        (None, []),
    ],
)
def test_lineage(spark, sql, edges):
    assert found(spark, sql) == edges


@pytest.mark.parametrize("extended", [False, True])
def test_lineage_searches_a_statement_once(spark, extended):
    corpus = spark.createDataFrame([("a.sql", "INSERT INTO t SELECT 1 FROM a; SELECT 1 FROM b")], "path string, sql string")
    plan = lineage.extract(corpus, extended)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("INSERT") == 1 and plan.count("CREATE") == 1
    assert plan.count("regexp_extract_all") == 1 + extended  # names of common table expressions


def test_the_texts_of_a_small_file_are_made_on_several_tasks(spark):
    made = inputs.corpus(spark, "/root/testdata/sf0.001")
    assert "RepartitionByExpression" in made._jdf.queryExecution().optimizedPlan().toString()


def test_lineage_of_a_very_long_statement(spark):
    values = ",".join(f"('v;{n}')" for n in range(60_000))
    assert found(spark, f"INSERT INTO big VALUES {values}; INSERT INTO t SELECT 1 FROM a") == [("a", "t")]


def test_extended_lineage(spark):
    sql = "WITH c AS (SELECT * FROM a) INSERT OVERWRITE TABLE t SELECT * FROM c JOIN b /* FROM hidden */"
    assert found(spark, sql) == []
    assert found(spark, sql, extended=True) == [("a", "t"), ("b", "t")]


def test_lineage_job_adds_edges_once(spark, tmp_path):
    folder = tmp_path / "sql" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.sql").write_text("INSERT INTO x SELECT 1 FROM y;\nINSERT INTO x SELECT 2 FROM y;")
    (folder / "b.HQL").write_text("CREATE TABLE z AS SELECT * FROM x")
    (folder / "c.txt").write_text("INSERT INTO no SELECT 1 FROM no")
    for _ in range(2):
        stored = lineage_job.run(spark, str(tmp_path / "sql"), str(tmp_path / "edges"))
        assert sorted(tuple(r) for r in stored.collect()) == [("x", "z", "deep/b.HQL"), ("y", "x", "deep/a.sql")]
    assert sorted(r[0] for r in lineage.nodes(stored).collect()) == ["x", "y", "z"]


def requests(spark, rows):
    ddl = "event_id bigint, method string, path string, status_code int, duration_ms int, username string, created_at timestamp"
    return spark.createDataFrame([(n, "GET", p, s, 1, "u", t) for n, (p, s, t) in enumerate(rows)], ddl)


def test_requests(spark):
    at = lambda day, hour: dt.datetime(2024, 5, day, hour)
    log = requests(spark, [
        ("/api/x.js", 500, at(1, 15)), ("/static/a", 200, at(1, 16)), ("/a.png", 200, at(1, 1)),
        ("/page", None, at(1, 16)), ("/admin/x.css", 404, at(2, 1)), ("/favicon.ico", 200, at(2, 1)),
    ])
    kept = rq.ingest(log)
    assert sorted(r.path for r in kept.collect()) == ["/admin/x.css", "/api/x.js", "/page"]
    total = rq.totals(kept).first()
    assert (total.total, total.errors, total.error_rate, total.success_rate) == (3, 2, 66.67, 33.33)
    assert tuple(rq.totals(kept.limit(0)).first()) == (0, 0, 0.0, 0.0)
    # 16:00 UTC is the next day in Shanghai
    assert sorted((str(r.day), r["count"]) for r in rq.by_day(kept).collect()) == [("2024-05-01", 1), ("2024-05-02", 2)]
    now = dt.datetime(2024, 5, 2, 16)
    assert rq.window(kept, now, 1).count() == 2 and rq.window(kept, now, 1000).count() == 3
    for wrong in (0, "x"):
        with pytest.raises(ValueError):
            rq.window(kept, now, wrong)


def test_top_paths_break_ties_by_name(spark):
    log = requests(spark, [(f"/p{n:02}", 200, dt.datetime(2024, 5, 1)) for n in range(20)])
    assert [r.path for r in rq.top_paths(log).collect()] == [f"/p{n:02}" for n in range(12)]


def test_day_partitions(spark, tmp_path):
    path = str(tmp_path / "ods")
    days = spark.range(300).select("id", F.concat(F.lit("2024-01-0"), (F.col("id") % 3 + 1)).alias("dt"))
    tables.write_days(days, path)
    tables.load_day(spark.createDataFrame([(1,)], "id bigint"), path, "2024-01-02")
    counted = {r.dt: r["count"] for r in tables.read_days(spark, path).groupBy("dt").count().collect()}
    assert counted == {"2024-01-01": 100, "2024-01-02": 1, "2024-01-03": 100}
    assert dict(tables.read_days(spark, path).dtypes)["dt"] == "string"
    tables.create_day_table(spark, "ods_days", days, path)
    spark.sql("MSCK REPAIR TABLE ods_days")
    assert tables.drop_old_days(spark, "ods_days", "2024-01-09") == ["2024-01-01"]
    assert spark.table("ods_days").count() == 101
    assert tables.read_days(spark, path).count() == 101  # the files are gone as well
    tables.load_day(spark.createDataFrame([], "id bigint"), path, "2024-01-03")
    assert tables.read_days(spark, path).count() == 1
    spark.sql("DROP TABLE ods_days")


def test_jdbc_options():
    plain = jdbc.options("gaussdb", "h", "db", "t", "u", "p", schema="s")
    assert plain["url"] == "jdbc:postgresql://h:5432/db" and plain["dbtable"] == "s.t"
    split = jdbc.options("mysql", "h", "db", "t", "u", "p", port=1, split_column="id", bounds=(1, 9))
    assert (split["numPartitions"], split["lowerBound"], split["upperBound"]) == ("3", "1", "9")
    with pytest.raises(ValueError):
        jdbc.options("mysql", "h", "db", "t; drop", "u", "p")
    with pytest.raises(ValueError):
        jdbc.url("kafka", "h", "db")


def test_scratch_tables_live_in_the_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(shared_dir(spark)) and scratch_path(spark, "x") != scratch_path(spark, "x")


@pytest.mark.parametrize(
    ("sql", "sources"),
    [
        ("INSERT INTO t SELECT * FROM a, b c, (SELECT * FROM d, e) f, g", ["a", "b", "d", "e", "g"]),
        ("INSERT INTO t SELECT * FROM a WHERE x IN (SELECT y FROM b WHERE z = (SELECT max(q) FROM c)) AND EXISTS (SELECT 1 FROM d)", ["a", "b", "c", "d"]),
        ("INSERT INTO t WITH w AS (SELECT * FROM a), v AS (SELECT * FROM w, b) SELECT * FROM v JOIN w ON true", ["a", "b"]),
        ("INSERT INTO t SELECT EXTRACT(day FROM ts), trim(BOTH FROM n) FROM a WHERE x IS NOT DISTINCT FROM y", ["a"]),
        ("INSERT INTO t SELECT 'FROM no', \"FROM col\" FROM a /* , b */ -- , c\n, d", ["a", "d"]),
        ("INSERT INTO t SELECT * FROM generate_series(1, 3) g, a", ["a"]),
        ("INSERT INTO t SELECT * FROM (a JOIN b USING (k, l)), c ON a.x = f(b.y, c.z), d", ["a", "b", "c", "d"]),
        ("INSERT INTO t SELECT * FROM a UNION SELECT * FROM b ORDER BY 1, 2", ["a", "b"]),
        ("CREATE OR REPLACE VIEW t AS (SELECT x FROM `s`.`a`, dual)", ["s.a"]),
        ("INSERT INTO t SELECT * FROM a))) , b", ["a", "b"]),
        ("INSERT INTO t VALUES (1, 2)", []),
    ],
)
def test_extended_lineage_reads_every_scope(spark, sql, sources):
    rows = spark.createDataFrame([("f.sql", sql)], "path string, sql string")
    found = lineage.extract(rows, extended=True).orderBy("source_position").collect()
    assert [r.source_table for r in found] == sources and {r.target_table for r in found} <= {"t"}
