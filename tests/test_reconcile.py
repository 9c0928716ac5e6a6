import pytest
from pyspark.sql import functions as F

from tidegate.operators import reconcile as rc
from tidegate.operators.catalog import COLUMNS_DDL
from tidegate.operators.reconcile import Pair
from tidegate.plans import reconcile_run
from tidegate.plans.reconcile_run import Task


def frame(spark, rows=None):
    rows = rows if rows is not None else [(n, f"v{n % 3}", n * 1.5) for n in range(50)]
    return spark.createDataFrame(rows, "id bigint, text string, amount double")


DEFECTS = {
    "missing": lambda df: df.where("id <> 7"),
    "extra": lambda df: df.unionByName(df.where("id = 7").withColumn("id", F.lit(99).cast("bigint"))),
    "repeated": lambda df: df.unionByName(df.where("id = 7")),
    "changed": lambda df: df.withColumn("text", F.when(F.col("id") == 7, "other").otherwise(F.col("text"))),
    "emptied": lambda df: df.withColumn("text", F.when(F.col("id") != 7, F.col("text"))),
}
FOUND_BY = {
    "missing": {"row_count", "pk_snapshot", "pk_digest", "field_value", "key_diff"},
    "extra": {"row_count", "pk_snapshot", "pk_digest", "field_value", "key_diff"},
    "repeated": {"row_count", "pk_snapshot", "pk_digest", "field_value", "key_diff"},
    "changed": {"field_value", "key_diff"},
    "emptied": {"field_value", "key_diff"},
}


def failing(source, target):
    pair = [Pair("t", source, target)]
    checks = {
        "row_count": rc.row_count(pair),
        "pk_snapshot": rc.pk_snapshot(pair, ["id"]),
        "pk_digest": rc.pk_digest(pair, ["id"]),
        "field_value": rc.field_value(pair, ["id", "text", "amount"]),
    }
    found = {name for name, df in checks.items() if df.where("status <> 'ok'").count()}
    if rc.key_diff(source, target, ["id"], ["text", "amount"]).count():
        found.add("key_diff")
    return found


def test_equal_tables_are_ok(spark):
    assert failing(frame(spark), frame(spark).repartition(5)) == set()
    empty = frame(spark, [])
    assert failing(empty, empty) == set()


@pytest.mark.parametrize("defect", sorted(DEFECTS))
def test_every_defect_is_found(spark, defect):
    assert failing(frame(spark), DEFECTS[defect](frame(spark))) == FOUND_BY[defect]


def test_key_diff_names_the_keys(spark):
    target = DEFECTS["changed"](DEFECTS["extra"](frame(spark))).where("id <> 3")
    found = rc.key_diff(frame(spark), target, ["id"], ["text", "amount"], buckets=4)
    assert sorted((r.id, r.change) for r in found.collect()) == [
        (3, "missing_in_target"), (7, "changed"), (99, "extra_in_target"),
    ]


def test_key_diff_with_one_hot_key(spark):
    hot = frame(spark, [(1, "same", 1.0)] * 3000 + [(n, "x", 2.0) for n in range(2, 20)])
    assert rc.key_diff(hot, hot, ["id"], ["text", "amount"]).count() == 0
    fewer = hot.limit(2999)
    found = rc.key_diff(frame(spark, [(1, "same", 1.0)] * 3000), frame(spark, [(1, "same", 1.0)] * 2999), ["id"], ["text"])
    assert [tuple(r) for r in found.collect()] == [(1, "changed", 3000, 2999)]
    assert fewer.count() == 2999


def test_snapshot_finds_different_keys_of_equal_number(spark):
    other = frame(spark).withColumn("id", F.col("id") + 1000)
    found = rc.pk_snapshot([Pair("t", frame(spark), other), Pair("u", other, other.orderBy(F.desc("id")))], ["id"])
    assert {r.table: r.status for r in found.collect()} == {"t": "mismatch", "u": "ok"}
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_profiles_treat_zeroes_and_nothing_alike(spark):
    rows = [(1, None, 0.0), (2, None, -0.0)]
    profile = {r.column: tuple(r)[1:] for r in rc.profile(frame(spark, rows), ["text", "amount"]).collect()}
    assert profile["amount"][:2] == ("2", "1")
    out = rc.field_value([Pair("t", frame(spark, rows), None)], ["text"]).first()
    assert (out.source_values, out.target_values, out.status) == ("0|0|None|None", None, "target_missing")


def opener(**tables):
    def open_table(name):
        if name not in tables:
            raise LookupError(f"{name} is missing")
        return tables[name]

    return open_table


def test_task_validation():
    for task in (
        Task("a", "pk_snapshot", ("t",)), Task("a", "metric", ("t",)),
        Task("a", "unknown", ("t",)),
    ):
        with pytest.raises(ValueError):
            reconcile_run.validate(task)


def test_run_is_recorded_and_goes_on_past_missing_tables(spark, tmp_path):
    source = opener(a=frame(spark), b=frame(spark), c=frame(spark))
    target = opener(a=frame(spark), b=DEFECTS["missing"](frame(spark)))
    task = Task("counts", "row_count", ("a", "b", "c", "d"))
    run = reconcile_run.record(spark, task, source, target, str(tmp_path))
    assert run["status"] == "success"
    totals = run["totals"]
    assert (totals["total"], totals["ok"], totals["mismatch"]) == (4, 1, 3)
    assert (totals["different"], totals["missing"], totals["errors"]) == (1, 1, 1)
    assert reconcile_run.exit_code(run) == 1
    reconcile_run.record(spark, Task("counts", "row_count", ("a",)), source, target, str(tmp_path))
    runs = spark.read.parquet(f"{tmp_path}/runs")
    assert runs.count() == 2 and rc.recent_runs(runs, 1).first().total == 1


def test_skipped_and_metric(spark):
    source = target = opener(t=frame(spark))
    skipped = reconcile_run.details(spark, Task("p", "field_value", ("t",)), source, target)
    assert [r.status for r in skipped.collect()] == ["skipped"]
    sql = "SELECT count(*) AS n, max(text) AS m FROM {schema}.`{table}`"
    row = reconcile_run.details(spark, Task("m", "metric", ("t",), metric_sql=sql), source, target).first()
    assert (row.source_values, row.status) == ("50|v2", "ok")
    none = rc.metric([Pair("t", frame(spark), frame(spark))], "SELECT id FROM {table} WHERE id < 0").first()
    assert none.status == "ok"
    with pytest.raises(ValueError):
        rc.metric([Pair("t; drop", frame(spark), frame(spark))], sql)


def test_a_task_without_tables_takes_the_catalog(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reconcile_run, "GROUP", 1)
    names = spark.createDataFrame([("a",), ("a",), ("b",)], "table_name string")
    source, target = opener(a=frame(spark), b=frame(spark), columns=names), opener(a=frame(spark))
    run = reconcile_run.record(spark, Task("all", "row_count"), source, target, str(tmp_path))
    assert (run["total"], run["ok"], run["totals"]["missing"]) == (2, 1, 1)


def test_metadata_keeps_absent_tables(spark):
    rows_ = [("d", "s", "t", n, i + 1, "int", "int(11)", None, True, None, 10, 0, "") for i, n in enumerate("ab")]
    columns = spark.createDataFrame(rows_, COLUMNS_DDL)
    task = Task("m", "metadata", ("t", "nowhere"))
    found = reconcile_run.details(spark, task, opener(columns=columns), opener(columns=columns.limit(0)))
    assert {r.table: r.status for r in found.collect()} == {"t": "target_missing", "nowhere": "source_error"}
    found = reconcile_run.details(spark, task, opener(), opener(columns=columns))
    assert {r.status for r in found.collect()} == {"source_error"}


def test_a_table_that_breaks_while_it_is_read_costs_no_other_its_finding(spark, tmp_path):
    broken = frame(spark).where(F.raise_error(F.lit("lost block")).isNull())
    tables = {n: frame(spark) for n in "abcdefg"}
    task = Task("counts", "row_count", tuple("abcdefg"))
    run = reconcile_run.record(spark, task, opener(**tables | {"c": broken}), opener(**tables | {"f": broken}), str(tmp_path))
    found = spark.read.option("mergeSchema", "true").parquet(f"{tmp_path}/details")
    assert {r.table: r.status for r in found.collect()} == {n: "ok" for n in "abdeg"} | {"c": "source_error", "f": "target_missing"}
    assert "lost block" in found.where("table = 'c'").first().message
    assert run["status"] == "success" and (run["total"], run["ok"]) == (7, 5)
    # without a history too, and with a check whose keys do not exist on one side
    assert reconcile_run.record(spark, task, opener(**tables | {"c": broken}), opener(**tables))["totals"]["errors"] == 1
    keyed = Task("keys", "pk_snapshot", ("a", "b"), keys=("id",))
    run = reconcile_run.record(spark, keyed, opener(a=frame(spark), b=frame(spark).drop("id")), opener(a=frame(spark), b=frame(spark)))
    assert (run["totals"]["ok"], run["totals"]["errors"]) == (1, 1)


def test_tables_of_one_name_in_two_schemas_are_told_apart(spark):
    rows_ = [("d", s, t, n, i + 1, "int", "int(11)", None, True, None, 10, 0, "") for s, t, names in (("p", "t", "ab"), ("q", "t", "abc"), ("q", "u", "a")) for i, n in enumerate(names)]
    columns = spark.createDataFrame(rows_, COLUMNS_DDL)
    task = reconcile_run.resolved(Task("m", "metadata"), opener(columns=columns))
    assert task.tables == ("p.t", "q.t", "u")
    lesser = columns.where("not (schema_name = 'q' and name = 'c')")
    found = reconcile_run.details(spark, Task("m", "metadata", ("p.t", "q.t", "d.q.u", "x.t")), opener(columns=columns), opener(columns=lesser))
    assert {r.table: (r.source_columns, r.to_add) for r in found.collect()} == {"p.t": (2, 0), "q.t": (3, 1), "d.q.u": (1, 0), "x.t": (None, None)}


@pytest.mark.parametrize("depth", [0, 1, 7, 13])
def test_trees_of_digests_find_every_difference(spark, depth):
    source = spark.range(3000).selectExpr("id", "id % 7 as text", "1.5 as amount")
    target = source.where("id % 500 <> 3").withColumn("text", F.when(F.col("id") % 11 == 0, -1).otherwise(F.col("text")))
    target = target.union(spark.range(9000, 9003).selectExpr("id", "0L", "1.5"))
    found = rc.key_diff_deep(source, target, ["id"], ["text", "amount"], depth)
    expected = rc.key_diff(source, target, ["id"], ["text", "amount"])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect())) and expected.count() > 200
    trees = [rc.key_digests(df, ["id"], ["text", "amount"], depth) for df in (source, source.where("id <> 5"))]
    assert rc.differing_leaves(trees[0], trees[0], depth).count() == 0
    assert rc.differing_leaves(*trees, depth).count() == 1
    one = rc.key_digests(source, ["id"], ["text"], 0).first()
    assert tuple(rc.coarser(rc.key_digests(source, ["id"], ["text"], depth), depth).first()) == tuple(one)
    assert rc.depth_for(0) == rc.depth_for(1024) == 0 and rc.depth_for(1025) == 1 and rc.depth_for(10**9) == 20


def test_sketches_screen_and_values_decide(spark):
    source = spark.range(5000).selectExpr("id", "id % 10 as few", "cast(null as string) as none", "id as moved")
    target = source.withColumn("moved", F.col("moved") + 9_000_000).withColumn("few", F.when(F.col("few") == 3, 33).otherwise(F.col("few")))
    found = {r["column"]: (r.status, r.proved_by) for r in rc.distinct_values(source, target, source.columns).collect()}
    assert found["id"] == ("ok", "values") and found["none"] == ("ok", "values")
    assert found["few"][0] == found["moved"][0] == "mismatch"
    # however the values are dealt and ordered, equal sets have equal estimates
    for n in (5, 300, 5000, 60_000):
        rows_ = spark.range(n)
        parts = rc.distinct_sketches(rows_.where(f"id < {n // 3}"), ["id"]).union(rc.distinct_sketches(rows_.where(f"id >= {n // 4}"), ["id"]))
        shuffled = rows_.repartition(13).sortWithinPartitions(F.desc("id"))
        every = [rc.merged_sketches(s) for s in (parts, rc.distinct_sketches(rows_, ["id"]), rc.distinct_sketches(shuffled, ["id"]))]
        assert len({s.select(F.hll_sketch_estimate("sketch")).first()[0] for s in every}) == 1
        assert rc.distinct_values(rows_, shuffled, ["id"], source_sketches=parts).first().status == "ok"


def test_sketches_of_one_task_do_not_depend_on_the_order_of_its_values(spark):
    for n in (300, 400, 2000, 20_000, 60_000):
        up = spark.range(n).coalesce(1)
        for down in (up.sortWithinPartitions(F.desc("id")), up.unionByName(up).coalesce(1).sortWithinPartitions(F.xxhash64("id"))):
            assert tuple(rc.distinct_values(up, down, ["id"]).first())[:2] == ("id", "ok"), n
        halves = rc.distinct_sketches(up.where("id % 2 = 0"), ["id"]).union(rc.distinct_sketches(up.where("id % 2 <> 0"), ["id"]))
        assert rc.distinct_values(up, up, ["id"], source_sketches=halves).first().status == "ok", n
