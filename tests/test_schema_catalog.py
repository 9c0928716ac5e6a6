import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.operators import catalog, schema
from tidegate.operators.catalog import COLUMNS_DDL
from tidegate.plans import catalog_sync, gated_load
from tidegate.sources import catalog_views as views


def columns(spark, *rows):
    """rows: table, name, data type, type text, length, nullable."""
    counted, out = {}, []
    for table, name, kind, text, length, nullable in rows:
        counted[table] = counted.get(table, 0) + 1
        out.append(("d", "s", table, name, counted[table], kind, text, None, nullable, length, None, None, ""))
    return spark.createDataFrame(out, COLUMNS_DDL)


def keys(spark, **tables):
    return spark.createDataFrame(list(tables.items()), "table_name string, column_names array<string>")


def users(spark):
    return columns(
        spark, ("users", "id", "int", "int(11)", None, False), ("users", "name", "varchar", "varchar(100)", 100, True)
    )


def old_users(spark):
    return columns(
        spark, ("users", "id", "int", "INT", None, True), ("users", "name", "varchar", "VARCHAR(50)", 50, True),
        ("users", "old_col", "int", "INT", None, True),
    )


def actions(df):
    return sorted((r.action, r.column_name, tuple(r.key or ()), bool(r.warning)) for r in df.collect())


def test_plan(spark):
    none = spark.createDataFrame([], COLUMNS_DDL)
    pk = keys(spark, users=["id", "name"])
    assert actions(schema.plan(users(spark), none, pk)) == [("create", None, ("id", "name"), False)]
    assert actions(schema.plan(users(spark), none, keys(spark, other=["x"]))) == [("create", None, ("id",), True)]
    assert actions(schema.plan(users(spark), none, pk, auto_create=False)) == [("none", None, (), True)]
    assert actions(schema.plan(users(spark), old_users(spark), pk)) == [
        ("drop", "old_col", (), False), ("modify", "id", (), False), ("modify", "name", (), False),
    ]
    kept = schema.plan(users(spark), old_users(spark), pk, drop_columns=False)
    assert ("none", "old_col", (), True) in actions(kept)


def test_modes_disagree_on_nullability_and_booleans(spark):
    source = columns(spark, ("t", "f", "tinyint", "tinyint(1)", None, False))
    target = columns(spark, ("t", "f", "boolean", "BOOLEAN", None, True))
    levels = lambda mode: sorted((r.level, r.change) for r in schema.diff(source, target, mode=mode).collect())
    assert levels("check") == [("warning", "nullable_different")]
    assert levels("sync") == [("difference", "nullable_different")]
    assert levels("normalised") == [("difference", "type_mismatch"), ("warning", "nullable_different")]
    with pytest.raises(ValueError):
        schema.diff(source, target, mode="other")


def test_conform_reaches_the_planned_structure(spark):
    target = T.StructType(
        [T.StructField("id", T.LongType(), False), T.StructField("n", T.IntegerType()),
         T.StructField("since", T.TimestampType()), T.StructField("flag", T.IntegerType())]
    )
    df = spark.createDataFrame([(1, "5", "x"), (2, "many", "y"), (None, None, "z")], "id int, n string, gone string")
    shaped = schema.conform(df, target, {"since": ("now", None), "flag": ("number", "1")})
    good, bad = schema.accepted(shaped), schema.rejected(shaped)
    assert [f.dataType for f in good.schema] == [f.dataType for f in target]
    assert [(r.id, r.n, r.flag) for r in good.collect()] == [(1, 5, 1)]
    assert sorted(r.reject_reason for r in bad.collect()) == ["id: required", "n: cannot be cast"]


def test_signature_follows_order_and_type(spark):
    one = schema.signature(users(spark), "canal").first()
    assert one.column_count == 2
    turned = users(spark).withColumn("ordinal_position", 3 - F.col("ordinal_position"))
    assert schema.signature(turned, "canal").first().signature != one.signature
    assert schema.signature(users(spark), "canal").first().signature == one.signature


def test_gated_load(spark, tmp_path):
    data = spark.createDataFrame([(1, "a")], "id int, name string")
    out = str(tmp_path / "out")
    blocked = gated_load.run(data, out, "users", users(spark), old_users(spark))
    assert not blocked.executed and not blocked.consistent
    with pytest.raises(AnalysisException):
        spark.read.parquet(out)
    same = columns(
        spark, ("users", "id", "int", "INT", None, False), ("users", "name", "varchar", "VARCHAR(100)", 100, True)
    )
    assert gated_load.run(data, out, "users", users(spark), same, preview=True).reason == "preview"
    for _ in range(2):
        assert gated_load.run(data, out, "users", users(spark), same).executed
    assert spark.read.parquet(out).count() == 1
    assert gated_load.run(data, out, "users", users(spark), old_users(spark), force=True, truncate=False).executed
    assert spark.read.parquet(out).count() == 2
    # nothing known about the table: nothing was checked
    assert not gated_load.run(data, out, "unknown", users(spark), same).executed


def test_sync_is_idempotent_and_scoped(spark):
    other = users(spark).withColumn("schema_name", F.lit("untouched"))
    existing = users(spark).unionByName(other)
    snapshot = old_users(spark).where("name <> 'name'")
    merged = catalog.sync(existing, snapshot, catalog.COLUMN)
    counted = {r.change: r.rows for r in catalog.sync_stats(merged).collect()}
    assert counted == {"update": 1, "delete": 1, "insert": 1, "keep": 2}
    again = catalog.sync(catalog.after_sync(merged), snapshot, catalog.COLUMN)
    assert {r.change for r in again.select("change").collect()} == {"keep"}
    empty = snapshot.limit(0)
    with pytest.raises(ValueError):
        catalog.sync(existing, empty, catalog.COLUMN)
    assert catalog.after_sync(catalog.sync(existing, empty, catalog.COLUMN, allow_empty=True)).count() == 0


def catalog_tables(spark, names, with_index):
    tables = spark.createDataFrame([("d", "s", n, "TABLE", "") for n in names], catalog.TABLES_DDL)
    cols = columns(spark, *[(n, "id", "int", "int", None, False) for n in names])
    indexes = spark.createDataFrame(
        [("d", "s", n, "PRIMARY", True, True, ["id"], "") for n in names if with_index], catalog.INDEXES_DDL
    )
    constraints = spark.createDataFrame([], catalog.CONSTRAINTS_DDL)
    return {"tables": tables, "columns": cols, "indexes": indexes, "constraints": constraints}


def test_catalog_job_drops_the_last_index(spark, tmp_path):
    merged, stats = catalog_sync.run(catalog_tables(spark, ["a", "b"], True), catalog_tables(spark, ["a"], False))
    assert merged["tables"].count() == 1 and merged["indexes"].count() == 0
    assert {r.change: r.rows for r in stats["tables"].collect()} == {"keep": 1, "delete": 1}
    sheets = catalog_sync.export(**merged, folder=str(tmp_path))
    assert sheets == ["columns", "constraints", "indexes", "tables"]
    assert spark.read.option("header", True).csv(f"{tmp_path}/tables").first().column_count == "1"


def test_pages(spark):
    found = users(spark).unionByName(old_users(spark).withColumn("table_name", F.lit("v")))
    first = catalog.page(found, 2).collect()
    last = tuple(first[-1][c] for c in catalog.PAGE_ORDER)
    assert [tuple(r) for r in catalog.page(found, 2, after=last).collect()] == [
        tuple(r) for r in catalog.page(found, "2", "2").collect()
    ]
    assert catalog.page(found, 5000).count() == 5
    for wrong in ((0, 0), (1, -3), ("x", 0)):
        with pytest.raises(ValueError):
            catalog.page(found, *wrong)


def test_vendor_views(spark):
    mysql = spark.createDataFrame(
        [("shop", "t", "id", 1, "int", "int(11)", None, "NO", None, 10, 0, ""),
         ("sys", "x", "id", 1, "int", "int(11)", None, "NO", None, 10, 0, "")],
        "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, "
        "column_type string, column_default string, is_nullable string, character_maximum_length bigint, "
        "numeric_precision int, numeric_scale int, column_comment string",
    )
    shaped = views.information_schema_columns(mysql, "db", "mysql")
    assert [(r.schema_name, r.is_nullable) for r in shaped.collect()] == [("shop", False)]
    assert shaped.dtypes == spark.createDataFrame([], COLUMNS_DDL).dtypes

    oracle = spark.createDataFrame(
        [("T", "B", 7, "VARCHAR2", 30, None, None, "Y", None), ("T", "A", 3, "NUMBER", 22, 9, 2, "N", "0")],
        "table_name string, column_name string, column_id int, data_type string, data_length int, "
        "data_precision int, data_scale int, nullable string, data_default string",
    )
    notes = spark.createDataFrame([("T", "A", "amount")], "table_name string, column_name string, comments string")
    rows = views.oracle_columns(oracle, notes, "db", "ME").orderBy("ordinal_position").collect()
    assert [(r.name, r.ordinal_position, r.max_length, r.numeric_precision, r.comment) for r in rows] == [
        ("A", 1, None, 9, "amount"), ("B", 2, 30, None, ""),
    ]
    listed = views.oracle_tables(
        spark.createDataFrame([("T",)], "table_name string"), spark.createDataFrame([("V",)], "view_name string"),
        spark.createDataFrame([("T", "note")], "table_name string, comments string"), "db", "ME",
    )
    assert sorted((r.table_name, r.table_type, r.comment) for r in listed.collect()) == [("T", "TABLE", "note"), ("V", "VIEW", "")]

    click = spark.createDataFrame(
        [("shop", "t", "a", "Decimal(9, 2)", "", 1), ("system", "t", "a", "Int8", "", 1)],
        "database string, table string, name string, type string, comment string, position int",
    )
    assert [(r.database, r.data_type, r.numeric_precision) for r in views.clickhouse_columns(click).collect()] == [("shop", "decimal", 9)]

    odps = spark.createDataFrame(
        [("t", "dt", "STRING", "day", 1, True), ("t", "a", "VARCHAR(9)", None, 1, False)],
        "table_name string, name string, type string, comment string, position int, is_partition boolean",
    )
    assert sorted((r.ordinal_position, r.name, r.comment) for r in views.odps_columns(odps, "p").collect()) == [
        (1, "a", ""), (2, "dt", "partition column: day"),
    ]


def test_foreign_keys_in_both_layouts(spark):
    place = "table_schema string, table_name string, constraint_name string"
    cons = spark.createDataFrame(
        [("s", "t", "pk", "PRIMARY KEY"), ("s", "t", "fk", "FOREIGN KEY")], place + ", constraint_type string"
    )
    mysql = spark.createDataFrame(
        [("s", "t", "pk", "id", 1, None, None), ("s", "t", "fk", "b", 2, "r", "y"), ("s", "t", "fk", "a", 1, "r", "x")],
        place + ", column_name string, ordinal_position int, referenced_table_name string, referenced_column_name string",
    )
    shown = lambda df: sorted((r.name, r.column_names, r.referenced_table, r.referenced_column) for r in df.collect())
    expected = [("fk", ["a", "b"], "r", "x"), ("pk", ["id"], "", "")]
    assert shown(views.information_schema_constraints(cons, mysql, "db", "mysql")) == expected
    usage = mysql.drop("referenced_table_name", "referenced_column_name")
    referenced = spark.createDataFrame(
        [("s", "pk", "t", "id"), ("s", "fk", "r", "x"), ("s", "fk", "r", "y")],
        "constraint_schema string, constraint_name string, table_name string, column_name string",
    )
    assert shown(views.information_schema_constraints(cons, usage, "db", "postgresql", referenced)) == expected


def test_postgresql_comments_and_indexes(spark):
    from tidegate.sources import catalog_views as views

    make = spark.createDataFrame
    namespaces = make([(1, "shop"), (2, "pg_catalog")], "oid long, nspname string")
    classes = make(
        [(10, "t", 1), (11, "t_pk", 1), (12, "t_ab", 1), (20, "sys", 2)], "oid long, relname string, relnamespace long"
    )
    attributes = make(
        [(10, 1, "id"), (10, 2, "a"), (10, 3, "b"), (20, 1, "x")], "attrelid long, attnum int, attname string"
    )
    index = make(
        [(11, 10, True, True, "1"), (12, 10, False, False, "3 0 2")],
        "indexrelid long, indrelid long, indisunique boolean, indisprimary boolean, indkey string",
    )
    found = views.postgresql_indexes(index, classes, namespaces, attributes, "d")
    assert {r.name: (r.schema_name, r.table_name, r.is_primary, r.column_names) for r in found.collect()} == {
        "t_pk": ("shop", "t", True, ["id"]), "t_ab": ("shop", "t", False, ["b", "a"]),
    }
    texts = make([("shop", "t", "t_pk", "CREATE")], "schemaname string, tablename string, indexname string, indexdef string")
    found = views.postgresql_indexes(index, classes, namespaces, attributes, "d", texts)
    assert {r.name: r.definition for r in found.collect()} == {"t_pk": "CREATE", "t_ab": ""}
    descriptions = make(
        [(10, 1259, 0, "a table"), (10, 1259, 2, "a column"), (10, 7, 0, "no relation"), (20, 1259, 0, "system")],
        "objoid long, classoid long, objsubid int, description string",
    )
    of_tables, of_columns = views.postgresql_comments(descriptions, classes, namespaces, attributes, "d")
    assert [tuple(r) for r in of_tables.collect()] == [("d", "shop", "t", "a table")]
    assert [tuple(r) for r in of_columns.collect()] == [("d", "shop", "t", "a", "a column")]
    columns = make([("d", "shop", "t", n, "") for n in ("id", "a")], "database string, schema_name string, table_name string, name string, comment string")
    shown = catalog.with_comments(columns, of_columns, (*catalog.TABLE, "name"))
    assert {r.name: r.comment for r in shown.collect()} == {"id": "", "a": "a column"}
