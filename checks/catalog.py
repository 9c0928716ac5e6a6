"""Catalog, dictionary and lineage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as i
from checks.registry import query
from tidegate.operators import catalog, lineage
from tidegate.session import scratch_path
from tidegate.sources import catalog_views as views
from tidegate.sources import corpus

KEYS = "database, schema_name, table_name"
COLS = "WITH " + i.columns_sql()


def index_parts(spark, sf):
    """Two index parts per even ordinal: the column itself and the one before it."""
    columns = i.columns(spark, sf)
    name = F.when(F.col("ordinal_position") <= 3, "PRIMARY").otherwise(
        F.concat(F.lit("ix_"), F.pmod("ordinal_position", F.lit(2)))
    )
    parts = columns.select(
        *catalog.TABLE, name.alias("index_name"),
        F.when(name == "ix_1", 1).otherwise(0).alias("non_unique"),
        F.col("name").alias("column_name"),
        (100 - F.col("ordinal_position")).alias("seq_in_index"),
    )
    # a functional part has no column; a repeated column counts once
    blank = parts.withColumn("column_name", F.lit(None).cast("string"))
    again = parts.withColumn("seq_in_index", F.col("seq_in_index") + 100)
    return parts.unionByName(blank).unionByName(again)


INDEXES = COLS + """,
parts AS (
  SELECT database, schema_name, table_name, name AS column_name, 100 - ordinal_position AS seq,
    CASE WHEN ordinal_position <= 3 THEN 'PRIMARY' ELSE 'ix_' || (ordinal_position % 2) END AS name
  FROM cols),
idx AS (
  SELECT database, schema_name, table_name, name, name <> 'ix_1' AS is_unique, name = 'PRIMARY' AS is_primary,
    string_agg(column_name, ', ' ORDER BY seq) AS columns FROM parts GROUP BY ALL)
"""


def indexes(spark, sf):
    return catalog.group_indexes(index_parts(spark, sf))


@query("catalog_indexes", INDEXES + "SELECT * FROM idx")
def grouped_indexes(spark, sf):
    rows = indexes(spark, sf)
    return rows.select(*catalog.TABLE, "name", "is_unique", "is_primary", F.array_join("column_names", ", ").alias("columns"))


@query("catalog_index_keys", COLS + """
SELECT database, schema_name, table_name, 'ix_' || table_name AS name, true AS is_unique,
  string_agg(name, ', ' ORDER BY ordinal_position DESC) AS columns
FROM cols GROUP BY ALL""")
def index_keys(spark, sf):
    """Key numbers 16 to 1 of each table, written as their columns' names."""
    columns = i.columns(spark, sf)
    keyed = i.tables(spark, sf).select(
        *catalog.TABLE, F.concat(F.lit("ix_"), "table_name").alias("name"), F.lit(True).alias("is_unique"),
        F.sequence(F.lit(16), F.lit(1), F.lit(-1)).alias("index_keys"),
    )
    rows = catalog.expand_indexes(keyed, columns)
    return rows.withColumn("columns", F.array_join("column_names", ", ")).drop("column_names")


def constraints(spark, sf):
    columns = i.columns(spark, sf)
    tables = i.tables(spark, sf).select(*catalog.TABLE)
    kinds = F.array(
        F.struct(F.lit("pk").alias("constraint_name"), F.lit("PRIMARY KEY").alias("constraint_type")),
        F.struct(F.lit("fk").alias("constraint_name"), F.lit("FOREIGN KEY").alias("constraint_type")),
        F.struct(F.lit("ck").alias("constraint_name"), F.lit("CHECK").alias("constraint_type")),
    )
    declared = tables.select(*catalog.TABLE, F.inline(kinds))
    position = F.col("ordinal_position")
    usage = columns.select(
        *catalog.TABLE,
        F.when(position <= 2, "pk").otherwise("fk").alias("constraint_name"),
        F.col("name").alias("column_name"),
        (10 - position).alias("position"),
        # listed with every key, but only a foreign key refers to something
        F.when(position != 4, F.concat(F.lit("ref_"), "table_name")).alias("referenced_table"),
        F.when(position != 4, F.concat(F.lit("c"), position)).alias("referenced_column"),
    )
    return catalog.group_constraints(declared, usage)


CONSTRAINTS = COLS + """,
used AS (SELECT *, CASE WHEN ordinal_position <= 2 THEN 'pk' ELSE 'fk' END AS cname FROM cols),
grouped AS (SELECT database, schema_name, table_name, cname,
    string_agg(name, ', ' ORDER BY ordinal_position DESC) AS columns,
    coalesce(arg_min('ref_' || table_name, 10 - ordinal_position) FILTER (cname = 'fk' AND ordinal_position <> 4), '') AS rt,
    coalesce(arg_min('c' || ordinal_position, 10 - ordinal_position) FILTER (cname = 'fk' AND ordinal_position <> 4), '') AS rc
  FROM used GROUP BY ALL),
kinds AS (SELECT DISTINCT database, schema_name, table_name, unnest(['pk', 'fk', 'ck']) AS name FROM cols),
cons AS (
  SELECT k.database, k.schema_name, k.table_name, k.name,
    CASE k.name WHEN 'pk' THEN 'PRIMARY KEY' WHEN 'fk' THEN 'FOREIGN KEY' ELSE 'CHECK' END AS constraint_type,
    coalesce(columns, '') AS columns, coalesce(rt, '') AS referenced_table, coalesce(rc, '') AS referenced_column
  FROM kinds k LEFT JOIN grouped g ON k.database = g.database AND k.table_name = g.table_name AND k.name = g.cname)
"""


@query("catalog_constraints", CONSTRAINTS + "SELECT * FROM cons")
def grouped_constraints(spark, sf):
    rows = constraints(spark, sf)
    return rows.withColumn("columns", F.array_join("column_names", ", ")).drop("column_names")


@query("catalog_primary_keys", COLS + """
SELECT database, schema_name, table_name, string_agg(name, ', ' ORDER BY ordinal_position DESC) AS columns
FROM cols WHERE ordinal_position IN (2, 3) GROUP BY ALL""")
def primary_keys(spark, sf):
    columns = i.columns(spark, sf)
    kinds = F.array(
        F.struct(F.lit("c1").alias("constraint_name"), F.lit("P").alias("constraint_type")),
        F.struct(F.lit("c2").alias("constraint_name"), F.lit("U").alias("constraint_type")),
    )
    declared = i.tables(spark, sf).select(*catalog.TABLE, F.inline(kinds))
    used = columns.select(
        *catalog.TABLE,
        F.when(F.col("ordinal_position").isin(2, 3), "c1").otherwise("c2").alias("constraint_name"),
        F.col("name").alias("column_name"),
        (-F.col("ordinal_position")).alias("position"),
    )
    rows = catalog.primary_keys(declared, used)
    return rows.select(*catalog.TABLE, F.array_join("column_names", ", ").alias("columns"))


@query("catalog_columns_comments", COLS + """
SELECT database, table_name, name,
  CAST(row_number() OVER (PARTITION BY database, table_name ORDER BY ordinal_position DESC) AS INTEGER) AS ordinal_position,
  CASE WHEN is_nullable THEN comment ELSE '' END AS comment FROM cols""")
def columns_comments(spark, sf):
    columns = i.columns(spark, sf)
    notes = columns.where("is_nullable").select(*catalog.COLUMN, "comment")
    backwards = columns.withColumn("ordinal_position", 1000 - F.col("ordinal_position"))
    rows = catalog.with_ordinals(catalog.with_comments(backwards, notes, catalog.COLUMN))
    return rows.select("database", "table_name", "name", "ordinal_position", "comment")


@query("catalog_tables_views", COLS + """
SELECT DISTINCT table_name, 'TABLE' AS table_type FROM cols
UNION ALL SELECT 'v_' || s_suppkey, 'VIEW' FROM supplier""")
def tables_views(spark, sf):
    views = i.table(spark, sf, "supplier").select(F.concat(F.lit("v_"), "s_suppkey").alias("table_name"))
    return catalog.tables_and_views(i.tables(spark, sf).select("table_name"), views)


def snapshot(spark, sf):
    """The next snapshot of the column catalog: columns gone, new and changed; one database not covered."""
    brand = F.substring_index("comment", " ", 1)
    columns = i.columns(spark, sf).where((brand != "Brand#5") & (F.col("database") != "db_1"))
    changed = columns.withColumn("comment", F.when(brand == "Brand#3", "changed").otherwise(F.col("comment")))
    new = columns.where(brand == "Brand#9").withColumn("name", F.concat("name", F.lit("_new")))
    return changed.unionByName(new)


@query("catalog_stale", COLS + """
SELECT database, table_name, name FROM cols WHERE p_brand = 'Brand#5' AND database <> 'db_1'""")
def stale(spark, sf):
    gone = catalog.stale(i.columns(spark, sf), snapshot(spark, sf), catalog.COLUMN)
    return gone.select("database", "table_name", "name")


@query("catalog_sync", COLS + """
SELECT database, table_name, name, CASE WHEN p_brand = 'Brand#3' AND database <> 'db_1' THEN 'changed' ELSE comment END AS comment,
  CASE WHEN database = 'db_1' THEN 'keep' WHEN p_brand = 'Brand#5' THEN 'delete' WHEN p_brand = 'Brand#3' THEN 'update'
       ELSE 'keep' END AS change FROM cols
UNION ALL SELECT database, table_name, name || '_new', comment, 'insert' FROM cols
WHERE p_brand = 'Brand#9' AND database <> 'db_1'""")
def sync(spark, sf):
    merged = catalog.sync(i.columns(spark, sf), snapshot(spark, sf), catalog.COLUMN)
    return merged.select("database", "table_name", "name", "comment", "change")


ALL = COLS + "," + i.TABLES_SQL + "," + i.DATABASES_SQL


@query("catalog_counts", ALL + """
SELECT database, db_type, database_name, (SELECT count(*) FROM tabs t WHERE t.database = d.database) AS table_count FROM dbs d""")
def counts(spark, sf):
    return catalog.table_counts(i.databases(spark, sf), i.tables(spark, sf))


@query("catalog_totals", ALL + """
SELECT 'databases' AS kind, count(*) AS rows FROM dbs UNION ALL SELECT 'tables', count(*) FROM tabs
UNION ALL SELECT 'columns', count(*) FROM cols""")
def totals(spark, sf):
    return catalog.totals(
        databases=i.databases(spark, sf), tables=i.tables(spark, sf), columns=i.columns(spark, sf)
    )


@query("catalog_export_tables", ALL + """
SELECT database, schema_name, table_name, table_type, comment,
  (SELECT count(*) FROM cols c WHERE c.table_name = t.table_name AND c.database = t.database) AS column_count FROM tabs t""")
def export_tables(spark, sf):
    return catalog.export_tables(i.tables(spark, sf), i.columns(spark, sf))


@query("catalog_export_columns", COLS + """
SELECT database, schema_name, table_name, ordinal_position, name, data_type, column_type,
  CASE WHEN is_nullable THEN 'yes' ELSE 'no' END AS nullable, coalesce(column_default, '') AS column_default, comment FROM cols""")
def export_columns(spark, sf):
    return catalog.export_columns(i.columns(spark, sf))


@query("catalog_export_indexes", INDEXES + """
SELECT database, schema_name, table_name, name,
  CASE WHEN is_primary THEN 'primary' WHEN is_unique THEN 'unique' ELSE 'plain' END AS kind, columns, '' AS definition FROM idx""")
def export_indexes(spark, sf):
    return catalog.export_indexes(indexes(spark, sf))


@query("catalog_export_constraints", CONSTRAINTS + "SELECT * FROM cons")
def export_constraints(spark, sf):
    return catalog.export_constraints(constraints(spark, sf))


def found(spark, sf, text):
    return catalog.dictionary(i.columns(spark, sf), i.tables(spark, sf), i.databases(spark, sf), text)


FOUND = ALL + """,
dict AS (
  SELECT c.database, db_type, database_name, c.schema_name, c.table_name, t.comment AS table_comment, c.ordinal_position,
    c.name, c.data_type, c.column_type, c.is_nullable, c.column_default, c.comment
  FROM cols c JOIN tabs t USING (database, schema_name, table_name) JOIN dbs d USING (database)),
hit AS (SELECT * FROM dict WHERE {where})
"""
HIT = " OR ".join(f"contains(lower({c}), 'brand#1')" for c in ("name", "comment", "table_name", "table_comment", "schema_name"))


@query("dictionary_search", FOUND.format(where=HIT) + """
SELECT database, table_name, name, table_comment, comment FROM hit""")
def dictionary_search(spark, sf):
    return found(spark, sf, " BRAND#1 ").select("database", "table_name", "name", "table_comment", "comment")


@query("dictionary_page", FOUND.format(where="true") + """
SELECT database, table_name, ordinal_position, name FROM hit
ORDER BY database, schema_name, table_name, ordinal_position, name LIMIT 300 OFFSET 40""")
def dictionary_page(spark, sf):
    return catalog.page(found(spark, sf, ""), "300", 40).select("database", "table_name", "ordinal_position", "name")


@query("dictionary_export", FOUND.format(where=HIT) + """
SELECT database_name, db_type, schema_name, table_name, table_comment, ordinal_position, name,
  coalesce(nullif(column_type, ''), data_type) AS type, CASE WHEN is_nullable THEN 'yes' ELSE 'no' END AS nullable,
  coalesce(column_default, '') AS column_default, comment FROM hit""")
def dictionary_export(spark, sf):
    return catalog.export_dictionary(found(spark, sf, "brand#1"))


@query("catalog_table_search", ALL + """
SELECT database, table_name, comment FROM tabs
WHERE database = 'db_0' AND contains(lower(concat_ws(' ', schema_name, table_name, table_type, comment)), 'widget')""")
def table_search(spark, sf):
    return catalog.search_tables(i.tables(spark, sf), "db_0", "Widget").select("database", "table_name", "comment")


LINEAGE = "WITH " + i.CORPUS_SQL


def edges(spark, sf):
    return lineage.edges(lineage.extract(i.corpus(spark, sf)))


@query("lineage_edges", LINEAGE + "SELECT * FROM edge")
def lineage_edges(spark, sf):
    return edges(spark, sf)


@query("lineage_nodes", LINEAGE + "SELECT source_table AS table_name FROM edge UNION SELECT target_table FROM edge")
def lineage_nodes(spark, sf):
    return lineage.nodes(edges(spark, sf))


@query("lineage_by_target", LINEAGE + """
SELECT target_table, source_table, count(*) AS files FROM edge GROUP BY ALL""")
def lineage_by_target(spark, sf):
    return lineage.by_target(edges(spark, sf))


@query("lineage_target_totals", LINEAGE + """
SELECT target_table, count(*) AS edges, count(DISTINCT source_table) AS sources FROM edge GROUP BY target_table""")
def lineage_target_totals(spark, sf):
    return lineage.target_totals(edges(spark, sf))


@query("lineage_graph_totals", LINEAGE + """
SELECT (SELECT count(*) FROM edge) AS edges,
  (SELECT count(*) FROM (SELECT source_table FROM edge UNION SELECT target_table FROM edge)) AS nodes""")
def lineage_graph_totals(spark, sf):
    return lineage.graph_totals(edges(spark, sf))


def statements(spark, sf):
    """One statement per customer, in files by nation: lists of tables, sub-queries after WHERE, CTEs, comments, texts."""
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    sql = (
        F.when(F.col("c_custkey") % 4 == 0, text(
            "INSERT INTO dwd.c_", k, " SELECT x.a FROM ods.a_", k, " x, ods.b_", n, " AS y WHERE x.d IN (SELECT d FROM ods.sub_", n, ") ORDER BY 1;"))
        .when(F.col("c_custkey") % 4 == 1, text(
            "CREATE TABLE dws.w_", k, " AS WITH base AS (SELECT * FROM ods.a_", k, " /* FROM ods.comment; */), more AS (SELECT * FROM base) "
            "SELECT EXTRACT(year FROM t) FROM more JOIN (SELECT 1 AS o FROM dim.d_", n, ") z ON z.o = 1 -- FROM ods.note\n;"))
        .when(F.col("c_custkey") % 4 == 2, text(
            "INSERT OVERWRITE TABLE dwd.o_", k, " SELECT 'it''s FROM ods.quoted -- no', b FROM (ods.a_", k, " JOIN `ods`.`b_", n,
            "` ON 1 = 1), LATERAL unnest(c) WHERE a IS DISTINCT FROM b UNION ALL SELECT 1, 2 FROM ods.u_", n, ", dual GROUP BY 1;"))
        .otherwise(text("SELECT * FROM ods.a_", k, ";"))
    )
    return i.table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), sql.alias("sql"))


@query("lineage_edges_extended", """
WITH cust AS (SELECT c_custkey AS k, c_nationkey AS n, 'nation=' || c_nationkey AS sql_file FROM customer)
SELECT unnest(['ods.a_' || k, 'ods.b_' || n, 'ods.sub_' || n]) AS source_table, 'dwd.c_' || k AS target_table, sql_file FROM cust WHERE k % 4 = 0
UNION ALL SELECT unnest(['ods.a_' || k, 'dim.d_' || n]), 'dws.w_' || k, sql_file FROM cust WHERE k % 4 = 1
UNION ALL SELECT unnest(['ods.a_' || k, 'ods.b_' || n, 'ods.u_' || n]), 'dwd.o_' || k, sql_file FROM cust WHERE k % 4 = 2""")
def lineage_edges_extended(spark, sf):
    """The corpus as files, read back whole, each word of it folded."""
    folder = scratch_path(spark, "corpus")
    statements(spark, sf).repartition("nation").write.partitionBy("nation").text(folder)
    files = corpus.read(spark, folder, endings=["txt"])
    by_nation = files.withColumn("path", F.substring_index("path", "/", 1))
    return lineage.edges(lineage.extract(by_nation, extended=True))


@query("catalog_listed_tables", COLS + "," + i.TABLES_SQL + """
SELECT 'odps' AS vendor, 'shop' AS database, 'shop' AS schema_name, table_name, 'TABLE' AS table_type, '' AS comment FROM tabs
UNION ALL SELECT 'store', 'mart', 'mart', table_name, 'TABLE', '' FROM tabs""")
def listed_tables(spark, sf):
    """Vendors that list names alone."""
    names = i.tables(spark, sf).select(F.col("table_name").alias("name"))
    odps = views.odps_tables(names, "shop").withColumn("vendor", F.lit("odps"))
    return odps.unionByName(views.store_tables(names.toDF("Tables_in_mart"), "mart").withColumn("vendor", F.lit("store")))


@query("catalog_schemas", COLS + "SELECT DISTINCT 'main' AS database, 'shop_' || database AS schema_name FROM cols")
def listed_schemas(spark, sf):
    """Schemas of a vendor's list, without its own."""
    used = i.columns(spark, sf).select(F.concat(F.lit("shop_"), "database").alias("schema_name"))
    own = spark.createDataFrame([("information_schema",), ("pg_catalog",)], "schema_name string")
    return views.schemas(used.union(own), "postgresql", "main")
