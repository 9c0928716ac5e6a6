"""Vendor catalog views in the pinned catalog layout.

Every function takes the rows of a vendor's view as a DataFrame (``jdbc`` reads the view in
one go for all tables) and returns the shape of ``tidegate.operators.catalog``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.functions import typetext
from tidegate.operators import catalog
from tidegate.sources.jdbc import url

# The catalog views to read and the schemas that belong to the system.
VIEWS = {
    "mysql": {
        "tables": "information_schema.tables",
        "columns": "information_schema.columns",
        "indexes": "information_schema.statistics",
        "constraints": "information_schema.table_constraints",
        "key_usage": "information_schema.key_column_usage",
    },
    "postgresql": {
        "tables": "information_schema.tables",
        "columns": "information_schema.columns",
        "constraints": "information_schema.table_constraints",
        "key_usage": "information_schema.key_column_usage",
        "referenced": "information_schema.constraint_column_usage",
        "indexes": "pg_catalog.pg_index",
        "attributes": "pg_catalog.pg_attribute",
        "classes": "pg_catalog.pg_class",
        "namespaces": "pg_catalog.pg_namespace",
        "descriptions": "pg_catalog.pg_description",
        "index_definitions": "pg_catalog.pg_indexes",
    },
    "oracle": {
        "tables": "user_tables",
        "views": "user_views",
        "table_comments": "user_tab_comments",
        "columns": "user_tab_columns",
        "column_comments": "user_col_comments",
        "constraints": "user_constraints",
        "key_usage": "user_cons_columns",
    },
    "clickhouse": {"tables": "system.tables", "columns": "system.columns"},
    "db2": {"tables": "SYSCAT.TABLES", "columns": "SYSCAT.COLUMNS"},
}
SYSTEM_SCHEMAS = {
    "mysql": ["information_schema", "mysql", "performance_schema", "sys"],
    "postgresql": ["pg_catalog", "information_schema"],
    "clickhouse": ["system", "INFORMATION_SCHEMA"],
    "db2": ["SYSIBM", "SYSCAT", "SYSSTAT", "SYSTOOLS"],
}
SYSTEM_PREFIXES = {"postgresql": ["pg_toast", "pg_temp"]}
PARTITION_NOTE = "partition column: "
# Fixed value: the object class of tables, views and their columns in pg_description.
PG_CLASS = 1259


def read(spark: SparkSession, kind: str, view: str, host: str, database: str, user: str, password: str,
         port: int | None = None) -> DataFrame:
    """A whole catalog view in one query, its column names in lower case."""
    rows = (
        spark.read.format("jdbc")
        .options(url=url(kind, host, database, port), dbtable=VIEWS[kind][view], user=user, password=password)
        .load()
    )
    return rows.toDF(*[c.lower() for c in rows.columns])


def user_schemas(rows: DataFrame, kind: str, column: str) -> DataFrame:
    """Rows of schemas that hold user tables."""
    kept = ~F.col(column).isin(SYSTEM_SCHEMAS.get(kind, []))
    for prefix in SYSTEM_PREFIXES.get(kind, []):
        kept = kept & ~F.col(column).startswith(prefix)
    return rows.where(kept)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _number(name: str) -> Column:
    return F.col(name).cast("int")


def _columns(
    rows: DataFrame, database: str, schema: Column, table: Column, name: Column, position: Column,
    descriptor: Column, default: Column, nullable: Column, comment: Column,
) -> DataFrame:
    shaped = rows.select(
        F.lit(database).alias("database"),
        schema.alias("schema_name"),
        table.alias("table_name"),
        name.alias("name"),
        position.cast("int").alias("ordinal_position"),
        descriptor.alias("d"),
        default.cast("string").alias("column_default"),
        nullable.alias("is_nullable"),
        comment.alias("comment"),
    )
    return shaped.select(
        "database", "schema_name", "table_name", "name", "ordinal_position",
        "d.data_type", "d.column_type", "column_default", "is_nullable",
        "d.max_length", "d.numeric_precision", "d.numeric_scale", "comment",
    )


def _is_yes(name: str, yes: str = "YES", missing: str = "") -> Column:
    return F.upper(F.coalesce(F.col(name), F.lit(missing))) == yes


def information_schema_tables(rows: DataFrame, database: str, kind: str) -> DataFrame:
    comment = _text("table_comment") if "table_comment" in rows.columns else F.lit("")
    return user_schemas(rows, kind, "table_schema").select(
        F.lit(database).alias("database"),
        F.col("table_schema").alias("schema_name"),
        "table_name",
        _text("table_type").alias("table_type"),
        comment.alias("comment"),
    )


def information_schema_columns(rows: DataFrame, database: str, kind: str) -> DataFrame:
    """MySQL and PostgreSQL columns; the full type text is ``column_type`` or ``udt_name``."""
    type_text = "column_type" if "column_type" in rows.columns else "udt_name"
    comment = _text("column_comment") if "column_comment" in rows.columns else F.lit("")
    descriptor = F.struct(
        _text("data_type").alias("data_type"),
        _text(type_text).alias("column_type"),
        _number("character_maximum_length").alias("max_length"),
        _number("numeric_precision").alias("numeric_precision"),
        _number("numeric_scale").alias("numeric_scale"),
    )
    return _columns(
        user_schemas(rows, kind, "table_schema"), database, F.col("table_schema"), F.col("table_name"),
        F.col("column_name"), F.col("ordinal_position"), descriptor, F.col("column_default"),
        _is_yes("is_nullable"), comment,
    )


def _pg_relations(classes: DataFrame, namespaces: DataFrame, database: str) -> DataFrame:
    """PostgreSQL's tables, views and indexes by their number, with the schema they are in."""
    spaces = namespaces.select(F.col("oid").cast("long").alias("space"), F.col("nspname").alias("schema_name"))
    relations = classes.select(
        F.col("oid").cast("long").alias("oid"), F.col("relname"), F.col("relnamespace").cast("long").alias("space")
    ).join(spaces, "space")
    return user_schemas(relations, "postgresql", "schema_name").select(
        "oid", F.lit(database).alias("database"), "schema_name", "relname"
    )


def postgresql_indexes(
    indexes: DataFrame, classes: DataFrame, namespaces: DataFrame, attributes: DataFrame, database: str,
    definitions: DataFrame | None = None,
) -> DataFrame:
    """Indexes from the catalog's own tables; key numbers come as text (``1 2``) over JDBC, 0 is an expression."""
    relations = _pg_relations(classes, namespaces, database)
    tables = relations.select(
        F.col("oid").alias("indrelid"), "database", "schema_name", F.col("relname").alias("table_name")
    )
    names = relations.select(F.col("oid").alias("indexrelid"), F.col("relname").alias("name"))
    keys = F.transform(
        F.filter(F.split(F.trim(F.col("indkey").cast("string")), r"\s+"), lambda k: k.rlike("^[0-9]+$")),
        lambda k: k.cast("int"),
    )
    listed = (
        indexes.select(
            F.col("indexrelid").cast("long").alias("indexrelid"), F.col("indrelid").cast("long").alias("indrelid"),
            F.col("indisunique").alias("is_unique"), F.col("indisprimary").alias("is_primary"), keys.alias("index_keys"),
        )
        .join(tables, "indrelid")
        .join(names, "indexrelid")
        .select(*catalog.TABLE, "name", "is_unique", "is_primary", "index_keys")
    )
    columns = attributes.select(
        F.col("attrelid").cast("long").alias("indrelid"), F.col("attnum").cast("int").alias("ordinal_position"),
        F.col("attname").alias("name"),
    ).join(tables, "indrelid")
    expanded = catalog.expand_indexes(listed, columns.select(*catalog.TABLE, "ordinal_position", "name"))
    if definitions is None:
        return expanded.withColumn("definition", F.lit(""))
    texts = definitions.select(
        F.lit(database).alias("database"), F.col("schemaname").alias("schema_name"),
        F.col("tablename").alias("table_name"), F.col("indexname").alias("name"), F.col("indexdef").alias("definition"),
    )
    return expanded.join(texts, [*catalog.TABLE, "name"], "left").withColumn(
        "definition", F.coalesce("definition", F.lit(""))
    )


def postgresql_comments(
    descriptions: DataFrame, classes: DataFrame, namespaces: DataFrame, attributes: DataFrame, database: str
) -> tuple[DataFrame, DataFrame]:
    """Comments of tables and of columns, for ``catalog.with_comments``."""
    relations = _pg_relations(classes, namespaces, database).withColumnRenamed("relname", "table_name")
    notes = descriptions.where(F.col("classoid").cast("long") == PG_CLASS).select(
        F.col("objoid").cast("long").alias("oid"), F.col("objsubid").cast("int").alias("part"),
        F.col("description").alias("comment"),
    ).join(relations, "oid")
    of_columns = notes.where("part > 0").join(
        attributes.select(
            F.col("attrelid").cast("long").alias("oid"), F.col("attnum").cast("int").alias("part"),
            F.col("attname").alias("name"),
        ),
        ["oid", "part"],
    )
    return (
        notes.where("part = 0").select(*catalog.TABLE, "comment"),
        of_columns.select(*catalog.TABLE, "name", "comment"),
    )


def mysql_indexes(rows: DataFrame, database: str) -> DataFrame:
    parts = user_schemas(rows, "mysql", "table_schema").select(
        F.lit(database).alias("database"),
        F.col("table_schema").alias("schema_name"),
        "table_name", "index_name", "non_unique", "column_name", "seq_in_index",
    )
    return catalog.group_indexes(parts)


def information_schema_constraints(
    constraints: DataFrame, usage: DataFrame, database: str, kind: str, referenced: DataFrame | None = None
) -> DataFrame:
    """MySQL lists references with the key usage, PostgreSQL in a view of its own."""
    def located(rows: DataFrame) -> DataFrame:
        return user_schemas(rows, kind, "table_schema").select(
            F.lit(database).alias("database"), F.col("table_schema").alias("schema_name"), "*"
        )

    own = located(constraints).select(*catalog.TABLE, "constraint_name", "constraint_type")
    in_usage = "referenced_table_name" in usage.columns
    extra = [
        F.col("referenced_table_name").alias("referenced_table"),
        F.col("referenced_column_name").alias("referenced_column"),
    ] if in_usage else []
    used = located(usage).select(
        *catalog.TABLE, "constraint_name", "column_name", F.col("ordinal_position").alias("position"), *extra
    )
    if in_usage or referenced is None:
        return catalog.group_constraints(own, used)
    # the view names the referenced table, so it joins by the constraint alone
    targets = referenced.select(
        F.lit(database).alias("database"),
        F.col("constraint_schema").alias("schema_name"),
        "constraint_name",
        F.col("table_name").alias("referenced_table"),
        F.col("column_name").alias("referenced_column"),
    )
    located_targets = targets.join(
        own.select(*catalog.TABLE, "constraint_name"), ["database", "schema_name", "constraint_name"]
    )
    return catalog.group_constraints(own, used, located_targets)


def oracle_tables(tables: DataFrame, views: DataFrame, comments: DataFrame, database: str, schema: str) -> DataFrame:
    listed = catalog.tables_and_views(
        tables.select("table_name"), views.select(F.col("view_name").alias("table_name"))
    )
    notes = comments.select("table_name", F.col("comments").alias("comment"))
    return catalog.with_comments(listed, notes, ["table_name"]).select(
        F.lit(database).alias("database"), F.lit(schema).alias("schema_name"),
        "table_name", "table_type", "comment",
    )


def oracle_columns(rows: DataFrame, comments: DataFrame, database: str, schema: str) -> DataFrame:
    notes = comments.select("table_name", "column_name", F.col("comments").alias("comment"))
    noted = catalog.with_comments(rows, notes, ["table_name", "column_name"])
    descriptor = typetext.oracle_descriptor(
        F.col("data_type"), F.col("data_length"), F.col("data_precision"), F.col("data_scale")
    )
    shaped = _columns(
        noted, database, F.lit(schema), F.col("table_name"), F.col("column_name"), F.col("column_id"), descriptor,
        F.col("data_default"), _is_yes("nullable", "Y", "Y"), F.col("comment"),
    )
    return catalog.with_ordinals(shaped)


def oracle_primary_keys(constraints: DataFrame, columns: DataFrame, database: str, schema: str) -> DataFrame:
    place = [F.lit(database).alias("database"), F.lit(schema).alias("schema_name")]
    return catalog.primary_keys(
        constraints.select(*place, "owner", "table_name", "constraint_name", "constraint_type").drop("owner"),
        columns.select(*place, "table_name", "constraint_name", "column_name", "position"),
    )


def clickhouse_tables(rows: DataFrame) -> DataFrame:
    return user_schemas(rows, "clickhouse", "database").select(
        "database", F.col("database").alias("schema_name"), F.col("name").alias("table_name"),
        F.coalesce(F.nullif("engine", F.lit("")), F.lit("TABLE")).alias("table_type"),
        _text("comment").alias("comment"),
    )


def clickhouse_columns(rows: DataFrame) -> DataFrame:
    kept = user_schemas(rows, "clickhouse", "database").withColumn("_db", F.col("database"))
    shaped = _columns(
        kept, "", F.col("_db"), F.col("table"), F.col("name"), F.col("position"),
        typetext.clickhouse_descriptor(F.col("type")), F.lit(None), F.lit(True), _text("comment"),
    )
    return catalog.with_ordinals(shaped.withColumn("database", F.col("schema_name")))


def db2_tables(rows: DataFrame, database: str) -> DataFrame:
    return user_schemas(rows, "db2", "tabschema").select(
        F.lit(database).alias("database"), F.col("tabschema").alias("schema_name"),
        F.col("tabname").alias("table_name"),
        F.when(F.col("type") == "V", "VIEW").otherwise("TABLE").alias("table_type"),
        _text("remarks").alias("comment"),
    )


def db2_columns(rows: DataFrame, database: str) -> DataFrame:
    shaped = _columns(
        user_schemas(rows, "db2", "tabschema"), database, F.col("tabschema"), F.col("tabname"), F.col("colname"),
        F.col("colno"), typetext.db2_descriptor(F.col("typename"), F.col("length"), F.col("scale")),
        F.col("default"), _is_yes("nulls", "Y", "Y"), _text("remarks"),
    )
    return catalog.with_ordinals(shaped)


def schemas(rows: DataFrame, kind: str, database: str) -> DataFrame:
    """A vendor's schema list, its one column under any name, without the vendor's own schemas."""
    name = rows.columns[0]
    return user_schemas(rows, kind, name).select(F.lit(database).alias("database"), F.col(name).alias("schema_name")).distinct()


def odps_tables(rows: DataFrame, database: str) -> DataFrame:
    """The project's table names; it is its own schema and keeps no comments."""
    return _listed(rows.select(F.col("name")), database)


def store_tables(rows: DataFrame, database: str) -> DataFrame:
    """The analytical store's table names; their column is named after the database."""
    return _listed(rows, database)


def _listed(rows: DataFrame, database: str) -> DataFrame:
    return rows.select(
        F.lit(database).alias("database"), F.lit(database).alias("schema_name"), F.col(rows.columns[0]).alias("table_name"),
        F.lit("TABLE").alias("table_type"), F.lit("").alias("comment"),
    )


def odps_columns(rows: DataFrame, database: str) -> DataFrame:
    """Rows of (table_name, name, type, comment, position, is_partition); partition columns last."""
    order = Window.partitionBy("table_name").orderBy("is_partition", "position")
    numbered = rows.withColumn("_n", F.row_number().over(order))
    note = F.when(F.col("is_partition"), F.concat(F.lit(PARTITION_NOTE), _text("comment"))).otherwise(
        _text("comment")
    )
    return _columns(
        numbered, database, F.lit(database), F.col("table_name"), F.col("name"), F.col("_n"),
        typetext.odps_descriptor(F.col("type")), F.lit(None), F.lit(True), note,
    )


def store_columns(rows: DataFrame, database: str) -> DataFrame:
    """Described columns of the analytical store: (table_name, field, type, null, default, position)."""
    return catalog.with_ordinals(
        _columns(
            rows, database, F.lit(database), F.col("table_name"), F.col("field"), F.col("position"),
            typetext.store_descriptor(F.col("type")), F.col("default"), _is_yes("null"), F.lit(""),
        )
    )
