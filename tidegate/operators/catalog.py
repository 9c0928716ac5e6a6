"""The metadata catalog: databases, tables, columns, indexes, constraints.

Lists in a row (columns of an index or a constraint) are bounded by the vendors: at most a
few dozen columns per index, a few thousand per table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Unique keys of the catalog tables.
DATABASE = ("database",)
TABLE = ("database", "schema_name", "table_name")
COLUMN = (*TABLE, "name")

DATABASES_DDL = (
    "database string, db_type string, host string, port int, database_name string, "
    "schema_name string, status string, last_sync_at timestamp"
)
TABLES_DDL = "database string, schema_name string, table_name string, table_type string, comment string"
COLUMNS_DDL = (
    "database string, schema_name string, table_name string, name string, ordinal_position int, "
    "data_type string, column_type string, column_default string, is_nullable boolean, max_length int, "
    "numeric_precision int, numeric_scale int, comment string"
)
INDEXES_DDL = (
    "database string, schema_name string, table_name string, name string, is_unique boolean, "
    "is_primary boolean, column_names array<string>, definition string"
)
CONSTRAINTS_DDL = (
    "database string, schema_name string, table_name string, name string, constraint_type string, "
    "column_names array<string>, referenced_table string, referenced_column string"
)

# Page size limits of the dictionary.
PAGE_DEFAULT = 300


def ordered_names(position: Column, name: Column) -> Column:
    """Distinct names of a group in position order; blank names are left out."""
    entry = F.when(F.coalesce(name, F.lit("")) != "", F.struct(position.alias("p"), name.alias("n")))
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["n"]))


def with_ordinals(columns: DataFrame, keys: Sequence[str] = TABLE, order: str = "ordinal_position") -> DataFrame:
    """Number the columns of a table 1, 2, 3 … in catalog order."""
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(order, "name"))
    return columns.withColumn("ordinal_position", position)


def with_comments(rows: DataFrame, comments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach comments kept in a catalog view of their own; none is an empty text."""
    notes = comments.select(*keys, F.col("comment").alias("_comment"))
    return (
        rows.drop("comment")
        .join(notes, list(keys), "left")
        .withColumn("comment", F.coalesce("_comment", F.lit("")))
        .drop("_comment")
    )


def tables_and_views(tables: DataFrame, views: DataFrame) -> DataFrame:
    """Tables and views in one list, labelled with their kind."""
    label = lambda df, kind: df.withColumn("table_type", F.lit(kind))
    return label(tables, "TABLE").unionByName(label(views, "VIEW"))


def group_indexes(parts: DataFrame, keys: Sequence[str] = TABLE) -> DataFrame:
    """Index parts (index_name, non_unique, column_name, seq_in_index) to one row per index."""
    return (
        parts.groupBy(*keys, F.col("index_name").alias("name"))
        .agg(
            F.bool_and(F.col("non_unique") == 0).alias("is_unique"),
            ordered_names(F.col("seq_in_index"), F.col("column_name")).alias("column_names"),
        )
        .withColumn("is_primary", F.col("name") == "PRIMARY")
        .withColumn("definition", F.lit(""))
    )


def expand_indexes(indexes: DataFrame, attributes: DataFrame, keys: Sequence[str] = TABLE) -> DataFrame:
    """Index key numbers (``index_keys ARRAY<INT>``) to column names in key order."""
    parts = indexes.select(*keys, "name", F.posexplode("index_keys").alias("position", "attribute"))
    named = parts.join(
        attributes.select(*keys, F.col("ordinal_position").alias("attribute"), F.col("name").alias("column_name")),
        [*keys, "attribute"],
    )
    names = named.groupBy(*keys, "name").agg(
        ordered_names(F.col("position"), F.col("column_name")).alias("column_names")
    )
    return (
        indexes.drop("index_keys")
        .join(names, [*keys, "name"], "left")
        .withColumn("column_names", F.coalesce("column_names", F.array().cast("array<string>")))
    )


def group_constraints(
    constraints: DataFrame, usage: DataFrame, referenced: DataFrame | None = None,
    keys: Sequence[str] = TABLE,
) -> DataFrame:
    """Constraints with their ordered columns and what a foreign key refers to.

    ``usage`` holds (constraint_name, column_name, position) and, where the vendor lists it
    there, the referenced table and column; ``referenced`` is the vendor's separate view.
    References are kept for foreign keys only.
    """
    joined = constraints.join(usage, [*keys, "constraint_name"], "left")
    if referenced is not None:
        by_name = referenced.groupBy(*keys, "constraint_name").agg(
            F.min("referenced_table").alias("referenced_table"),
            F.min("referenced_column").alias("referenced_column"),
        )
        joined = joined.join(by_name, [*keys, "constraint_name"], "left")
    is_foreign = F.col("constraint_type") == "FOREIGN KEY"

    def first_named(column: str) -> Column:
        # the reference of the earliest position that has one
        value = F.when(is_foreign & (F.coalesce(column, F.lit("")) != ""), F.col(column))
        return F.coalesce(F.min_by(value, F.when(value.isNotNull(), F.col("position"))), F.lit(""))

    return (
        joined.groupBy(*keys, F.col("constraint_name").alias("name"), "constraint_type")
        .agg(
            ordered_names(F.col("position"), F.col("column_name")).alias("column_names"),
            first_named("referenced_table").alias("referenced_table"),
            first_named("referenced_column").alias("referenced_column"),
        )
    )


def primary_keys(constraints: DataFrame, columns: DataFrame, keys: Sequence[str] = TABLE) -> DataFrame:
    """Key columns of each table: constraints of type P joined to their columns."""
    return (
        constraints.where(F.col("constraint_type") == "P")
        .join(columns, [*keys, "constraint_name"])
        .groupBy(*keys)
        .agg(ordered_names(F.col("position"), F.col("column_name")).alias("column_names"))
    )


def index_kind(is_primary: Column, is_unique: Column) -> Column:
    return F.when(is_primary, "primary").when(is_unique, "unique").otherwise("plain")


def _covered(snapshot: DataFrame, scope: Sequence[str], covered: DataFrame | None) -> DataFrame:
    """Schemas a snapshot speaks for: its own, or those of the wider snapshot it belongs to."""
    return (snapshot if covered is None else covered).select(*scope).distinct()


def stale(
    existing: DataFrame, snapshot: DataFrame, keys: Sequence[str], scope: Sequence[str] = TABLE[:2],
    covered: DataFrame | None = None,
) -> DataFrame:
    """Catalog rows the snapshot no longer has, within the schemas the snapshot covers."""
    inside = existing.join(_covered(snapshot, scope, covered), list(scope), "left_semi")
    return inside.join(snapshot.select(*keys), list(keys), "left_anti")


def sync(
    existing: DataFrame, snapshot: DataFrame, keys: Sequence[str], scope: Sequence[str] = TABLE[:2],
    covered: DataFrame | None = None, allow_empty: bool = False,
) -> DataFrame:
    """The catalog after a snapshot, each row labelled insert, update, keep or delete.

    Rows of schemas the snapshot does not cover stay as they are. A snapshot that covers
    nothing is taken for a failed read unless ``allow_empty``; then it clears the catalog.
    """
    schemas = _covered(snapshot, scope, covered)
    if schemas.isEmpty():
        if not allow_empty:
            raise ValueError("the snapshot is empty; pass allow_empty to clear the catalog")
        return existing.withColumn("change", F.lit("delete"))
    values = [c for c in snapshot.columns if c not in keys]
    old = existing.select(*keys, F.struct(*values).alias("old"))
    new = snapshot.select(*keys, F.struct(*values).alias("new"))
    change = (
        F.when(F.col("old").isNull(), "insert")
        .when(F.col("new").isNull(), F.when(F.col("_inside"), "delete").otherwise("keep"))
        .when(F.col("old").eqNullSafe(F.col("new")), "keep")
        .otherwise("update")
    )
    picked = F.coalesce("new", "old")
    return (
        old.join(new, list(keys), "full_outer")
        .join(schemas.withColumn("_inside", F.lit(True)), list(scope), "left")
        .select(*keys, *[picked[v].alias(v) for v in values], change.alias("change"))
    )


def after_sync(merged: DataFrame) -> DataFrame:
    return merged.where(F.col("change") != "delete").drop("change")


def sync_stats(merged: DataFrame) -> DataFrame:
    return merged.groupBy("change").agg(F.count("*").alias("rows"))


def table_counts(databases: DataFrame, tables: DataFrame) -> DataFrame:
    """Databases with their number of tables, zero included."""
    counted = tables.groupBy(*DATABASE).agg(F.count("*").alias("table_count"))
    return databases.join(counted, list(DATABASE), "left").withColumn(
        "table_count", F.coalesce("table_count", F.lit(0).cast("bigint"))
    )


def column_counts(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables with their number of columns, zero included."""
    counted = columns.groupBy(*TABLE).agg(F.count("*").alias("column_count"))
    return tables.join(counted, list(TABLE), "left").withColumn(
        "column_count", F.coalesce("column_count", F.lit(0).cast("bigint"))
    )


def totals(**kinds: DataFrame) -> DataFrame:
    """Row counts of the catalog tables, one row per kind."""
    frames = [df.agg(F.count("*").alias("rows")).select(F.lit(k).alias("kind"), "rows") for k, df in kinds.items()]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def dictionary(
    columns: DataFrame, tables: DataFrame, databases: DataFrame, query: str = "", database: str = ""
) -> DataFrame:
    """Columns with their table and database, searched in names and comments.

    The text search is a case-insensitive contains over column name and comment, table name
    and comment, and schema.
    """
    if database:
        columns = columns.where(F.col("database") == database)
        tables = tables.where(F.col("database") == database)
    joined = columns.join(
        tables.select(*TABLE, "table_type", F.col("comment").alias("table_comment")), list(TABLE)
    ).join(databases.select("database", "db_type", "database_name"), "database")
    needle = query.strip().lower()
    if needle:
        hit = F.lit(False)
        for name in ("name", "comment", "table_name", "table_comment", "schema_name"):
            hit = hit | F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit(needle))
        joined = joined.where(hit)
    return joined


PAGE_ORDER = ("database", "schema_name", "table_name", "ordinal_position", "name")


def page(
    found: DataFrame, limit: int | str = PAGE_DEFAULT, offset: int | str = 0, after: Sequence | None = None
) -> DataFrame:
    """One page in catalog order, of any size.

    Deep pages are cheaper with ``after``, the order values of the last row seen: the filter
    replaces the offset.
    """
    limit, offset = int(limit), int(offset)
    if limit < 1 or offset < 0:
        raise ValueError(f"no such page: limit {limit}, offset {offset}")
    if after is not None:
        found = found.where(F.struct(*PAGE_ORDER) > F.struct(*[F.lit(v) for v in after]))
    return found.orderBy(*PAGE_ORDER).offset(offset).limit(limit)


def search_tables(tables: DataFrame, database: str, query: str) -> DataFrame:
    """Tables of one database whose listed text contains the query."""
    shown = F.lower(F.concat_ws(" ", "schema_name", "table_name", "table_type", "comment"))
    return tables.where((F.col("database") == database) & F.contains(shown, F.lit(query.lower())))


def yes_no(flag: Column) -> Column:
    return F.when(flag, "yes").otherwise("no")


def export_tables(tables: DataFrame, columns: DataFrame) -> DataFrame:
    return column_counts(tables, columns).select(
        *TABLE, "table_type", "comment", "column_count"
    ).orderBy(*TABLE)


def export_columns(columns: DataFrame) -> DataFrame:
    return columns.select(
        *TABLE, "ordinal_position", "name", "data_type", "column_type",
        yes_no(F.col("is_nullable")).alias("nullable"),
        F.coalesce("column_default", F.lit("")).alias("column_default"),
        "comment",
    ).orderBy(*TABLE, "ordinal_position")


def export_indexes(indexes: DataFrame) -> DataFrame:
    return indexes.select(
        *TABLE, "name", index_kind(F.col("is_primary"), F.col("is_unique")).alias("kind"),
        F.array_join("column_names", ", ").alias("columns"), "definition",
    ).orderBy(*TABLE, "name")


def export_constraints(constraints: DataFrame) -> DataFrame:
    return constraints.select(
        *TABLE, "name", "constraint_type", F.array_join("column_names", ", ").alias("columns"),
        "referenced_table", "referenced_column",
    ).orderBy(*TABLE, "name")


def export_dictionary(found: DataFrame) -> DataFrame:
    return found.select(
        "database_name", "db_type", "schema_name", "table_name", "table_comment", "ordinal_position", "name",
        F.coalesce(F.nullif("column_type", F.lit("")), "data_type").alias("type"),
        yes_no(F.col("is_nullable")).alias("nullable"),
        F.coalesce("column_default", F.lit("")).alias("column_default"),
        "comment",
    ).orderBy("database_name", "schema_name", "table_name", "ordinal_position")
