"""Table lineage from a corpus of SQL files, with built-in text functions only.

A statement writes the table of its INSERT INTO or CREATE TABLE … AS SELECT and reads every
table after FROM or JOIN, up to the first filter, grouping or ordering clause. The extended rule reads the whole
statement, its words one by one: lists of tables, sub-queries at any place, common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.values import computed_once

# What a name, a target, a source and the end of the sources look like.
NAME = r"""(?:`[^`]+`|"[^"]+"|[A-Za-z_][A-Za-z0-9_$]*)"""
QUALIFIED = rf"{NAME}(?:\.{NAME})*"
INSERT_TARGET = rf"(?i)INSERT\s+(?:IGNORE\s+)?INTO\s+({QUALIFIED})"
CREATE_TARGET = rf"(?i)CREATE\s+(?:EXTERNAL\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?({QUALIFIED})\s+AS\s+SELECT"
FROM_TAIL = r"(?is)\bFROM\s+.*"
SOURCE = rf"(?i)(?:FROM|JOIN)\s+({QUALIFIED})"
STOP = r"(?i)\b(?:WHERE|GROUP|ORDER|LIMIT|HAVING|QUALIFY)\b"
IGNORED_SOURCES = ["dual"]

# The extended rule also reads INSERT OVERWRITE and the optional word TABLE.
EXTENDED_INSERT_TARGET = rf"(?i)INSERT\s+(?:IGNORE\s+)?(?:INTO|OVERWRITE)\s+(?:TABLE\s+)?({QUALIFIED})"
EXTENDED_CREATE_TARGET = (
    rf"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?(?:EXTERNAL\s+)?(?:TABLE|VIEW)\s+(?:IF\s+NOT\s+EXISTS\s+)?({QUALIFIED})\s+AS\s*(?:SELECT|WITH|\()"
)
# Words of a statement: texts, names, parentheses and commas. The rest says nothing about tables.
WORD = rf"'[^'\\]*+(?:\\.[^'\\]*+)*+'|{QUALIFIED}|[(),]"
# Where a list of tables ends, what may stand before a table, and calls in which FROM names none.
LIST_ENDS = ["WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "QUALIFY", "WINDOW", "UNION", "INTERSECT", "EXCEPT", "SELECT", "SET", "VALUES"]
BEFORE_TABLE = ["LATERAL", "ONLY", "TABLE"]
FROM_CALLS = ["EXTRACT", "SUBSTRING", "TRIM", "OVERLAY", "POSITION"]
CTE_NAME = rf"(?i)(?:\bWITH\s+|,\s*)({NAME})\s+AS\s*\("
COMMENT = r"--[^\n]*|/\*[\s\S]*?\*/"

# Quoted text and comments, inside which a semicolon ends nothing.
OPAQUE = r"""'[^'\\]*(?:\\.[^'\\]*)*'|"[^"]*"|`[^`]*`|--[^\n]*|/\*[\s\S]*?\*/"""
MARK = "\u0001"


def statements(sql: Column) -> Column:
    """Split at semicolons outside quotes and comments.

    Every opaque piece and every real separator gets a mark; only a separator has the mark
    right before its semicolon. One linear pass, safe for texts of any length.
    """
    marked = F.regexp_replace(sql, rf"({OPAQUE})|(;)", f"$1{MARK}$2")
    return F.transform(F.split(marked, f"{MARK};"), lambda s: F.replace(s, F.lit(MARK), F.lit("")))


def _plain(name: Column) -> Column:
    return F.translate(name, '`"', "")


def _read(words: Column) -> Column:
    """Tables that the words of a statement read, in order.

    A fold with a stack, one entry for each open parenthesis: ``table`` where a table is expected, ``list`` after one,
    ``call`` within a call that has a FROM of its own, else ``none``.
    """
    state = F.struct(
        F.array(F.lit("none")).alias("stack"), F.array().cast("array<string>").alias("found"), F.lit("").alias("last"),
        F.lit(False).alias("named"),
    )

    def step(s: Column, word: Column) -> Column:
        upper, top, below = F.upper(word), F.element_at(s["stack"], -1), F.slice(s["stack"], 1, F.size(s["stack"]) - 1)
        here = lambda kind: F.array_append(below, F.lit(kind))
        within = lambda stack, kind: F.array_append(stack, F.lit(kind))
        is_table = (top == "table") & ~word.startswith("'") & ~upper.isin(*BEFORE_TABLE, *LIST_ENDS, "(", ")", ",", "FROM", "JOIN")
        stack = (
            F.when((word == "(") & s["named"], within(s["stack"], "call"))  # what looked like a table is a function
            .when((word == "(") & (top == "table"), within(here("list"), "table"))
            .when((word == "(") & s["last"].isin(FROM_CALLS), within(s["stack"], "call"))
            .when(word == "(", within(s["stack"], "none"))
            .when((word == ")") & (F.size(s["stack"]) > 1), below)
            .when((word == ",") & (top == "list"), here("table"))
            .when(upper.isin("FROM", "JOIN") & (top != "call") & (s["last"] != "DISTINCT"), here("table"))
            .when(upper.isin(LIST_ENDS) & (top != "call"), here("none"))
            .when(is_table, here("list"))
            .otherwise(s["stack"])
        )
        found = (
            F.when((word == "(") & s["named"], F.slice(s["found"], 1, F.size(s["found"]) - 1))
            .when(is_table, F.array_append(s["found"], _plain(word)))
            .otherwise(s["found"])
        )
        return F.struct(stack.alias("stack"), found.alias("found"), upper.alias("last"), is_table.alias("named"))

    return F.aggregate(words, state, step, lambda s: s["found"])


def extract(corpus: DataFrame, extended: bool = False) -> DataFrame:
    """Edges per statement: ``path, statement, source_position, source_table, target_table``."""
    sql = F.coalesce(F.col("sql"), F.lit(""))
    split = corpus.select("path", F.posexplode(statements(sql)).alias("statement", "text"))
    if extended:
        # texts stay, comments outside them go
        split = split.withColumn("text", F.regexp_replace("text", rf"('[^'\\]*+(?:\\.[^'\\]*+)*+')|{COMMENT}", "$1 "))
    # each step is computed once a statement, and sources only where there is a target
    split = computed_once(split, _inserted=F.regexp_extract("text", EXTENDED_INSERT_TARGET if extended else INSERT_TARGET, 1))
    created = F.regexp_extract("text", EXTENDED_CREATE_TARGET if extended else CREATE_TARGET, 1)
    target = F.when(F.col("_inserted") != "", F.col("_inserted")).otherwise(created)
    writing = computed_once(split, target_table=_plain(target)).where(F.col("target_table") != "")
    if extended:
        found = _read(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    else:
        segment = F.element_at(F.split(F.regexp_extract("text", FROM_TAIL, 0), STOP, 2), 1)
        found = F.transform(F.regexp_extract_all(segment, F.lit(SOURCE), F.lit(1)), _plain)
    sources = F.filter(F.array_distinct(found), lambda n: ~F.lower(n).isin(IGNORED_SOURCES))
    if extended:
        ctes = F.transform(F.regexp_extract_all("text", F.lit(CTE_NAME), F.lit(1)), _plain)
        sources = F.array_except(sources, ctes)
    return computed_once(writing, sources=sources).select(
        "path", "statement", "target_table", F.posexplode("sources").alias("source_position", "source_table")
    )


def edges(extracted: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Unique (source, target, file) edges by target and source; with ``known``, only those not stored yet.

    The order costs nothing where an aggregate follows: the optimizer drops it there.
    """
    unique = extracted.select("source_table", "target_table", F.col("path").alias("sql_file")).distinct()
    if known is not None:
        unique = unique.join(known, ["source_table", "target_table", "sql_file"], "left_anti")
    return unique.orderBy("target_table", "source_table", "sql_file")


def nodes(edge_rows: DataFrame) -> DataFrame:
    """Every table that is read or written, by name."""
    both = F.array("source_table", "target_table")
    return edge_rows.select(F.explode(both).alias("table_name")).distinct().orderBy("table_name")


def by_target(edge_rows: DataFrame) -> DataFrame:
    """Edges under their target: one row per source with the files that state it counted.

    One row per source, not one list per target: a target fed by very many tables stays many
    small rows.
    """
    return edge_rows.groupBy("target_table", "source_table").agg(F.count("*").alias("files"))


def target_totals(edge_rows: DataFrame) -> DataFrame:
    """Per target: edges and distinct sources, in two combining steps."""
    return by_target(edge_rows).groupBy("target_table").agg(
        F.sum("files").alias("edges"), F.count("*").alias("sources")
    )


def graph_totals(edge_rows: DataFrame) -> DataFrame:
    """Size of the graph, edges and tables, in one pass over the edges."""
    ends = edge_rows.select(F.posexplode(F.array("source_table", "target_table")).alias("end", "table_name"))
    per_table = ends.groupBy("table_name").agg(F.count_if(F.col("end") == 0).alias("leaving"))
    return per_table.agg(F.coalesce(F.sum("leaving"), F.lit(0)).alias("edges"), F.count("*").alias("nodes"))
