"""Column types across database dialects, as expressions over a column catalog.

Every expression reads the descriptor columns ``data_type``, ``column_type``,
``max_length``, ``numeric_precision`` and ``numeric_scale``, so one projection maps
a catalog of any size without a join.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.functions.values import positive_or

# Source kinds folded into the dialect that names their types.
DIALECT_OF = {
    "mysql": "mysql",
    "oceanbase": "mysql",
    "postgresql": "postgresql",
    "gaussdb": "postgresql",
    "dws": "postgresql",
    "opengauss": "postgresql",
    "oracle": "oracle",
}
MAX_VARCHAR = 65533
MAX_PRECISION = 38
UNKNOWN_TYPE = "STRING"

# Source type name -> analytical store type.
STORE_TYPES = {
    "mysql": {
        "tinyint": "TINYINT",
        "smallint": "SMALLINT",
        "mediumint": "INT",
        "int": "INT",
        "integer": "INT",
        "bigint": "BIGINT",
        "float": "FLOAT",
        "double": "DOUBLE",
        "date": "DATE",
        "bool": "BOOLEAN",
        "boolean": "BOOLEAN",
        "json": "JSON",
    },
    "postgresql": {
        "smallint": "SMALLINT",
        "int2": "SMALLINT",
        "integer": "INT",
        "int4": "INT",
        "bigint": "BIGINT",
        "int8": "BIGINT",
        "boolean": "BOOLEAN",
        "bool": "BOOLEAN",
        "real": "FLOAT",
        "double precision": "DOUBLE",
        "float8": "DOUBLE",
        "date": "DATE",
        "timestamp without time zone": "DATETIME",
        "timestamp with time zone": "DATETIME",
        "timestamp": "DATETIME",
        "json": "JSON",
        "jsonb": "JSON",
    },
    "oracle": {
        "float": "DOUBLE",
        "binary_double": "DOUBLE",
        "binary_float": "FLOAT",
        "date": "DATE",
        "timestamp": "DATETIME",
        "boolean": "BOOLEAN",
    },
}

# Source type name -> Hive type.
HIVE_TYPES = {
    "mysql": {
        "tinyint": "TINYINT",
        "smallint": "SMALLINT",
        "mediumint": "INT",
        "int": "INT",
        "integer": "INT",
        "bigint": "BIGINT",
        "float": "FLOAT",
        "double": "DOUBLE",
        "date": "DATE",
        "datetime": "TIMESTAMP",
        "timestamp": "TIMESTAMP",
        "binary": "BINARY",
        "varbinary": "BINARY",
        "blob": "BINARY",
        "tinyblob": "BINARY",
        "mediumblob": "BINARY",
        "longblob": "BINARY",
    },
    "postgresql": {
        "smallint": "SMALLINT",
        "int2": "SMALLINT",
        "integer": "INT",
        "int4": "INT",
        "bigint": "BIGINT",
        "int8": "BIGINT",
        "boolean": "BOOLEAN",
        "bool": "BOOLEAN",
        "real": "FLOAT",
        "double precision": "DOUBLE",
        "float8": "DOUBLE",
        "date": "DATE",
    },
    "oracle": {
        "float": "DOUBLE",
        "binary_double": "DOUBLE",
        "binary_float": "FLOAT",
        "date": "DATE",
        "timestamp": "TIMESTAMP",
        "boolean": "BOOLEAN",
    },
}

# Source type name -> change stream type, per change format.
CHANGE_TYPES = {
    "debezium": {
        "smallint": "SMALLINT",
        "int2": "SMALLINT",
        "integer": "INT",
        "int4": "INT",
        "bigint": "BIGINT",
        "int8": "BIGINT",
        "boolean": "BOOLEAN",
        "bool": "BOOLEAN",
        "date": "DATE",
    },
    "canal": {
        "tinyint": "TINYINT",
        "smallint": "SMALLINT",
        "mediumint": "INT",
        "int": "INT",
        "integer": "INT",
        "bigint": "BIGINT",
        "float": "FLOAT",
        "double": "DOUBLE",
        "date": "DATE",
    },
}

# Integer types whose display width is ignored.
INTEGER_TYPES = ["tinyint", "smallint", "mediumint", "int", "integer", "bigint"]


def _name() -> Column:
    return F.lower(F.coalesce(F.col("data_type"), F.lit("")))


def _text() -> Column:
    return F.lower(F.coalesce(F.col("column_type"), F.lit("")))


def _lookup(table: dict[str, str]) -> Column:
    """NULL where the name is not listed."""
    pairs = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), _name())


def _decimal(precision: Column, scale: Column, pattern: str = "DECIMAL(%d,%d)") -> Column:
    return F.format_string(pattern, precision, scale)


def _sized(base: str, length: Column) -> Column:
    return F.concat(F.lit(f"{base}("), length.cast("string"), F.lit(")"))


def _bounded_varchar() -> Column:
    length = F.col("max_length")
    return F.when((length > 0) & (length <= MAX_VARCHAR), _sized("VARCHAR", length)).otherwise(UNKNOWN_TYPE)


def _scale_or_zero() -> Column:
    return F.coalesce(F.col("numeric_scale").cast("int"), F.lit(0))


def _number_has_precision() -> Column:
    """Oracle NUMBER keeps a precision only when its text is empty or spells one out."""
    text = F.upper(_text())
    return ((text == "") | text.startswith("NUMBER(")) & F.col("numeric_precision").isNotNull()


def _mysql_store() -> Column:
    fraction = F.regexp_extract(_text(), r"^datetime\((\d+)\)$", 1)
    return (
        F.when((_name() == "tinyint") & _text().isin("tinyint(1)", "tinyint(1) unsigned"), "BOOLEAN")
        .when(
            _name().isin("decimal", "numeric"),
            _decimal(positive_or(F.col("numeric_precision"), 10), _scale_or_zero()),
        )
        .when(_name() == "char", _sized("CHAR", positive_or(F.col("max_length"), 1)))
        .when(_name() == "varchar", _sized("VARCHAR", positive_or(F.col("max_length"), 255)))
        .when(
            _name().isin("datetime", "timestamp"),
            F.when(fraction != "", _sized("DATETIME", fraction)).otherwise("DATETIME"),
        )
        .otherwise(_lookup(STORE_TYPES["mysql"]))
    )


def _postgresql_store() -> Column:
    precision = F.col("numeric_precision").cast("int")
    return (
        F.when(
            _name().isin("numeric", "decimal") & precision.isNotNull(),
            _decimal(F.least(precision, F.lit(MAX_PRECISION)), _scale_or_zero()),
        )
        .when(_name().isin("character varying", "varchar"), _bounded_varchar())
        .when(_name().isin("character", "char"), _sized("CHAR", positive_or(F.col("max_length"), 1)))
        .otherwise(_lookup(STORE_TYPES["postgresql"]))
    )


def _oracle_store() -> Column:
    return (
        F.when(
            _name() == "number",
            F.when(
                _number_has_precision(), _decimal(F.col("numeric_precision").cast("int"), _scale_or_zero())
            ).otherwise("DOUBLE"),
        )
        .when(_name().isin("varchar2", "nvarchar2"), _bounded_varchar())
        .when(_name().isin("char", "nchar"), _sized("CHAR", positive_or(F.col("max_length"), 1)))
        .otherwise(_lookup(STORE_TYPES["oracle"]))
    )


def _mysql_hive() -> Column:
    return (
        F.when((_name() == "tinyint") & _text().startswith("tinyint(1)"), "BOOLEAN")
        .when(
            _name().isin("decimal", "numeric"),
            _decimal(positive_or(F.col("numeric_precision"), 10), _scale_or_zero()),
        )
        .otherwise(_lookup(HIVE_TYPES["mysql"]))
    )


def _postgresql_hive() -> Column:
    return (
        F.when(
            _name().isin("numeric", "decimal") & F.col("numeric_precision").isNotNull(),
            _decimal(positive_or(F.col("numeric_precision"), 10), _scale_or_zero()),
        )
        .when(_name().contains("timestamp"), "TIMESTAMP")
        .otherwise(_lookup(HIVE_TYPES["postgresql"]))
    )


def _oracle_hive() -> Column:
    precision = F.col("numeric_precision").cast("int")
    return F.when(
        _name() == "number",
        F.when(_number_has_precision() & (precision != 0), _decimal(precision, _scale_or_zero())).otherwise(
            "DOUBLE"
        ),
    ).otherwise(_lookup(HIVE_TYPES["oracle"]))


_STORE = {"mysql": _mysql_store, "postgresql": _postgresql_store, "oracle": _oracle_store}
_HIVE = {"mysql": _mysql_hive, "postgresql": _postgresql_hive, "oracle": _oracle_hive}


def dialect_of(source_type: str) -> str:
    return DIALECT_OF.get(source_type, "mysql")


def store_type(source_type: str) -> Column:
    """Analytical store type of a source column."""
    return F.coalesce(_STORE[dialect_of(source_type)](), F.lit(UNKNOWN_TYPE))


def hive_type(source_type: str) -> Column:
    """Hive type of a source column."""
    return F.coalesce(_HIVE[dialect_of(source_type)](), F.lit(UNKNOWN_TYPE))


def _by_row(source_type: Column, builders: dict) -> Column:
    """Choose the dialect per row where one catalog holds several source kinds."""
    kinds = {d: [k for k, v in DIALECT_OF.items() if v == d] for d in builders}
    return F.coalesce(
        F.when(source_type.isin(kinds["postgresql"]), builders["postgresql"]())
        .when(source_type.isin(kinds["oracle"]), builders["oracle"]())
        .otherwise(builders["mysql"]()),
        F.lit(UNKNOWN_TYPE),
    )


def store_type_by_row(source_type: Column) -> Column:
    return _by_row(source_type, _STORE)


def hive_type_by_row(source_type: Column) -> Column:
    return _by_row(source_type, _HIVE)


def change_types(change_format: str) -> Column:
    """Struct ``read_type, write_type, local_time`` of a column in a change stream.

    Debezium carries decimals as text and instants in UTC, so both are read loosely and
    shaped on write; Canal cells are cast to the declared type at once.
    """
    if change_format == "debezium":
        is_decimal = _name().isin("numeric", "decimal")
        is_instant = _name().contains("timestamp")
        decimal_type = _decimal(
            positive_or(F.col("numeric_precision"), 10),
            F.coalesce(F.col("numeric_scale").cast("int"), F.lit(2)),
            "DECIMAL(%d, %d)",
        )
        plain = F.coalesce(_lookup(CHANGE_TYPES["debezium"]), F.lit(UNKNOWN_TYPE))
        return F.struct(
            F.when(is_instant, "TIMESTAMP_LTZ(6)").otherwise(plain).alias("read_type"),
            F.when(is_decimal, decimal_type).when(is_instant, "STRING").otherwise(plain).alias("write_type"),
            (is_instant & ~is_decimal).alias("local_time"),
        )
    if change_format == "canal":
        decimal_type = _decimal(
            positive_or(F.col("numeric_precision"), 10), _scale_or_zero(), "DECIMAL(%d, %d)"
        )
        plain = (
            F.when((_name() == "tinyint") & _text().startswith("tinyint(1)"), "BOOLEAN")
            .when(_name().isin("decimal", "numeric"), decimal_type)
            .otherwise(F.coalesce(_lookup(CHANGE_TYPES["canal"]), F.lit(UNKNOWN_TYPE)))
        )
        return F.struct(plain.alias("read_type"), plain.alias("write_type"), F.lit(False).alias("local_time"))
    raise ValueError(f"unknown change format: {change_format}")


def normalise_type(text: Column) -> Column:
    """Type text without case, blanks and integer display width; tinyint(1) is boolean."""
    squeezed = F.replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit(" "), F.lit(""))
    base = F.regexp_replace(squeezed, r"\(\d+\)$", "")
    return (
        F.when(squeezed.isin("bool", "boolean") | squeezed.startswith("tinyint(1)"), "boolean")
        .when(base.isin(INTEGER_TYPES), base)
        .otherwise(squeezed)
    )


def squeeze_type(text: Column) -> Column:
    """Lower case without blanks: the form in which mapped and actual types are compared."""
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit(" "), F.lit(""))
