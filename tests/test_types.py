from pyspark.sql import functions as F

from tidegate.functions import typemap, values
from tidegate.operators.catalog import COLUMNS_DDL

FIELDS = "data_type string, column_type string, max_length int, numeric_precision int, numeric_scale int"


def mapped(spark, source, rows):
    df = spark.createDataFrame(rows, FIELDS)
    return [r[0] for r in df.select(typemap.store_type(source)).collect()]


def test_store_types(spark):
    assert mapped(
        spark, "mysql",
        [("int", "int(11)", None, 10, 0), ("tinyint", "tinyint(1)", None, 3, 0),
         ("varchar", "varchar(255)", 255, None, None), ("decimal", "decimal(10,2)", None, 10, 2),
         ("datetime", "datetime(3)", None, None, None), (None, None, None, None, None)],
    ) == ["INT", "BOOLEAN", "VARCHAR(255)", "DECIMAL(10,2)", "DATETIME(3)", "STRING"]
    assert mapped(
        spark, "gaussdb",
        [("numeric", "numeric", None, 10, 2), ("character varying", "varchar", 255, None, None),
         ("timestamp with time zone", "timestamptz", None, None, None)],
    ) == ["DECIMAL(10,2)", "VARCHAR(255)", "DATETIME"]
    assert mapped(
        spark, "oracle",
        [("number", "NUMBER(10,2)", None, 10, 2), ("number", "NUMBER", None, None, None),
         ("varchar2", "VARCHAR2(100)", 100, None, None), ("timestamp", "TIMESTAMP", None, None, None)],
    ) == ["DECIMAL(10,2)", "DOUBLE", "VARCHAR(100)", "DATETIME"]


def test_catalog_layout_parses(spark):
    assert len(spark.createDataFrame([], COLUMNS_DDL).columns) == 13


def test_normalised_and_guard(spark):
    texts = spark.createDataFrame([("int(11)",), ("tinyint(1)",), ("BOOLEAN",), ("decimal(10, 2)",)], "t string")
    assert [r[0] for r in texts.select(typemap.normalise_type(F.col("t"))).collect()] == [
        "int", "boolean", "boolean", "decimal(10,2)",
    ]
    numbers = spark.createDataFrame([("1.5",), ("12",), ("-1.5",), ("1e3",), (" 3",), (None,)], "t string")
    assert [r[0] for r in numbers.select(values.is_unsigned_number(F.col("t"))).collect()] == [
        True, True, False, False, False, False,
    ]


def test_days_and_local_time(spark):
    assert values.day_bounds_ms("2026-09-01", "Asia/Shanghai") == (1788192000000, 1788278400000)
    # the day the clocks go forward has 23 hours
    start, end = values.day_bounds_ms("2024-03-31", "Europe/Berlin")
    assert end - start == 23 * 3600 * 1000
    text = spark.range(1).select(values.local_time(F.lit("2026-08-29T11:35:34.080617Z").cast("timestamp"))).first()[0]
    assert text == "2026-08-29 19:35:34.080617"


def test_identifier():
    import pytest

    assert values.check_identifier("a_1$") == "a_1$"
    for bad in ("a-b", "a;b", "", "a b", "a\n"):
        with pytest.raises(ValueError):
            values.check_identifier(bad)
