"""Default values of added columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_TEXT = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def default_value(column_default: Column) -> Column:
    """Struct ``kind, value`` of a declared default.

    ``none``: nothing declared, ``null``: an explicit NULL, ``now``: the load time,
    ``number``: a bare number, ``text``: a literal, ``expression``: a function call, which
    is dropped because it cannot be evaluated outside its database.
    """
    text = F.trim(column_default)
    upper = F.upper(text)
    kind = (
        F.when(text.isNull(), "none")
        .when(upper == "NULL", "null")
        .when(upper.startswith("CURRENT_TIMESTAMP"), "now")
        .when(text.rlike(r"\(.*\)"), "expression")
        .when(text.rlike(NUMBER_TEXT), "number")
        .otherwise("text")
    )
    return F.struct(
        kind.alias("kind"), F.when(kind.isin("number", "text"), text).alias("value")
    )
