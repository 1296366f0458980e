"""The reference's null model, as column functions.

Oracle stores '' as NULL and treats NULL as '' in ``||``; Spark does neither.
These helpers are applied on read and wherever text is concatenated or
optional parameters are compared (P5-P9, F1).
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalise_empty(df: DataFrame) -> DataFrame:
    """'' -> NULL on every string column (one projection, stays in codegen)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, StringType):
            cols.append(empty_to_null(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def ncat(*parts: Column | str) -> Column:
    """Oracle ``a || b``: NULL parts count as ''; all-NULL gives NULL.

    Literal strings are separators.  ``concat_ws`` is not used because it
    drops the separator next to a NULL part.
    """
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    out = F.concat(*[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return empty_to_null(out)


def opt_eq(c: Column, value: Any) -> Column:
    """``c = NVL(:p, c)``: no parameter keeps every row whose c is not null."""
    if value is None:
        return c.isNotNull()
    return c == F.lit(value)


def opt_eq_null(c: Column, value: Any) -> Column:
    """``(c = NVL(:p,c) OR NVL(c,'X..') = NVL(:p,'X..'))``: no parameter keeps all rows."""
    if value is None:
        return F.lit(True)
    return c == F.lit(value)


def ne_or_null(c: Column, value: Any) -> Column:
    """``(c <> v OR c IS NULL)``."""
    return ~c.eqNullSafe(F.lit(value))


def nvl_in(c: Column, default: Any, values: list) -> Column:
    """``NVL(c, default) IN (...)``."""
    return F.coalesce(c, F.lit(default)).isin(*values)
