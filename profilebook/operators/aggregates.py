"""Aggregates that stay skew-safe.

Counts and first/latest picks use partial (map-side) aggregation, so a hot
key costs one row per task before the shuffle.  Text aggregation is the one
operator whose result holds a whole group: its items are gathered in parts and
meet only in the row of their text; no length is capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts in which the items of one text are gathered first.
PARTS = 16


def count_flag(df: DataFrame, where: Column, when_any: str, when_none: str, out: str,
               keys: list[str] | None = None) -> DataFrame:
    """A2/A3: ``CASE WHEN COUNT(*) > 0 THEN a ELSE b END`` (per key or global)."""
    n = F.count(F.when(where, F.lit(1)))
    flag = F.when(n > 0, F.lit(when_any)).otherwise(F.lit(when_none)).alias(out)
    return df.groupBy(*keys).agg(flag) if keys else df.agg(flag)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """One row per key: the one with the greatest ``order`` tuple.

    ``max_by`` over a struct is a partial aggregate: no group is gathered.
    """
    picked = F.max_by(F.struct(*[F.col(v) for v in values]), F.struct(*[F.col(o) for o in order]))
    return df.groupBy(*keys).agg(picked.alias("__pick")).select(
        *keys, *[F.col(f"__pick.{v}").alias(v) for v in values])


def first_per_key(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """One row per key: the smallest ``order`` tuple (J13 'ROWNUM <= 1' made deterministic)."""
    picked = F.min_by(F.struct(*[F.col(v) for v in values]), F.struct(*[F.col(o) for o in order]))
    return df.groupBy(*keys).agg(picked.alias("__pick")).select(
        *keys, *[F.col(f"__pick.{v}").alias(v) for v in values])


def listagg(rows: DataFrame, keys: list[str], item: Column, order: list[Column], sep: str, out: str,
            trailing: bool = False) -> DataFrame:
    """``LISTAGG(item, sep) WITHIN GROUP (ORDER BY order)`` per key, whole, whatever its length.

    Returns ``keys, out``.  Items of a key are first sorted and gathered in ``PARTS`` parts by a hash of the item, so the
    rows of a hot key are read, filtered and sorted by many tasks; the parts then meet in the one row that holds the text,
    which is as long as the text itself.  Null and empty items are skipped; ``trailing`` appends the separator after every
    item (A7).
    """
    names = [f"__o{i}" for i in range(len(order))]
    r = rows.select(*keys, item.cast("string").alias("__t"), *[o.alias(n) for o, n in zip(order, names)]).filter(
        F.col("__t").isNotNull() & (F.length("__t") > 0))
    r = r.select(*keys, F.struct(*names, "__t").alias("__x")).withColumn("__part", F.pmod(F.xxhash64("__x"), F.lit(PARTS)))
    parts = r.groupBy(*keys, "__part").agg(F.sort_array(F.collect_list("__x")).alias("__xs"))
    whole = parts.groupBy(*keys).agg(F.sort_array(F.flatten(F.collect_list("__xs"))).alias("__xs"))
    text = F.array_join(F.transform("__xs", lambda x: x["__t"]), sep)
    return whole.select(*keys, (F.concat(text, F.lit(sep)) if trailing else text).alias(out))
