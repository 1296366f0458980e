"""Lookups that tell none, one and several rows apart, and side outputs for what a job rejects.

The reference raises when a scalar read finds several rows and when a text is no date.  A job over all applications must
not fail for one of them, so each guard either raises inside the plan (for the rows that really ask) or hands the row to
a reject table with a reason.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from profilebook.operators.broadcast import bounded_broadcast
from profilebook.session import landed

ROWS_FOUND = "ROWS_FOUND"


def rows_per_key(dim: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per key: the first values in their order and how many rows the key has (a partial aggregate)."""
    d = dim.filter(functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    first = F.min(F.struct(*values)).alias("__v")
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias(ROWS_FOUND), first).select(*keys, ROWS_FOUND, *[F.col(f"__v.{v}").alias(v) for v in values])


def scalar_lookup(fact: DataFrame, fact_key: str, dim: DataFrame, dim_key: str, values: dict[str, str], several: str = "raise") -> DataFrame:
    """``(SELECT v FROM dim WHERE dim_key = fact_key)`` for each row of ``fact``: the columns ``values`` (new name -> column
    of ``dim``) and ROWS_FOUND.

    No row gives NULL.  Several rows fail the job when a fact row asks for such a key (``several="raise"``) or give NULL
    (``"reject"``; see :func:`rejected`).  Null keys find nothing and do not take part in the join.
    """
    one = rows_per_key(dim.select(F.col(dim_key).alias("__k"), *[F.col(c).alias(f"__{n}") for n, c in values.items()]), ["__k"],
                       [f"__{n}" for n in values])
    asked = fact.filter(F.col(fact_key).isNotNull()).join(bounded_broadcast(one), F.col(fact_key) == F.col("__k"), "left")
    found = F.coalesce(F.col(ROWS_FOUND), F.lit(0))
    message = F.concat(F.format_string(f"%d rows of {dim_key} ", found), F.col(fact_key).cast("string"))

    def value(name: str) -> Column:
        v, dtype = F.col(f"__{name}"), one.schema[f"__{name}"].dataType
        many = F.raise_error(message).cast(dtype) if several == "raise" else F.lit(None).cast(dtype)
        return F.when(found > 1, many).otherwise(v).alias(name)
    looked = asked.select(*fact.columns, *[value(n) for n in values], found.alias(ROWS_FOUND))
    nothing = [F.lit(None).cast(one.schema[f"__{n}"].dataType).alias(n) for n in values]
    return looked.unionByName(fact.filter(F.col(fact_key).isNull()).select("*", *nothing, F.lit(0).cast("long").alias(ROWS_FOUND)))


def rejected(looked: DataFrame, key: str, none: bool = False) -> DataFrame:
    """The rows of a :func:`scalar_lookup` whose key has several rows (with ``none`` also those whose key has no row)."""
    bad = F.col(ROWS_FOUND) > 1
    return looked.filter((bad | (F.col(ROWS_FOUND) == 0)) & F.col(key).isNotNull() if none else bad)


def date_fault(text: Column, parsed: Column, shape: str) -> Column:
    """Why ``text`` is no date: FORMAT (not of the ``shape``), CALENDAR (no such day), NULL when it is one or is null."""
    return F.when(text.isNotNull() & parsed.isNull(), F.when(text.rlike(shape), F.lit("CALENDAR")).otherwise(F.lit("FORMAT")))


class Split:
    """Rows without and with faults, and their counts.

    ``faults`` is computed from the columns it is asked for; ``good``, ``read`` and ``rejected`` are those of the whole rows,
    which are written once when the first of them is asked for.
    """

    def __init__(self, found: DataFrame, columns: list[str], faults: dict[str, tuple[Column, str]], name: str):
        self._found, self._columns, self._faults, self._name = found, columns, faults, name

    @functools.cached_property
    def _written(self) -> tuple[DataFrame, dict]:
        bad = functools.reduce(lambda a, b: a | b, [F.col(why).isNotNull() for _, why in self._faults.values()])
        seen = Observation(self._name)
        # marked, not in folders: those would sort the wide rows
        marked = self._found.select(*self._columns, bad.alias("__rejected"))
        marked = marked.observe(seen, F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("__rejected"), 1)).alias("bad"))
        return landed(marked, self._name), seen.get

    @property
    def good(self) -> DataFrame:
        return self._written[0].filter("NOT __rejected").select(*self._columns)

    @property
    def faults(self) -> DataFrame:
        cells = [F.struct(F.lit(label).alias("COLUMN_NAME"), value.cast("string").alias("VALUE"), F.col(why).alias("REASON"))
                 for label, (value, why) in self._faults.items()]
        # filtered behind the explode: a filter of the array would be pushed below it, where every text is parsed again
        return self._found.select(*self._columns, F.explode(F.array(*cells)).alias("__f")).filter("__f.REASON IS NOT NULL").select(
            *self._columns, "__f.*")

    @property
    def read(self) -> int:
        return self._written[1]["n"]

    @property
    def rejected(self) -> int:
        return self._written[1]["bad"]


def split_faults(rows: DataFrame, faults: dict[str, tuple[Column, Column]], name: str) -> Split:
    """Split ``rows`` by ``faults`` (label -> (value, reason or NULL)) in one pass.

    Where the rows are asked for, they are written once, marked as good or rejected, and counted on the way; ``faults`` has a
    row for each fault: the columns of ``rows``, COLUMN_NAME, VALUE, REASON.
    """
    # the reasons in a step of their own: a text is parsed once
    found = rows.withColumns({f"__why_{i}": why for i, (_, why) in enumerate(faults.values())})
    return Split(found, rows.columns, {label: (value, f"__why_{i}") for i, (label, (value, _)) in enumerate(faults.items())}, name)


def column_changes(old: DataFrame, new: DataFrame, on: Column, keys: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Null-safe difference of two wide rows: ``keys``, COLUMN_NAME, OLD_VALUE, NEW_VALUE for each pair (label -> (column of
    ``old``, column of ``new``)) that differs.  One join, then the pairs of a row are unpivoted without a shuffle."""
    o = old.select(F.struct(*[F.col(f"`{a}`").cast("string").alias(f"o{i}") for i, (a, _) in enumerate(pairs.values())]).alias("__old"),
                   *[F.col(f"`{c}`").alias(f"__old_{c}") for c in old.columns])
    n = new.select(F.struct(*[F.col(f"`{b}`").cast("string").alias(f"n{i}") for i, (_, b) in enumerate(pairs.values())]).alias("__new"), "*")
    cells = F.array(*[F.struct(F.lit(label).alias("COLUMN_NAME"), F.col(f"__old.o{i}").alias("OLD_VALUE"), F.col(f"__new.n{i}").alias("NEW_VALUE"))
                      for i, label in enumerate(pairs)])
    j = n.join(o, on).select(*keys, F.explode(F.filter(cells, lambda x: ~x["OLD_VALUE"].eqNullSafe(x["NEW_VALUE"]))).alias("__c"))
    return j.select(*keys, "__c.*")
