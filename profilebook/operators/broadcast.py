"""Broadcast only behind a checked size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Code lists in the reference are small; anything above this stays a shuffle
# join (AQE may still convert it at runtime from measured shuffle sizes).
DEFAULT_MAX_ROWS = 200_000

_decisions: dict[tuple, bool] = {}


def _plan_key(df: DataFrame, max_rows: int) -> tuple:
    """Logical plan + the files it reads: a table rewritten in place (new
    files) is checked again instead of reusing an earlier verdict."""
    return df.semanticHash(), hash(tuple(sorted(df.inputFiles()))), max_rows


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast only if it provably holds <= ``max_rows`` rows.

    The check reads at most ``max_rows + 1`` rows (the limit is pushed into the
    scan) and its answer is remembered per logical plan, so a code list used
    in several roles is checked once.
    """
    key = _plan_key(df, max_rows)
    if key not in _decisions:
        _decisions[key] = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if _decisions[key] else df


_unique: dict[tuple, tuple[bool, bool]] = {}


def bounded_profile(df: DataFrame, keys: list[str], max_rows: int = DEFAULT_MAX_ROWS) -> tuple[bool, bool]:
    """(small, unique-on-keys) for a dimension, from one bounded job.

    Reads at most ``max_rows + 1`` rows; ``unique`` is only claimed for a
    small dimension (then the counts are exact).
    """
    key = _plan_key(df, max_rows) + (tuple(keys),)
    if key not in _unique:
        r = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"),
                                       F.count_distinct(F.struct(*[F.col(k) for k in keys])).alias("d")).collect()[0]
        small = r["n"] <= max_rows
        _unique[key] = (small, small and r["n"] == r["d"])
    return _unique[key]
