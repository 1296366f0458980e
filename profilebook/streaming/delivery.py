"""Deliver a table as a stream of files, out of order and with re-sent files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deliver(events: DataFrame, source_dir: str, key: str, parts: int = 4, resend: int = 1) -> None:
    """Write ``events`` as ``parts`` files in hash order of ``key`` (so event
    times arrive out of order across micro-batches), then re-send the first
    ``resend`` parts as extra files (duplicates)."""
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(parts))
    for i in list(range(parts)) + list(range(resend)):
        events.filter(bucket == i).coalesce(1).write.mode("append").parquet(source_dir)
