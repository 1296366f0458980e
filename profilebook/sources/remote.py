"""Reading the core-banking master over JDBC, partitioned.

The reference reads the master through a database link, row by row inside
its routines.  A Spark job reads each master table once, in parallel ranges
of a numeric column, and lands it (see :class:`Catalog`).  No database is
reachable in the test environment, so this reader is not exercised by the
registered queries, which read the landed stand-ins instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_remote(spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int,
                partitions: int, properties: dict | None = None) -> DataFrame:
    """``spark.read.jdbc`` split into ``partitions`` ranges of ``partition_column``."""
    return spark.read.jdbc(url=url, table=table, column=partition_column, lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=properties or {})
