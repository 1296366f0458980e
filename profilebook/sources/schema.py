"""Schema helpers: projection with renames, schema evolution."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns added to the profile by the reference's two ALTER TABLE scripts (fixed values).
PROFILE_ADDED_COLUMNS = {
    "GROUP_EXPIRATION_MONTH": "int",
    "PROJECT_FINANCE": "string",
    "PROBABILITY_DEFAULT": "decimal(38,10)",
    "LOSS_GIVEN_DEFAULT": "decimal(38,10)",
}


def project(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Select columns under new names (names may contain spaces)."""
    return df.select(*[F.col(src).alias(dst) for src, dst in renames.items()])


def evolve(df: DataFrame, added: dict[str, str]) -> DataFrame:
    """Read data written before ``ALTER TABLE ... ADD`` with the new columns (NULL)."""
    out = df
    for name, dtype in added.items():
        if name not in df.columns:
            out = out.withColumn(name, F.lit(None).cast(dtype))
    return out


class EvolvingTable:
    """S8 on a table of the session's catalog: ``ALTER TABLE ... ADD COLUMNS`` over files that stay as they are.

    Files written before read NULL in the new columns.  The name is dropped on exit; the files stay.
    """

    def __init__(self, spark: SparkSession, rows: DataFrame, path: str):
        self.spark, self.path, self.name = spark, path, f"evolving_{uuid.uuid4().hex}"
        rows.write.parquet(path)

    def __enter__(self) -> EvolvingTable:
        self.spark.catalog.createTable(self.name, self.path, "parquet")
        return self

    def __exit__(self, *_) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")

    def add_columns(self, added: dict[str, str]) -> None:
        cols = ", ".join(f"{n} {t}" for n, t in added.items())
        self.spark.sql(f"ALTER TABLE {self.name} ADD COLUMNS ({cols})")

    def append(self, rows: DataFrame) -> None:
        rows.select(*self.spark.table(self.name).columns).write.mode("append").insertInto(self.name)

    def read(self) -> DataFrame:
        """The whole table: the catalog's schema over all files."""
        return self.spark.read.schema(self.spark.table(self.name).schema).parquet(self.path)
