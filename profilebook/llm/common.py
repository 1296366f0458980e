"""Small helpers shared by the operators: shared scratch tables, label folds, row views."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from profilebook.session import ensure_checkpoint_dir

#: The columns of ``documents``; pipeline stages return exactly these.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, any executor can read it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, name: str = "place") -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in the order its rows were written (part number, row within the file).

    Spark reads files packed by size, so the order is taken from the files themselves.  A frame that is not a plain read
    of Parquet files is landed first; ``_metadata`` below a query would tell the place in that query's input.
    """
    if df._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        df = landed(df, "placed")
    rows = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    sizes = rows.groupBy("__file").agg(F.count("*").alias("__n"))
    part = F.regexp_extract("__file", r"part-(\d+)-[^/]*$", 1).try_cast("long")
    # One row per file: the window and the broadcast are bounded by the number of files.
    before = sizes.select(F.col("__file").alias("__of"), (F.sum("__n").over(Window.orderBy(part, "__file")) - F.col("__n")).alias("__before"))
    return rows.join(F.broadcast(before), F.col("__file") == F.col("__of")).select(*df.columns, (F.col("__before") + F.col("__row")).alias(name))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def local_frame(spark: SparkSession, rows: list, schema: StructType) -> DataFrame:
    """A few rows of the driver as a frame.  They go as an Arrow table: a list of rows would pass through Python workers of
    their own kind, which stay beside those of the operators in the memory of every executor."""
    columns = [list(c) for c in zip(*rows)] or [[] for _ in schema]
    return spark.createDataFrame(pa.table(columns, names=schema.names), schema)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def text_of(column: str = "text") -> Column:
    """The text, a null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def sample_bound(n: int, limit: int) -> int:
    """Rows whose 62-bit hash is below this are about nine tenths of ``limit`` of ``n`` rows, whatever ``n``."""
    return (9 * limit << 62) // (10 * n)


def _hash62(key: str, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 2)


def bounded_sample(df: DataFrame, key: str, limit: int, seed: int = 17) -> DataFrame:
    """At most ``limit`` rows, chosen by a hash of ``key``: the same rows whatever the partitioning.

    Used only to fit classifiers.  Up to the limit every row is taken; above it a hash share that stays below the limit
    (the final ``limit`` only states the bound).
    """
    n = df.count()
    if n <= limit:
        return df
    return df.filter(_hash62(key, seed) < F.lit(sample_bound(n, limit))).limit(limit)


def shares(sizes: dict, limit: int) -> dict:
    """How many rows each group may give: all of a small group, the same number of every larger one, ``limit`` together."""
    out, left = {}, limit
    for k, (group, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], str(x[0])))):
        out[group] = min(n, left // (len(sizes) - k))
        left -= out[group]
    return out


def even_sample(df: DataFrame, key: str, group: str, limit: int, most_groups: int = 200, seed: int = 17) -> DataFrame:
    """At most ``limit`` rows, as evenly as may be from the groups (the ``most_groups`` largest), chosen by a hash of ``key``."""
    sizes = {r[0]: r["n"] for r in df.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(most_groups).collect()}
    if not sizes:
        return df
    given = shares(sizes, limit)
    rows = [(g, 1 << 62 if given[g] == n else sample_bound(n, given[g])) for g, n in sizes.items() if given[g]]
    bounds = local_frame(df.sparkSession, rows, df.select(F.col(group).alias("__group")).schema.add("__bound", "long"))
    hit = df.join(F.broadcast(bounds), F.col(group) == F.col("__group"))  # at most ``most_groups`` rows
    return hit.filter(_hash62(key, seed) < F.col("__bound")).select(*df.columns).limit(limit)
