"""Exact document dedup by content-defined chunk recipes (native DataFrame operator).

Every text is cut where its *content* says so (after a line break or a sentence end, 256 to 4,096 characters), so
equal texts are cut alike and long documents that share passages share chunks.  Distinct chunks are brought together
once; a 64-bit chunk identifier is *verified* when no second chunk content carries it.  A document then is its recipe,
the ordered list of chunk identifiers (about one 37th of its characters), and only recipes are grouped, joined and
compared: the long texts themselves do not move again.  Documents that hold a chunk whose identifier is not verified
carry their whole text beside the recipe, so the comparison stays exact.

Defined results: a null text is the empty text; the empty recipe is a value like any other.  Of equal texts the row
with the largest doc_id stays; null ids are never larger than another, and a group of null ids only has a null
``keep_id``.  Rows that repeat the id that stays are all marked kept.  Extra columns are ignored.  An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilebook.llm.common import landed, placed, text_of

#: A chunk: 256 to 4,096 characters up to a line break or sentence end, else 4,096, else the rest.
CHUNK = r"(?s).{255,4095}?(?:\n|[.!?](?=\s))|.{1,4096}"


def chunks_of(text: Column) -> Column:
    """Content-defined chunks of a text, in order; concatenated they give the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def chunk_id(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def unverified_ids(docs: DataFrame, identify=chunk_id) -> DataFrame:
    """Chunk identifiers carried by more than one chunk content."""
    chunks = docs.select(F.explode("chunks").alias("chunk"))
    distinct = chunks.select(identify(F.col("chunk")).alias("id"), "chunk").distinct()
    return distinct.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")


def recipes(docs: DataFrame, identify=chunk_id) -> DataFrame:
    """doc_id, recipe (ordered identifiers), whole (the text where an identifier is unverified, else null), sha256, n_chunks."""
    d = docs.select("doc_id", text_of().alias("text")).withColumn("chunks", chunks_of(F.col("text")))
    doubtful = landed(unverified_ids(d, identify), "chunk-clash")
    r = d.withColumn("recipe", F.transform("chunks", identify))
    whole = F.lit(None).cast("string")
    if not doubtful.isEmpty():
        # Keyed by the text itself: rows without a doubtful chunk keep a null.
        hit = r.select("text", F.explode("recipe").alias("id")).join(doubtful, "id", "left_semi").select("text").distinct()
        r = r.join(hit.withColumn("doubtful", F.lit(True)), "text", "left")
        whole = F.when(F.col("doubtful"), F.col("text"))
    return landed(r.select("doc_id", "recipe", whole.alias("whole"), F.sha2("text", 256).alias("text_sha256")), "recipes")


def exact_groups(docs: DataFrame, identify=chunk_id) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    r = recipes(docs, identify)
    groups = r.groupBy(F.col("recipe").alias("g_recipe"), F.col("whole").alias("g_whole")).agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    same = (F.col("recipe") == F.col("g_recipe")) & F.col("whole").eqNullSafe(F.col("g_whole"))
    return r.join(groups, same, "left").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256", F.size("recipe").alias("n_chunks"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: one row of each group, that of the largest doc_id (null last; of
    rows that repeat it, the last written).  Groups are found by row number, so rows may repeat ids."""
    rows = placed(docs, "__row_no")
    groups = exact_groups(rows.select(F.col("__row_no").alias("doc_id"), "text")).select(F.col("doc_id").alias("__g_row"), "keep_id")
    last = groups.join(rows.select("__row_no", "doc_id"), F.col("__g_row") == F.col("__row_no")).groupBy("keep_id").agg(
        F.max(F.struct("doc_id", "__row_no")).alias("__last"))
    return rows.join(last.select(F.col("__last.__row_no").alias("__keep")), F.col("__row_no") == F.col("__keep"), "left_semi").select(*docs.columns)


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
