"""From raw documents to tokens: language identification, line dedup, near-dedup, source mixing, tokenisation.

Every stage takes the documents the stage before kept, written as Parquet and read again, and returns documents; the
last one returns tokens and each document's place in the mixed order, which the files of the stage before hold.

Whole texts go to Python in batches of ``BATCH`` bytes (set in the session by the stages that send them): the operators work
on pieces of a megabyte anyway, and an executor keeps the buffers of its largest batch, in the JVM and in each Python worker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilebook.llm import langid, linedup, minhash, mixing, spm
from profilebook.llm.common import DOCUMENT_COLUMNS, landed, placed, read

BATCH = "4m"


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language; ``lang`` is the predicted one.  Texts without letters go."""
    small_batches(spark)
    return langid.known(docs).select("doc.doc_id", "doc.text", F.col("lang_pred").alias("lang"), "doc.source", "doc.n_chars")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of 50 words or more go; so do documents that are left without a line by that."""
    d = linedup.dedup_lines(docs).filter(~F.col("emptied"))
    return d.select("doc.doc_id", "text", "doc.lang", "doc.source",
                    F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("doc.n_chars")).alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8 or more)."""
    small_batches(spark)
    return minhash.drop_near(docs, width=5, percent=80).select(*DOCUMENT_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that holds the sources' target weights; parts and rows are written in that order."""
    return mixing.mixed(docs).select(*DOCUMENT_COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document; ``place`` numbers the documents 0, 1, ... in the order the stage before wrote them."""
    small_batches(spark)
    return spm.token_table(placed(docs), keep=["place"])


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup),
          ("mixing sources to target weights", mix_sources), ("SentencePiece encoding and decoding", tokenize)]

#: SQL cannot say what the learned and the tokenising stages compute; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole table ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
