"""Document fingerprints: bottom-k sketches of word-shingle hashes (native DataFrame operator).

A text's shingles are its runs of five words (white space separates words; the sequence is led by four empty places, so
every word ends one shingle and short texts have shingles too).  Each shingle is hashed to 48 bits and the sketch is the
k smallest distinct hashes in ascending order.  The sketch of a union is the k smallest of the two sketches, so sketches
of parts merge; from sketches alone follow resemblance (share of the union's bottom k found in both), containment and
the number of distinct shingles.

Defined results: a null text is the empty text; a text without words has an empty sketch, written as the empty string.
Two empty sketches are alike (1.0), an empty and a non-empty one are not (0.0).  Rows with the same doc_id follow each
other in the order of a hash of their texts; a null doc_id comes first.  The last document is followed by the first; a
single document is followed by itself.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilebook.llm.common import text_of

WIDTH = 5
K = 128
HASH_BITS = 48
#: Characters of text that one order bucket is meant to hold, and the most buckets (their starts pass the driver).
BUCKET_CHARS, MAX_BUCKETS = 4_000_000, 4096


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Distinct 48-bit hashes of the word shingles of a text (array of long)."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    led = F.concat(F.array_repeat(F.lit(0).cast("long"), width - 1), hashes)

    def runs(a: Column) -> Column:
        last = F.size(a) - width
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.shiftrightunsigned(
            F.xxhash64(*[F.get(a, i + j) for j in range(width)]), 64 - HASH_BITS))).otherwise(F.array().cast("array<bigint>"))

    # A one-element transform names the led array, so that it is computed once and not at each use.
    inner = F.transform(F.array(led), runs)
    return F.array_distinct(F.get(inner, F.lit(0)))


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The k smallest distinct shingle hashes, ascending."""
    return F.slice(F.sort_array(shingle_hashes(text, width)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches cover."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1."""
    union = merge(a, b, k)
    both = F.array_intersect(union, F.array_intersect(a, b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(both) / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    kth = (F.element_at(a, -1) + 1) / F.lit(float(2 ** HASH_BITS))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles found in b, 0 to 1 (an empty a is contained)."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def merge_parts(parts: DataFrame, key: str, sketch_col: str, k: int = K) -> DataFrame:
    """Merge any number of part sketches per key: distinct hashes, then the k smallest (limited before the shuffle)."""
    rows = parts.select(F.col(key).alias("_key"), F.explode_outer(sketch_col).alias("_h")).distinct()
    low = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy(F.col("_h").asc_nulls_last()))).filter(F.col("_r") <= k)
    return low.groupBy(F.col("_key").alias(key)).agg(F.sort_array(F.collect_list("_h")).alias(sketch_col))


def encode(a: Column) -> Column:
    """A sketch as text: twelve hexadecimal digits per hash."""
    return F.concat_ws("", F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), HASH_BITS // 4, "0")))


def decode(s: Column) -> Column:
    """The sketch written by :func:`encode`."""
    digits = HASH_BITS // 4
    parts = F.regexp_extract_all(s, F.lit(f"[0-9a-f]{{{digits}}}"), F.lit(0))
    return F.transform(parts, lambda x: F.conv(x, 16, 10).cast("long"))


def with_follower(docs: DataFrame, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """doc_id, text, sketch, next_text, next_sketch: each row beside the next by doc_id, the last beside the first.

    The ids are cut into ranges of about ``bucket_chars`` characters; a range's first document is also dealt to the
    range before it (the very first to the last), so the follower is always in the same range and one shuffle of the
    texts by range is enough: no window spans the table.
    """
    low = F.lit(-(2 ** 63)).cast("long")
    d = docs.select("doc_id", text_of().alias("text"), F.coalesce(F.col("doc_id").cast("long"), low).alias("_key"))
    chars, first = d.agg(F.sum(F.length("text")), F.min("_key")).first()
    n = max(1, min(MAX_BUCKETS, int((chars or 0) // bucket_chars)))
    cuts = d.agg(F.percentile_approx("_key", [i / n for i in range(1, n)], 50_000)).first()[0] if n > 1 else []
    starts = sorted({first if first is not None else 0, *(cuts or [])})
    last = len(starts) - 1
    bounds = F.array(*[F.lit(x).cast("long") for x in starts])
    at = F.size(F.filter(bounds, lambda x: x <= F.col("_key"))) - 1
    place = lambda bucket, lent: F.struct(bucket.cast("int").alias("bucket"), F.lit(lent).alias("lent"))
    d = d.withColumn("_at", at).withColumn("_starts", F.array_contains(bounds, F.col("_key")))
    dealt = F.when(F.col("_starts") & (F.col("_at") == 0), F.array(place(F.col("_at"), 0), place(F.lit(last), 2))).when(
        F.col("_starts"), F.array(place(F.col("_at"), 0), place(F.col("_at") - 1, 1))).otherwise(F.array(place(F.col("_at"), 0)))
    rows = d.select("doc_id", "text", "_key", F.explode(dealt).alias("_p")).select("doc_id", "text", "_key", "_p.bucket", "_p.lent")
    rows = rows.repartition("bucket").withColumn("sketch", sketch(F.col("text")))
    w = Window.partitionBy("bucket").orderBy("lent", "_key", F.xxhash64("text"))
    rows = rows.select("doc_id", "text", "sketch", "lent", F.lead("text").over(w).alias("next_text"), F.lead("sketch").over(w).alias("next_sketch"))
    return rows.filter("lent = 0").drop("lent")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text, with their likeness and that to the next document."""
    d = with_follower(docs)
    n = F.char_length("text")
    moved = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - moved), F.substring(F.col("next_text"), F.lit(1), moved))
    d = d.withColumn("n_chars", n.cast("long")).withColumn("edited", edited).drop("text", "next_text")
    d = d.withColumn("edited_sketch", sketch(F.col("edited")))
    return d.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), encode(F.col("sketch")).alias("fingerprint"),
        encode(F.col("edited_sketch")).alias("edited_fingerprint"), resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"), distinct_shingles(F.col("sketch")).alias("shingles_estimate"))
