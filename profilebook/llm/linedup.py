"""Line dedup: repeated runs of lines found by a suffix array over line ids (native DataFrame operator).

Every document is a sequence of line ids (blank lines left out, ids are two 64-bit hashes).  The suffixes of all
sequences are ranked by distributed prefix doubling: level 0 ranks a suffix by its first line, level k+1 by the pair
(rank of its first 2^k lines, rank of the 2^k lines behind them).  A rank is the number of smaller entries of the suffix
array, so suffixes with one rank are one longest-common-prefix interval of at least 2^k lines; only suffixes whose
prefix occurs twice go to the next level.  The interval of any depth between two levels is named by the two overlapping
ranks that span it.  A run that is repeated goes when it has at least ``min_words`` words, so the depth that decides a
line is that of a *smallest* run with so many words that begins or ends at it: at most ``min_words`` lines, so the
levels end there whatever the length of the copies, and a longer maximal run is the union of its smallest runs.  Within
each interval the first copy, by (doc_id, hash of text, line), stays and the lines of later copies go.

Hot lines: ranks are formed from counted pairs, never from a line's occurrences in one task, and the counted pairs
behind one rank are summed in chunks of the second rank.

Defined results: a null or empty text has no lines and is left as it is.  Lines are equal when identical; words are
what blanks (U+0020) separate.  Blank lines are kept, unless no other line is left.  A document all of whose lines go
is ``emptied``.  Rows that repeat both id and text are one document and get the same text.  A null id comes before
every id.  Extra columns are kept, names may clash.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilebook.llm.common import landed, text_of

MIN_WORDS = 50
#: Second ranks are summed in chunks of 2^20 values.
CHUNK_BITS = 20
DOC = ["doc_id", "th"]


def _words(line: Column) -> Column:
    return F.size(F.array_remove(F.split(line, " "), ""))


def line_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Non-blank lines: doc_id, th (hash of the text), i (1, 2, ...), a, b (line id), ahead, back (lines of the smallest
    run of ``min_words`` words that begins, ends here; null where there is none)."""
    d = docs.select("doc_id", text_of().alias("text")).filter(F.col("text") != "")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(
        i.alias("ln"), _words(x).alias("words"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    d = d.select("doc_id", F.xxhash64("text").alias("th"), F.filter(lines, lambda x: x["words"] > 0).alias("lines"))
    rows = d.dropDuplicates(DOC).select(*DOC, F.explode("lines").alias("x")).select(*DOC, "x.*")
    own = Window.partitionBy(*DOC)
    rows = rows.withColumn("i", F.row_number().over(own.orderBy("ln"))).withColumn("end", F.sum("words").over(own.orderBy("ln")))
    rows = rows.withColumn("begin", F.col("end") - F.col("words")).withColumn("total", F.sum("words").over(own))
    ahead = F.count("*").over(own.orderBy("begin").rangeBetween(0, min_words - 1))
    back = F.count("*").over(own.orderBy("end").rangeBetween(-(min_words - 1), 0))
    return rows.select(*DOC, "i", "a", "b", F.when(F.col("total") - F.col("begin") >= min_words, ahead).cast("int").alias("ahead"),
                       F.when(F.col("end") >= min_words, back).cast("int").alias("back"))


def _first_ranks(lines: DataFrame) -> DataFrame:
    """Rank of each line id that occurs twice or more: 1 + the occurrences of smaller ids."""
    ids = lines.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").withColumn("part", F.shiftright("a", 52))
    before = ids.groupBy("part").agg(F.sum("n").alias("n")).select(  # at most 4,096 rows
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("a", "b")) - F.col("n")
    return ids.withColumn("inside", inside).join(before, "part").select("a", "b", (1 + F.col("before") + F.col("inside")).alias("r"))


def _pair_ranks(pairs: DataFrame) -> DataFrame:
    """Rank of each pair (r, r2) that occurs twice or more: r + the occurrences of r with a smaller r2."""
    ids = pairs.groupBy("r", "r2").agg(F.count("*").alias("n")).filter("n > 1").withColumn("chunk", F.shiftright("r2", CHUNK_BITS))
    before = ids.groupBy("r", "chunk").agg(F.sum("n").alias("n")).select(
        "r", "chunk", (F.sum("n").over(Window.partitionBy("r").orderBy("chunk")) - F.col("n")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("r", "chunk").orderBy("r2")) - F.col("n")
    return ids.withColumn("inside", inside).join(before, ["r", "chunk"]).select(
        "r", "r2", (F.col("r") + F.col("before") + F.col("inside")).alias("next_r"))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[f"_{k}"])
    return cond


def _marked(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"_{c}" for c in df.columns])


def suffix_levels(lines: DataFrame, depth: int) -> DataFrame:
    """k, doc_id, th, i, r: for each level up to ``depth`` lines, the suffixes whose first 2^k lines occur twice or more."""
    level = landed(lines.join(_first_ranks(lines), ["a", "b"]).select(F.lit(0).alias("k"), *DOC, "i", "r"), "lines-level")
    levels, k = level, 0
    while 2 ** (k + 1) <= depth and not level.isEmpty():
        behind = Window.partitionBy(*DOC).orderBy("i").rangeBetween(2 ** k, 2 ** k)
        pairs = level.withColumn("r2", F.min("r").over(behind)).filter(F.col("r2").isNotNull())
        k += 1
        level = landed(pairs.join(_pair_ranks(pairs), ["r", "r2"]).select(F.lit(k).alias("k"), *DOC, "i", F.col("next_r").alias("r")), "lines-level")
        levels = levels.unionByName(level)
    return levels


def later_copies(lines: DataFrame) -> DataFrame:
    """doc_id, th, i of the lines in a later copy of a repeated run."""
    depth = lines.agg(F.greatest(F.max("ahead"), F.max("back"))).first()[0] or 0
    levels = _marked(suffix_levels(lines, depth))
    starts = lines.filter("ahead is not null").select(*DOC, "i", F.col("ahead").alias("n"))
    ends = lines.filter("back is not null").select(*DOC, (F.col("i") - F.col("back") + 1).alias("i"), F.col("back").alias("n"))
    runs = starts.unionByName(ends).distinct().withColumn("k", F.floor(F.log2("n")).cast("int"))
    runs = runs.join(levels, _null_safe(runs, levels, ["k", *DOC, "i"])).select(*DOC, "k", "n", F.col("i").alias("s"), F.col("_r").alias("r1"),
                                                                             (F.col("i") + F.col("n") - F.pow(F.lit(2), F.col("k")).cast("int")).alias("i"))
    runs = runs.join(levels, _null_safe(runs, levels, ["k", *DOC, "i"])).select(F.struct(*DOC, "s").alias("at"), "n", "r1", F.col("_r").alias("r2"))
    runs = landed(runs, "runs")
    first = runs.groupBy("n", "r1", "r2").agg(F.min("at").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    later = runs.join(first, ["n", "r1", "r2"]).filter(~F.col("at").eqNullSafe(F.col("first")))
    return later.select("at.doc_id", "at.th", F.explode(F.sequence(F.col("at.s"), F.col("at.s") + F.col("n") - 1)).alias("i")).distinct()


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc (the row as it came), text (without later copies), n_lines, n_removed, emptied."""
    lines = landed(line_table(docs, min_words), "lines")
    gone = later_copies(lines).groupBy(*DOC).agg(F.collect_list("i").alias("gone")).toDF("_doc_id", "_th", "_gone")
    d = docs.select(F.struct("*").alias("doc"))
    d = d.withColumn("_t", F.coalesce("doc.text", F.lit(""))).withColumn("_h", F.xxhash64("_t"))
    d = d.join(gone, F.col("doc.doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_h") == F.col("_th")), "left")
    split = F.split("_t", "\n")
    flagged = F.transform(F.col("_split"), lambda x, j: F.struct(j.alias("j"), (F.trim(x) != "").alias("full")))
    d = d.withColumn("_split", split).withColumn("_full", F.transform(F.filter(flagged, lambda x: x["full"]), lambda x: x["j"]))
    left = F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), F.transform("_gone", lambda i: F.get(F.col("_full"), i - 1)))
    text = F.when(F.size("_gone") == F.size("_full"), F.lit("")).otherwise(F.array_join(F.transform(left, lambda j: F.get(F.col("_split"), j)), "\n"))
    return d.select("doc", F.when(F.col("_gone").isNull(), F.col("doc.text")).otherwise(text).alias("text"), F.size("_full").alias("n_lines"),
                    F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).alias("n_removed"),
                    F.coalesce(F.size("_gone") == F.size("_full"), F.lit(False)).alias("emptied"))


#: The same result written with line lists: every smallest run as text, grouped by its text.
ORACLE = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln
           FROM documents WHERE text <> ''),
n AS (SELECT *, len(list_filter(string_split(line, ' '), lambda x: x <> '')) AS words FROM l),
o AS (SELECT doc_id, line, ln, words, row_number() OVER d AS i, sum(words) OVER d AS done FROM n WHERE words > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY ln)),
w AS (SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM o a JOIN o b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + {w} AND b.done - a.done + a.words >= {w} GROUP BY a.doc_id, a.i
      UNION SELECT b.doc_id, max(a.i), b.i FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.i BETWEEN b.i - {w} AND b.i AND b.done - a.done + a.words >= {w} GROUP BY b.doc_id, b.i),
t AS (SELECT w.doc_id, s, e, string_agg(line, chr(10) ORDER BY i) AS run FROM w JOIN o ON o.doc_id = w.doc_id AND o.i BETWEEN s AND e GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS copy FROM t),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, e)) AS i FROM f WHERE copy > 1),
k AS (SELECT n.doc_id, count(o.i) AS n_lines, count(gone.i) AS n_removed,
             string_agg(n.line, chr(10) ORDER BY n.ln) FILTER (WHERE gone.i IS NULL) AS kept_text
      FROM n LEFT JOIN o ON o.doc_id = n.doc_id AND o.ln = n.ln LEFT JOIN gone ON gone.doc_id = n.doc_id AND gone.i = o.i GROUP BY n.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_removed, 0) > 0 AND n_removed = n_lines AS emptied,
       CASE WHEN coalesce(n_removed, 0) = 0 THEN d.text WHEN n_removed = n_lines THEN '' ELSE kept_text END AS text
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
""".format(w=MIN_WORDS)
