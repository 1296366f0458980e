"""Grouping of spelling variants: words one edit apart, found by a bit-sliced position index.

Words are runs of Latin letters, lower-cased (A-Z only); one run in 97, drawn by a hash of document and run, loses a letter,
so that the corpus holds known misspellings.  The vocabulary is every result of at least ``LEAST_LETTERS`` letters that
occurs at least ``LEAST_COUNT`` times.

Near words.  A block's words are the bits of whole numbers; the index has one such bitset for every (position, letter).  A
word runs through it letter by letter with four sets: words equal so far, and words one replaced, one extra or one missing
letter away, which are compared at the same, the next and the previous position.  Each step is a few word-parallel operations
on all words of the block at once.

Blocks.  Two words one edit apart agree outside the place of the edit.  Seen from the shorter one (length m), a block is a hole
[from, to) that holds the edit and the letters around it; the hole starts as either half of the word.  While a block has more
than ``MOST_WORDS`` words its hole is halved: its words are dealt to the two finer blocks.  A hole of one letter holds at most
one word for every letter and pair of letters (90 + 90 x 90 words), so blocks are bounded whatever the vocabulary, and nothing is
left out.  Each pair is found once: in the block whose hole holds the first letter where the two words differ.

Form and root.  A word's form is its near word of largest count (ties: smallest in code-point order) if that count is at least
twice its own; counts at least double along forms, so the chain ends, and doubling steps find its last word.

Defined results: a null text has no words; a null doc_id counts as the empty text in the hash.  Repeated rows count like any
others.  Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilebook.llm.common import landed
from profilebook.llm.merkle import CRC_TABLE, crc_sql
from profilebook.llm.words import pieces

LEAST_LETTERS = 5
LEAST_COUNT = 3
MISSPELT = 97
#: Words of a block, unless the hole is one letter; above 90 + 90 * 90.
MOST_WORDS = 8_192
#: Over-full blocks whose keys are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 10_000
RUN = "[A-Za-zÀ-ÿ]+"


def text_words(doc_id, text: str) -> Counter:
    """The words of one text with their counts, after the drawn deletions."""
    out: Counter = Counter()
    # Of bytes, lower() changes A to Z only.
    for run, n in Counter(re.findall(RUN, text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
        h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
        if h % MISSPELT == 0:
            run = run[:(k := h % len(run))] + run[k + 1:]
        out[run] += n
    return out


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word, n."""

    def count(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                own: Counter = Counter()
                for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                    if text:
                        own.update(text_words(doc_id, text))
                own = {w: n for w, n in own.items() if len(w) >= LEAST_LETTERS}
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["word", "n"])

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def with_hole(lo: Column, hi: Column) -> Column:
    """The key of the block with hole [lo, hi): shorter length, hole and the letters around it."""
    extra = F.char_length("word") - F.col("m")
    around = F.concat(F.substring("word", F.lit(1), lo), F.substring("word", hi + extra + 1, F.char_length("word")))
    return F.struct(F.col("m").alias("m"), lo.alias("lo"), hi.alias("hi"), around.alias("around"))


def first_blocks(words: DataFrame) -> DataFrame:
    """word, n, m, block: either half of the word as the hole, as the shorter and as the longer of a pair."""
    size = F.char_length("word")
    d = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).filter(F.col("m") >= LEAST_LETTERS)
    half = F.floor(F.col("m") / 2).cast("int")
    return d.select("*", F.explode(F.array(with_hole(F.lit(0), half), with_hole(half, F.col("m")))).alias("block"))


def bounded_blocks(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """The blocks, over-full ones with their holes halved until they are not."""
    todo, done = first_blocks(words), None
    while True:
        full = landed(todo.groupBy("block").agg(F.count("*").alias("size")).filter(
            (F.col("size") > most) & (F.col("block.hi") - F.col("block.lo") > 1)).select(F.col("block").alias("f_block")), "full-blocks")
        k = full.limit(MOST_BROADCAST + 1).count()
        if k == 0:
            return todo if done is None else done.unionByName(todo)
        f = F.broadcast(full) if k <= MOST_BROADCAST else full
        fine = todo.join(f, F.col("block") == F.col("f_block"), "left_anti")
        done = fine if done is None else done.unionByName(fine)
        lo, hi = F.col("block.lo"), F.col("block.hi")
        mid = F.floor((lo + hi) / 2).cast("int")
        parts = F.explode(F.array(with_hole(lo, mid), with_hole(mid, hi)))
        todo = landed(todo.join(f, F.col("block") == F.col("f_block"), "left_semi").select("word", "n", "m", parts.alias("block")), "finer-blocks")


def near_sets(holes: list[str], width: int, last: bool):
    """For each word of a block the bitset of the words one edit away whose first difference lies in the hole.

    ``holes``: the words' letters in the hole, ``width`` or ``width + 1`` of them (words of the shorter and the longer length);
    ``last``: the hole ends with the shorter word, so a letter may be added behind it."""
    index: list[dict[str, int]] = [{} for _ in range(width + 2)]
    short = 0
    for k, hole in enumerate(holes):
        bit = 1 << k
        if len(hole) == width:
            short |= bit
        for p, letter in enumerate(hole):
            index[p][letter] = index[p].get(letter, 0) | bit
    every = (1 << len(holes)) - 1
    long = every & ~short
    for hole in holes:
        same, replaced, more, less = every, 0, 0, 0
        for p, letter in enumerate(hole):
            here = index[p].get(letter, 0)
            left = same & ~here if p < width or last else 0
            same &= here
            replaced = replaced & here | left
            after = index[p + 1].get(letter, 0)
            more = more & after | left & after
            less = (less & index[p - 1].get(letter, 0) if p else 0) | left
            if not (same or replaced or more or less):
                break
        if len(hole) == width:
            yield replaced & short | (more | (same if last else 0)) & long
        else:
            yield less & short


def block_hits(batches):
    """For the words of each block that have near words there: their number and the best."""
    for batch in batches:
        out: list[tuple[str, int, int, str]] = []
        members = batch.column("members")
        ends, flat = members.offsets.to_pylist(), members.values
        for block, begin, end in zip(batch.column("block").to_pylist(), ends, ends[1:]):
            m, lo, hi = block["m"], block["lo"], block["hi"]
            words, counts = (flat.field(k).slice(begin, end - begin).to_pylist() for k in (0, 1))
            holes = [w[lo:hi + len(w) - m] for w in words]
            for word, found in zip(words, near_sets(holes, hi - lo, hi == m)):
                if found:
                    near = []
                    while found:
                        near.append((found & -found).bit_length() - 1)
                        found &= found - 1
                    best = min(near, key=lambda k: (-counts[k], words[k]))
                    out.append((word, len(near), counts[best], words[best]))
        columns = list(zip(*out)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                         names=["h_word", "found", "best_n", "best"])


def near_words(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """h_word, n_near, best_n, best of every word with a near word."""
    blocks = bounded_blocks(words, most).groupBy("block").agg(F.collect_list(F.struct("word", "n")).alias("members"), F.count("*").alias("size"))
    hits = blocks.filter("size > 1").select("block", "members").mapInArrow(block_hits, "h_word string, found long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return hits.groupBy("h_word").agg(F.sum("found").alias("n_near"), best.alias("best")).select(
        "h_word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """r_word, root: the last word along the forms (word, form) of each word that has one."""
    now = landed(forms.select(F.col("word").alias("r_word"), F.col("form").alias("root")), "roots")
    while True:
        far = now.select(F.col("r_word").alias("f_word"), F.col("root").alias("f_root"))
        step = landed(now.join(far, F.col("root") == F.col("f_word"), "left").select(
            "r_word", F.coalesce("f_root", "root").alias("root"), F.col("f_root").isNotNull().alias("moved")), "roots")
        now = step.drop("moved")
        if step.filter("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """One row per vocabulary word: word, form, root, n, n_near, form_n."""
    words = landed(vocabulary(docs), "vocabulary")
    form = F.col("best_n") >= 2 * F.col("n")
    formed = landed(words.join(near_words(words, most), F.col("word") == F.col("h_word"), "left").select(
        "word", F.when(form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(form, F.col("best_n")).alias("form_n")), "forms")
    own = roots(formed.filter("form is not null"))
    return formed.join(own, F.col("word") == F.col("r_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: Near words by the words' deletions (pairs that share one), replaced letters by equal place.
ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
  run AS (
    SELECT doc_id, run, count(*) AS k
    FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
          FROM documents) GROUP BY doc_id, run),
  drawn AS (SELECT run, k, {crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM run, crc_table),
  word AS (
    SELECT word, sum(k)::BIGINT AS n
    FROM (SELECT CASE WHEN h % {MISSPELT} = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, k FROM drawn)
    WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
  gap AS (SELECT word, n, p, word[1:p - 1] || word[p + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM word)),
  near AS (
    SELECT a.word, b.word AS other, b.n FROM gap a JOIN gap b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM gap a JOIN word b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM gap a JOIN word b ON a.rest = b.word),
  best AS (SELECT word, count(*) AS n_near, max(n) AS best_n, arg_min(other, (-n, other)) AS best FROM near GROUP BY word),
  formed AS (
    SELECT word, CASE WHEN best_n >= 2 * n THEN best END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n
    FROM word LEFT JOIN best USING (word)),
  chain AS (
    SELECT word, word AS at, form FROM formed
    UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.form)
SELECT f.word, f.form, c.at AS root, n, n_near, form_n FROM formed f JOIN chain c ON c.word = f.word AND c.form IS NULL
"""
