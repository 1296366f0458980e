"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation, connected components.

1. Every text's distinct word shingles are hashed (64 bits).  Texts with one shingle set are one *class* (its smallest
   doc_id stands for it), so copies are never paired with each other.
2. A class has ``BANDS * ROWS`` MinHash samples.  Bands of ``ROWS`` samples are hashed to buckets; two sets of
   similarity 0.8 share no bucket with probability (1 - 0.8^5)^40, about 1 in 10^7.
3. The samples are also folded into an odd sketch: each (sample number, value) flips one of 512 bits.  The population
   count of the XOR of two sketches estimates a high similarity precisely; a pair far below the threshold is dropped
   there, all others are confirmed on their full shingle sets.
4. First every member of a bucket is paired with one leader of the bucket.  The links found give components; buckets
   whose members all fell into one component are done.  In the others a new leader is drawn, ``ROUNDS`` times in all, and
   paired with the members outside its component.  Buckets that still hold several components are compared in full:
   their members get a finer odd sketch (``FINE_SAMPLES`` samples), and every pair of members of different components is
   held against each other by size and fine sketch, in blocks of about ``BLOCK`` members, so no bucket meets in one task.
   A pair that shares several buckets is compared in the bucket of its first common band.  Pairs that the fine sketch
   leaves are confirmed on their full shingle sets.  There is no cap on partners or buckets.
5. Confirmed links of all rounds give the components by smallest-label propagation.

Defined results: a null text is the empty text; a text without words has no shingles, is linked with nothing and stays.
A null doc_id counts as one that is smaller than all others.  Rows that share a doc_id are judged each by its own text;
where two of them stand for their shingle sets, these sets count as linked.  Extra columns are kept, names may clash.  An empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilebook.llm.words import MULT, mix, pieces, shingles, split_words, word_hashes
from profilebook.llm.common import landed, placed
from profilebook.llm.components import components

BANDS, ROWS = 40, 5
ROUNDS = 2
SKETCH_BITS = 512
BLOCK = 1024
#: A pair whose sketches say less than this is not a link of similarity 0.8 (more than five standard errors).
SKETCH_FLOOR = 0.6
#: Finer sketches for the buckets that stay open; their floor lies about five standard errors below 0.8 as well.
FINE_SAMPLES, FINE_BITS, FINE_FLOOR = 2048, 4096, 0.75
#: Bits of the bitmap of hashed ids that picks texts; in words of 64 it has 262,144 rows at most.
PICK_BITS = 2 ** 24
NO_ID = -(2 ** 63)

_RNG = np.random.RandomState(20240501)
_MULT = (_RNG.randint(0, 2 ** 31, BANDS * ROWS).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_XOR = _RNG.randint(0, 2 ** 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_FINE_MULT = (_RNG.randint(0, 2 ** 31, FINE_SAMPLES).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_FINE_XOR = _RNG.randint(0, 2 ** 32, FINE_SAMPLES, dtype=np.uint64).astype(np.uint32)


def key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def samples(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MinHash samples, one row for each non-empty set; ``values`` are the sets' hashes one after the other."""
    full = counts > 0
    starts = np.concatenate([[0], np.cumsum(counts[full])])[:-1]
    out = np.empty((len(starts), len(_MULT)), dtype=np.uint32)
    if len(starts):
        high = (values >> np.uint64(32)).astype(np.uint32)
        scratch = np.empty_like(high)
        for j, (a, x) in enumerate(zip(_MULT, _XOR)):
            np.bitwise_xor(high, x, out=scratch)
            np.multiply(scratch, a, out=scratch)
            out[:, j] = np.minimum.reduceat(scratch, starts)
    return out


def band_keys(sample: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band."""
    with np.errstate(over="ignore"):
        out = np.empty((len(sample), BANDS), dtype=np.uint64)
        for b in range(BANDS):
            x = np.full(len(sample), (b + 1) * MULT[1] & (2 ** 64 - 1), dtype=np.uint64)
            for r in range(ROWS):
                x = mix(x + sample[:, b * ROWS + r].astype(np.uint64) + np.uint64(MULT[2]))
            out[:, b] = x
    return out.astype(np.int64)


def odd_sketches(sample: np.ndarray) -> np.ndarray:
    """Parity bitmaps (uint8, SKETCH_BITS / 8 per set): bit h(j, value) is flipped for every sample j."""
    with np.errstate(over="ignore"):
        j = (np.arange(sample.shape[1], dtype=np.uint64) + np.uint64(1)) * np.uint64(MULT[3])
        bit = (mix(sample.astype(np.uint64) + j[None, :]) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flat = bit + np.arange(len(sample), dtype=np.int64)[:, None] * SKETCH_BITS
    count = np.bincount(flat.ravel(), minlength=len(sample) * SKETCH_BITS).reshape(len(sample), SKETCH_BITS)
    return np.packbits((count & 1).astype(np.uint8), axis=1)


def estimate(flipped: np.ndarray, bits: int = SKETCH_BITS, drawn: int = BANDS * ROWS) -> np.ndarray:
    """Similarity from the population count of the XOR of two odd sketches of ``drawn`` samples."""
    share = np.minimum(2.0 * flipped / bits, 1 - 1e-9)
    return np.maximum(0.0, 1 + bits / (4.0 * drawn) * np.log1p(-share))


_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def signature_table(docs: DataFrame, width: int, lower: bool) -> DataFrame:
    """doc_id (null as NO_ID), n, d1, d2 (128-bit digest of the shingle set), bands, sketch (null without shingles)."""
    schema = "doc_id long, n long, d1 long, d2 long, bands array<long>, sketch binary"
    arrow = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def sign(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                flat, counts = split_words(batch.column("text"), lower)
                values, n = shingles(word_hashes(flat), counts, width)
                full = n > 0
                starts = np.concatenate([[0], np.cumsum(n[full])])[:-1]
                d = np.zeros((2, len(n)), dtype=np.uint64)
                bands, sketch = [None] * len(n), [None] * len(n)
                if len(starts):
                    with np.errstate(over="ignore"):
                        for k in range(2):
                            d[k, full] = mix(np.add.reduceat(mix(values + np.uint64(MULT[4 + k])), starts) + n[full].astype(np.uint64))
                    sample = samples(values, n)
                    for i, b, s in zip(np.flatnonzero(full), band_keys(sample), odd_sketches(sample)):
                        bands[i], sketch[i] = b, s.tobytes()
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array(n), pa.array(d[0].astype(np.int64)), pa.array(d[1].astype(np.int64)),
                    pa.array(bands, type=pa.list_(pa.int64())), pa.array(sketch, type=pa.binary())], schema=arrow)

    return docs.select(key().alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(sign, schema)


def shingle_sets(docs: DataFrame, width: int, lower: bool) -> DataFrame:
    """doc_id, items: the sorted distinct shingle hashes."""
    arrow = pa.schema([("doc_id", pa.int64()), ("items", pa.list_(pa.int64()))])

    def sets(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                flat, counts = split_words(batch.column("text"), lower)
                values, n = shingles(word_hashes(flat), counts, width)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(_signed(values, n)))], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(sets, "doc_id long, items array<long>")


def _signed(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The hashes as signed numbers, ascending within each set again."""
    out = values.view(np.int64)
    return out[np.lexsort((out, np.repeat(np.arange(len(counts)), counts)))]


def picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of the documents whose id is in ``ids`` (doc_id), and of few others whose id has the same hash.

    The ids become a bitmap of PICK_BITS, whose bounded number of words is broadcast, so no text is shuffled to be picked.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(PICK_BITS))
    words = ids.select(place.alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    rows = docs.select(key().alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("at", place)
    rows = rows.join(F.broadcast(words), F.shiftright("at", 6) == F.col("word"))
    return rows.filter("bits & shiftleft(1L, cast(at % 64 as int)) <> 0").select("doc_id", "text")


def near_by_sketch(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (u, v) whose odd sketches do not rule a link out."""
    side = lambda c: classes.select(F.col("rep").alias(c), F.col("sketch").alias(f"s_{c}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    arrow = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def test(batches):
        for b in batches:
            if b.num_rows:
                a, c = (np.frombuffer(b"".join(b.column(k).to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1) for k in ("s_u", "s_v"))
                near = pa.array(estimate(_POP[a ^ c].sum(axis=1, dtype=np.int64)) >= SKETCH_FLOOR)
                yield pa.RecordBatch.from_arrays([b.column("u").filter(near), b.column("v").filter(near)], schema=arrow)

    return both.select("u", "v", "s_u", "s_v").mapInArrow(test, "u long, v long").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, lower: bool, percent: int) -> DataFrame:
    """Those pairs (u, v) with 100 * intersection >= percent * union on the full shingle sets."""
    ids = pairs.select(F.col("u").alias("doc_id")).union(pairs.select(F.col("v").alias("doc_id"))).distinct()
    sets = landed(shingle_sets(picked(docs, ids), width, lower), "shingle-sets")
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("items").alias(f"i_{c}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    common = F.size(F.array_intersect("i_u", "i_v"))
    union = F.size("i_u") + F.size("i_v") - common
    return both.filter((100 * common >= percent * union) & (common > 0)).select("u", "v").distinct()


def star_pairs(buckets: DataFrame, labels: DataFrame | None, classes: DataFrame, turn: int, percent: int) -> DataFrame:
    """(u, v): a leader of each bucket, drawn anew in every turn, and its members outside the leader's component whose
    sizes allow a link."""
    named = buckets.withColumn("component", F.col("rep"))
    if labels is not None:
        named = buckets.join(labels, F.col("rep") == F.col("node"), "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    draw = F.struct((F.col("rep") if turn == 0 else F.xxhash64("rep", F.lit(turn))).alias("o"), F.col("rep").alias("r"), F.col("component").alias("c"))
    leaders = named.groupBy("bucket").agg(F.min(draw).alias("leader"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    pairs = named.join(leaders.select("bucket", "leader"), "bucket").filter(F.col("component") != F.col("leader.c"))
    pairs = pairs.select(F.least("rep", "leader.r").alias("u"), F.greatest("rep", "leader.r").alias("v")).distinct()
    size = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"))
    both = pairs.join(size("u"), "u").join(size("v"), "v")
    return both.filter(100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")).select("u", "v").distinct()


def fine_sketches(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Odd sketches of FINE_BITS over FINE_SAMPLES MinHash samples, one row for each non-empty set; a sample is folded in
    as soon as it is drawn, so only the bitmaps are held."""
    full = counts > 0
    starts = np.concatenate([[0], np.cumsum(counts[full])])[:-1]
    parity = np.zeros((len(starts), FINE_BITS), dtype=np.uint8)
    if len(starts):
        row = np.arange(len(starts))
        high = (values >> np.uint64(32)).astype(np.uint32)
        scratch = np.empty_like(high)
        with np.errstate(over="ignore"):
            for j, (a, x) in enumerate(zip(_FINE_MULT, _FINE_XOR)):
                np.bitwise_xor(high, x, out=scratch)
                np.multiply(scratch, a, out=scratch)
                least = np.minimum.reduceat(scratch, starts).astype(np.uint64)
                parity[row, (mix(least + np.uint64(j + 1) * np.uint64(MULT[3])) % np.uint64(FINE_BITS)).astype(np.int64)] ^= 1
    return np.packbits(parity, axis=1)


def fine_table(docs: DataFrame, width: int, lower: bool) -> DataFrame:
    """s_rep, fine: the fine odd sketch of each text (texts without words have none)."""
    arrow = pa.schema([("s_rep", pa.int64()), ("fine", pa.binary())])

    def sign(batches):
        for whole in batches:
            for batch in pieces(whole, "text", 500_000):
                flat, counts = split_words(batch.column("text"), lower)
                values, n = shingles(word_hashes(flat), counts, width)
                ids = batch.column("doc_id").filter(pa.array(n > 0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes() for x in fine_sketches(values, n)], type=pa.binary())], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(sign, "s_rep long, fine binary")


def rest_links(buckets: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, width: int, lower: bool, percent: int) -> DataFrame:
    """Confirmed links between members of different components in buckets that hold several components.

    A bucket of n members is dealt to blocks of about BLOCK members; a task compares the fine sketches of two blocks.
    """
    named = buckets.join(labels, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep")).drop("node")
    several = named.groupBy("bucket").agg(F.count("*").alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    rows = landed(named.join(several.select("bucket", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), "bucket"), "rest-rows")
    ids = rows.select(F.col("rep").alias("doc_id")).distinct()
    fine = fine_table(picked(docs, ids), width, lower)
    known = landed(classes.select(F.col("rep").alias("c_rep"), "n", "bands").join(fine, F.col("c_rep") == F.col("s_rep")).drop("s_rep"), "fine")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    own = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("lo"), F.greatest(o, F.col("block")).alias("hi")))
    rows = rows.select("bucket", "rep", "component", "block", F.explode(own).alias("p")).select("bucket", "rep", "component", "block", "p.lo", "p.hi")
    rows = rows.join(known, F.col("rep") == F.col("c_rep")).select("bucket", "lo", "hi", "block", "rep", "component", "n", "bands", "fine")
    arrow = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(batches):
        # The rows of a group (two blocks) come one after the other; the last group of a batch waits for the next batch.
        held = []
        for batch in batches:
            ids = [batch.column(c).to_numpy() for c in ("bucket", "lo", "hi")]
            cuts = (np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1).tolist()
            for begin, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(begin, end - begin)
                same = [held[0].column(c)[0].as_py() == part.column(c)[0].as_py() for c in ("bucket", "lo", "hi")] if held and part.num_rows else [True]
                if not all(same):
                    yield from_group(pa.Table.from_batches(held))
                    held = []
                if part.num_rows:
                    held.append(part)
        if held:
            yield from_group(pa.Table.from_batches(held))

    def from_group(table):
        table = table.combine_chunks()
        bucket, lo, hi = (table.column(c)[0].as_py() for c in ("bucket", "lo", "hi"))
        block, rep, component, size = (table.column(c).to_numpy() for c in ("block", "rep", "component", "n"))
        bits = np.frombuffer(b"".join(table.column("fine").to_pylist()), dtype=np.uint64).reshape(table.num_rows, -1)
        bands = np.stack(table.column("bands").combine_chunks().to_numpy(zero_copy_only=False))
        right = np.flatnonzero(block == hi)
        us, vs = [], []
        for i in np.flatnonzero(block == lo):
            ok = (component[right] != component[i]) & (100 * np.minimum(size[right], size[i]) >= percent * np.maximum(size[right], size[i]))
            if lo == hi:
                ok &= rep[right] > rep[i]
            at = right[ok]
            if len(at):
                flipped = np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1, dtype=np.int64)
                at = at[estimate(flipped, FINE_BITS, FINE_SAMPLES) >= FINE_FLOOR]
            if len(at):
                common = bands[at] == bands[i]
                at = at[bands[i][common.argmax(axis=1)] == bucket]
                us.append(np.minimum(rep[at], rep[i]))
                vs.append(np.maximum(rep[at], rep[i]))
        both = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (us, vs)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in both], schema=arrow)

    pairs = rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInArrow(compare, "u long, v long").distinct()
    return confirmed(landed(pairs, "rest-pairs"), docs, width, lower, percent)


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, class_size (rows with the same shingle set)."""
    signed = landed(signature_table(docs, width, lower), "signatures")
    classes = landed(signed.filter("n > 0").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("class_size"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    members = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi").select("bucket")
    buckets = landed(members.join(shared, "bucket"), "buckets")
    links, labels, tried = None, None, None
    for turn in range(ROUNDS):
        pairs = landed(star_pairs(buckets, labels, classes, turn, percent), "star-pairs")
        if tried is not None:
            pairs = landed(pairs.join(tried, ["u", "v"], "left_anti"), "star-pairs")
        if pairs.isEmpty():
            labels = labels or components(pairs)
            links = pairs if links is None else links
            continue
        tried = pairs if tried is None else tried.union(pairs)
        found = landed(confirmed(landed(near_by_sketch(pairs, classes), "near-pairs"), docs, width, lower, percent), "links")
        links = found if links is None else links.union(found)
        labels = components(links)
    rest = landed(rest_links(buckets, labels, classes, docs, width, lower, percent), "links")
    if not rest.isEmpty():
        labels = components(links.union(rest))
    found = classes.join(labels, F.col("rep") == F.col("node"), "left").select(
        F.col("d1").alias("c1"), F.col("d2").alias("c2"), "class_size", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n", "d1", "d2").join(found, (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")) & (F.col("n") > 0), "left")
    component = F.coalesce("component", "doc_id")
    shown = lambda c: F.when(c != NO_ID, c)
    return out.select(shown(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), shown(component).alias("component_id"),
                      (component == F.col("doc_id")).alias("kept"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def drop_near(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, with all their columns: one row of each group, that of the smallest doc_id (null first; of
    rows that repeat it, the first written).  Groups are found by row number, so rows may repeat ids."""
    rows = placed(docs, "__row_no")
    groups = near_groups(rows.select(F.col("__row_no").alias("doc_id"), "text"), width, percent).select(F.col("doc_id").alias("__g_row"), "component_id")
    first = groups.join(rows.select("__row_no", "doc_id"), F.col("__g_row") == F.col("__row_no")).groupBy("component_id").agg(
        F.min(F.struct("doc_id", "__row_no")).alias("__first"))
    return rows.join(first.select(F.col("__first.__row_no").alias("__keep")), F.col("__row_no") == F.col("__keep"), "left_semi").select(*docs.columns)
