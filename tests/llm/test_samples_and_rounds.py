"""Samples at any size, toxic evidence against a plain scan, the mixing order against a plain earliest-deadline run."""

from __future__ import annotations

import itertools
import random
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from profilebook.llm import common, mixing, toxicity
from profilebook.llm.common import even_sample, sample_bound, shares


@pytest.mark.parametrize("n", [10 ** 4, 10 ** 9, 10 ** 12, 10 ** 15])
@pytest.mark.parametrize("limit", [2_000, 6_000, 20_000])
def test_the_share_is_right_at_any_size(n, limit):
    if n > limit:
        assert sample_bound(n, limit) / 2 ** 62 * n == pytest.approx(0.9 * limit, rel=1e-6) and sample_bound(n, limit) < 2 ** 62


def test_small_groups_give_all_their_rows(spark):
    assert shares({"a": 5, "b": 1000, "c": 2000}, 605) == {"a": 5, "b": 300, "c": 300}
    assert shares({None: 3, "b": 4}, 100) == {None: 3, "b": 4}
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 7, "rare").when(F.col("id") < 9_000, "x").otherwise("y").alias("lang"))
    n = {r["lang"]: r["n"] for r in even_sample(d, "doc_id", "lang", 1_000).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert n["rare"] == 7 and all(380 < n[k] < 497 for k in "xy")
    assert even_sample(d.filter("false"), "doc_id", "lang", 10).collect() == []
    assert even_sample(d, "doc_id", "lang", 10 ** 6).count() == 20_000


def test_evidence_matches_a_plain_scan():
    rng = random.Random(3)
    lexicon = toxicity.Lexicon({" bad": 3.0, " badly ": 4.0, " ugiy ": 2.5}, [" not bad ", " badiy drawn ", " bad "], [])
    automaton = lexicon.automaton()
    for _ in range(200):
        folded = " " + " ".join(rng.choice(["bad", "badiy", "not", "drawn", "ugiy", "badly", "fine"]) for _ in range(rng.randint(0, 30))) + " "
        spans = [(i, i + len(e) - 1) for e in lexicon.exceptions for i in range(len(folded)) if folded.startswith(e, i)]
        hits: dict[int, float] = {}
        for e, w in lexicon.weights.items():
            for i in range(len(folded)):
                if folded.startswith(e, i):
                    hits[i] = max(w, hits.get(i, 0.0))
        kept = [w for i, w in hits.items() if not any(b <= i < e for b, e in spans)]
        assert toxicity.evidence(folded, automaton)[0] == max(kept, default=0.0)
        assert toxicity.evidence(folded, automaton)[1] == pytest.approx(sum(kept) / toxicity.np.log2(2 + folded.count(" ")))


def plain(blocks, weights):
    """Slot by slot: of the released blocks the one with the earliest deadline (ties: the first source); exact fractions."""
    done, order = dict.fromkeys(blocks, 0), []
    while any(done[s] < blocks[s] for s in blocks):
        names = sorted((s for s in blocks if done[s] < blocks[s] and weights.get(s, 0) > 0), key=str)
        live = {s: Fraction(weights[s]) for s in names} or {s: Fraction(1) for s in sorted(blocks, key=str) if done[s] < blocks[s]}
        total, start = sum(live.values()), dict(done)
        for t in itertools.count():
            ready = []
            for k, s in enumerate(live):
                j, w = done[s] - start[s], live[s] / total
                if j / w // 1 <= t:
                    ready.append((-(-(j + 1) // w), k, s))
            s = min(ready)[2]
            order.append((s, done[s]))
            done[s] += 1
            if done[s] == blocks[s]:
                break
    return order


@pytest.mark.parametrize("blocks, weights", [
    ({"a": 40, "b": 25, "c": 7}, {"a": 1, "b": 2, "c": 1}), ({"a": 60, "b": 60, "c": 60}, {"a": 1, "b": 1, "c": 1}),
    ({"a": 30, "b": 30, None: 4, "z": 3}, {"a": 0.7, "b": 0.25, None: 0.05}), ({"hot": 90, "x": 3, "y": 3}, {"hot": 5, "x": 3, "y": 2}), ({"a": 5}, {"a": 1})])
def test_order_is_the_plain_earliest_deadline_order(spark, blocks, weights):
    got = sorted((r["slot"], r["b_source"], r["b_block"]) for r in mixing.block_slots(spark, blocks, weights, 3).collect())
    assert [(s, b) for _, s, b in got] == plain(blocks, weights) and [t for t, _, _ in got] == list(range(sum(blocks.values())))


def test_rounds_repeat_without_running_through_them():
    blocks = {"a": 10 ** 9, "b": 2 * 10 ** 9 + 1, "c": 10 ** 9}
    phases, rows = mixing.pieces(blocks, {"a": 1, "b": 2, "c": 1}, 1000)
    assert len(rows) < 3 * mixing.MOST_PIECES and rows[-1][2] + phases[-1][3] == sum(blocks.values())
    for (p, _, end, _), (q, start, _, before) in itertools.pairwise(rows):
        assert p != q or (start == end and sum(before) == start)


def test_a_hot_source_and_clashing_columns(spark):
    d = spark.range(3_000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
                                  F.lit(1).alias("place"), F.lit(2).alias("row_no"), F.lit(3).alias("n"), F.lit(4).alias("first"), F.lit(5).alias("slot"), F.lit(6).alias("block"))
    got = mixing.mix(d, block=4).select("doc.doc_id", "place").collect()
    assert sorted(r["place"] for r in got) and len({r["place"] for r in got}) == len({r["doc_id"] for r in got}) == 3_000
    assert mixing.mixed(d).columns == d.columns


def test_rows_of_the_driver_start_no_python_workers(spark):
    """A list of rows would pass through Python workers of its own, which stay in every executor's memory."""
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, "b")], "doc_id long, lang string")
    local = common.local_frame(spark, [("a", 1), (None, 2)], df.select("lang").schema.add("n", "long"))
    assert sorted(map(tuple, local.collect()), key=str) == [("a", 1), (None, 2)]
    assert common.local_frame(spark, [], local.schema).collect() == []
    slots = mixing.block_slots(spark, {"a": 3, None: 2}, {"a": 2, None: 1})
    for frame in (local, slots, mixing.block_slots(spark, {}, {})):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "LocalTableScan" in plan and "ExistingRDD" not in plan
    assert sorted((r["slot"], r["b_source"], r["b_block"]) for r in slots.collect()) == [
        (0, "a", 0), (1, None, 0), (2, "a", 1), (3, "a", 2), (4, None, 1)]


def test_texts_go_to_python_in_small_batches(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    try:
        corpus_pipeline.small_batches(spark)
        texts = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("abcdefgh "), 200).alias("text"))
        rows = texts.mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in it), "n long").collect()
        assert len(rows) > 1 and max(r["n"] for r in rows) < 5_000_000
    finally:
        spark.conf.set(setting, before)
