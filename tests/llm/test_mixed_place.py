"""The place of the pipeline's rows in the mixed order, and the schedule against the exact target weights."""

from __future__ import annotations

from fractions import Fraction

import corpus_pipeline
from profilebook.llm import mixing
from profilebook.llm.common import landed, placed


def made(spark, n):
    """Sources a, b, c by 1 : 2 : 5; texts of very different lengths, so that files are read in another order than written."""
    rows = [(i, "word " * (1 + 300 * (i % 977 == 0) + i % 7), "en", "abbccccc"[i % 8], 0) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(8)


def test_place_holds_the_target_weights(spark):
    n = 6000
    docs = made(spark, n)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    want = [r["doc_id"] for r in mixing.mix(docs).select("doc.doc_id", "place").orderBy("place").collect()]
    stage = landed(corpus_pipeline.mix_sources(spark, docs, ""), "test")
    assert stage.columns == docs.columns
    rows = corpus_pipeline.tokenize(spark, stage, "").select("doc_id", "place").collect()
    assert sorted(r["place"] for r in rows) == list(range(n))
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["place"])]
    assert order == want
    share = {s: k ** 0.5 / (1 + 2 ** 0.5 + 5 ** 0.5) for s, k in (("a", 1), ("b", 2), ("c", 5))}
    for size in range(mixing.BLOCK, 2000, mixing.BLOCK):
        for s, w in share.items():
            assert abs(sum(source[d] == s for d in order[:size]) - w * size) < 2 * mixing.BLOCK


def test_place_of_many_files_and_of_frames_that_are_no_files(spark):
    docs = made(spark, 500).repartitionByRange(13, "doc_id").sortWithinPartitions("doc_id")
    for d in (landed(docs, "test"), docs):
        assert all(r["place"] == r["doc_id"] for r in placed(d).select("doc_id", "place").collect())
    assert placed(landed(docs.filter("false"), "test")).collect() == []


def drift(weights, blocks):
    """The largest |served - w * t| of any source at any slot of the first phase, and the number of its slots."""
    phases, rows = mixing.pieces(blocks, weights, 50)
    names, shares, _, _ = phases[0]
    own = [r for r in rows if r[0] == 0]
    total, served, worst, n = sum(Fraction(weights[s]) for s in names), [0] * len(names), Fraction(0), 0
    for _, start, end, before in own:
        assert before == served and start == n
        for i in mixing.serve(shares, list(before), start, end):
            served[i] += 1
            n += 1
            worst = max(worst, *(abs(served[k] - Fraction(weights[s]) / total * n) for k, s in enumerate(names)))
    return worst, n


def test_served_stays_within_one_block_of_the_given_targets():
    three = {s: 1 for s in "abc"}
    worst, n = drift(three, dict.fromkeys("abc", 4000))
    assert worst < 1 and n > 11000
    hot = {"hot": 10, **{f"s{i}": 1.1 + i / 100 for i in range(19)}}
    worst, n = drift(hot, dict.fromkeys(hot, 3000))
    assert worst < 1 and n > 6000
    tiny = {"a": 1, "b": 0.7, "c": 1e-5 * 1.7}
    worst, n = drift(tiny, {"a": 30000, "b": 30000, "c": 30000})
    assert worst < 1 and n > 30000
    many = {f"s{i}": 1 + i % 7 for i in range(300)}
    worst, n = drift(many, dict.fromkeys(many, 20))
    assert worst < 1 and n > 300


def test_small_weight_is_not_lifted_and_every_block_has_one_slot(spark):
    blocks = {"a": 9000, "b": 5000, None: 40, "z": 3}
    got = mixing.block_slots(spark, blocks, {"a": 1, "b": 1, None: 1e-3}, 100).collect()
    assert sorted(r["slot"] for r in got) == list(range(sum(blocks.values())))
    assert sorted((str(r["b_source"]), r["b_block"]) for r in got) == sorted((str(s), k) for s, n in blocks.items() for k in range(n))
    for s in blocks:
        own = [r["slot"] for r in sorted((r for r in got if r["b_source"] == s), key=lambda r: r["b_block"])]
        assert own == sorted(own)
    assert abs(sum(r["b_source"] is None for r in got if r["slot"] < 8000) - 8000 * 1e-3 / 2.001) < 1
    assert {r["slot"] for r in got if r["b_source"] == "z"} == set(range(14040, 14043))
