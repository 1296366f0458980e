"""MinHash near-dedup against brute force."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilebook.llm import components, minhash
from tests.llm.test_native import table


def brute(rows, width, percent):
    """doc_id -> (shingles, smallest doc_id reachable)."""
    sets = {}
    for i, t in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        w = re.findall(r"[^\x20\x09-\x0d]+", lowered)
        sets[i] = {tuple(w[j:j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(4))
    rows = []
    for _ in range(40):
        base = [word() for _ in range(rng.choice([3, 8, 40, 150]))]
        rows.append(" ".join(base))
        for _ in range(rng.randrange(5)):
            new = list(base)
            for _ in range(rng.randrange(1 + len(base) // 25)):
                new[rng.randrange(len(new))] = word()
            rows.append(rng.choice([" ", "\n", "\t "]).join(new).upper() if rng.random() < 0.3 else " ".join(new))
    rows += ["", None, " \t", "x", "X", "a b c", "a b c d"]
    return list(enumerate(rows))


@pytest.mark.parametrize("width", [4, 5])
def test_components_match_brute_force(spark, width):
    rows = corpus()
    lowercase_accents = [(i, t) for i, t in rows]
    want = brute(lowercase_accents, width, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_groups(table(spark, rows), width).collect()}
    assert got == want


def test_whole_table_matches_brute_force(spark):
    """The registered query's parameters over a whole test table, with an inverted index as the other way."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_groups(d, 4).collect()} == brute(rows, 4, 80)


def test_large_group_in_blocks(spark, monkeypatch):
    """Buckets of many classes are compared in blocks; the result does not depend on the block size."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if rng.random() > 0.03 else f"x{rng.randrange(10 ** 6)}" for w in base)) for i in range(80)]
    want = {i: c for i, (_, c) in brute(rows, 5, 80).items()}
    monkeypatch.setattr(minhash, "BLOCK", 7)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_groups(table(spark, rows)).collect()} == want


def test_nulls_repeats_clashing_names_and_empty(spark):
    d = table(spark, [(None, "a b c d e f"), (4, "A b c d e f"), (4, "other text of this id"), (9, None), (9, None)]).withColumn("rep", F.lit(1)).withColumn("_keep", F.lit(2))
    got = sorted(map(repr, ((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_groups(d).collect())))
    assert got == sorted(map(repr, [(None, None, True), (4, None, False), (4, 4, True), (9, 9, True), (9, 9, True)]))
    assert [c for c in minhash.drop_near(d).columns] == d.columns
    assert minhash.near_groups(table(spark, [])).collect() == []


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.RandomState(0)
    for j in (0.75, 0.8, 0.9, 0.97):
        common = int(2000 * j)
        items = rng.randint(0, 2 ** 63, 4000).astype(np.uint64)
        a, b = items[:2000], np.concatenate([items[:common], items[2000:2000 + (2000 - common)]])
        true = common / (4000 - common)
        s = minhash.odd_sketches(minhash.samples(np.concatenate([a, b]), np.array([2000, 2000])))
        got = minhash.estimate(np.array([minhash._POP[s[0] ^ s[1]].sum()]))[0]
        assert abs(got - true) < 0.15
        f = minhash.fine_sketches(np.concatenate([a, b]), np.array([2000, 2000])).view(np.uint64)
        fine = minhash.estimate(np.bitwise_count(f[0] ^ f[1]).sum(dtype=np.int64), minhash.FINE_BITS, minhash.FINE_SAMPLES)
        assert abs(fine - true) < 0.06


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, i) for i in range(101, 120)] + [(7, 3), (200, 201), (200, 201)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = collections.ChainMap({i: 1 for i in range(1, 31)}, {i: 100 for i in range(100, 120)}, {200: 200, 201: 200})
    assert got == dict(want)
