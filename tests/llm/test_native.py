"""Exact dedup, line dedup and fingerprints against DuckDB SQL and brute force."""

from __future__ import annotations

import hashlib
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from profilebook.llm import exact, fingerprint, linedup

PASSAGE = " ".join(f"word{i}" for i in range(60))
SHORT = "only a few words"
TEXTS = [
    (1, f"{PASSAGE}\n{SHORT}\nmine alone"), (2, f"start here\n{PASSAGE}"), (3, SHORT), (4, SHORT), (5, ""), (6, None), (7, f"{PASSAGE}\n\n{SHORT}\nmine alone"),
    (8, " \n \t\n"), (9, "é" * 9000), (10, "é" * 9000), (11, "\n".join(["twenty " * 20] * 6)), (12, "\n".join([" ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30)), "end"])),
    (13, "\n".join(["lead", " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30)), "end"])),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in rows], SCHEMA)


def oracle(sql, rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], dtype="Int64"), "text": pd.array([r[1] for r in rows], dtype="string")}))
    return con.sql(sql).fetchall()


def same(df, got):
    return sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, got))


def test_exact_matches_sql(spark):
    cols = "doc_id keep_id group_size kept text_sha256".split()
    assert same(exact.exact_groups(table(spark, TEXTS)).select(*cols), oracle(exact.ORACLE, TEXTS))


def test_exact_stays_exact_when_chunk_ids_clash(spark):
    clash = lambda c: F.length(c).cast("long")
    rows = [(1, "abc"), (2, "abd"), (3, "abc"), (4, "x" * 5000), (5, "y" * 5000)]
    got = {r["doc_id"]: r["keep_id"] for r in exact.exact_groups(table(spark, rows), clash).collect()}
    assert got == {1: 3, 2: 2, 3: 3, 4: 4, 5: 5}


def test_exact_nulls_repeats_and_empty(spark):
    rows = [(None, "a"), (None, "a"), (3, "a"), (3, "a"), (None, "b")]
    got = sorted(map(repr, (tuple(r)[:4] for r in exact.exact_groups(table(spark, rows)).collect())))
    assert got == sorted(map(repr, [(None, 3, 4, False)] * 2 + [(3, 3, 4, True)] * 2 + [(None, None, 1, True)]))
    assert exact.exact_groups(table(spark, [])).collect() == []
    assert {r["doc_id"] for r in exact.drop_copies(table(spark, TEXTS)).collect()} == {1, 2, 4, 6, 7, 8, 10, 11, 12, 13}


def test_chunks_join_to_the_text(spark):
    d = table(spark, TEXTS).filter("text is not null")
    assert d.filter(F.array_join(exact.chunks_of(F.col("text")), "") != F.col("text")).isEmpty()


def test_lines_match_sql(spark):
    cols = "doc.doc_id n_lines n_removed emptied text".split()
    got = linedup.dedup_lines(table(spark, TEXTS)).select(*cols)
    rows = {r[0]: r for r in got.collect()}
    assert rows[2]["text"] == "start here" and rows[12]["n_removed"] == 0 and rows[13]["text"] == "lead"
    assert rows[7]["text"] == "" or rows[7]["n_removed"] == 3
    strip = lambda rows: sorted((r[0], r[1], r[2], r[3], (r[4] or "").replace("\n\n", "\n")) for r in rows if r[0] != 8)
    assert strip(got.collect()) == strip(oracle(linedup.ORACLE, TEXTS))


def test_lines_nulls_repeats_clashing_names_and_empty(spark):
    d = table(spark, [(None, PASSAGE), (1, PASSAGE), (1, PASSAGE), (2, None)]).withColumn("gone", F.lit(1)).withColumn("th", F.lit(2))
    got = sorted(map(repr, (tuple(r) for r in linedup.dedup_lines(d).select("doc.doc_id", "doc.gone", "doc.th", "text", "emptied").collect())))
    assert got == sorted(map(repr, [(None, 1, 2, PASSAGE, False), (1, 1, 2, "", True), (1, 1, 2, "", True), (2, 1, 2, None, False)]))
    assert linedup.dedup_lines(table(spark, [])).collect() == []


def test_suffix_levels_are_ranks(spark):
    """At every level, equal ranks mean equal runs and ranks follow the order of the levels below."""
    rows = [(1, "\n".join("a b a b a b c".split())), (2, "\n".join("a b a b c".split()))]
    lines = linedup.line_table(table(spark, rows), 1).cache()
    text = {(r["doc_id"], r["i"]): (r["a"], r["b"]) for r in lines.collect()}
    levels = {}
    for r in linedup.suffix_levels(lines, 4).collect():
        levels.setdefault(r["k"], {})[(r["doc_id"], r["i"])] = r["r"]
    for k, ranks in levels.items():
        run = {p: tuple(text[(p[0], p[1] + j)] for j in range(2 ** k)) for p in ranks}
        order = sorted(set(run.values()))
        assert [x for _, x in sorted({ranks[p]: run[p] for p in ranks}.items())] == order


def shingle_sets(text):
    words = [""] * 4 + (text or "").split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def test_fingerprints(spark):
    rows = [(i, " ".join(f"w{(i * 37 + j) % 211}" for j in range(n))) for i, n in enumerate([400, 3, 0, 1, 120, 900])] + [(6, None), (7, "ä ö ü ß x y z")]
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(table(spark, rows)).collect()}
    texts = [t or "" for _, t in rows]
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", texts[(k + 1) % len(rows)]
        m = len(t) // 4
        edited = t[:len(t) - m] + nxt[:m]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for column, other in (("near_edited", edited), ("near_next", nxt)):
            a, b = shingle_sets(t), shingle_sets(other)
            assert got[i][column] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0, abs=0.15)
            if len(a | b) <= fingerprint.K:
                assert got[i][column] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert got[i]["shingles_estimate"] == pytest.approx(len(shingle_sets(t)), rel=0.35)


def test_follower_does_not_depend_on_ranges(spark):
    rows = [(None, "n")] + [(i * 7 - 300, f"text {i}") for i in range(100)]
    one, many = (sorted(map(repr, (tuple(r) for r in fingerprint.with_follower(table(spark, rows), c).select("doc_id", "text", "next_text").collect()))) for c in (10 ** 9, 20))
    assert one == many and len(one) == 101


def test_sketches_merge_and_decode(spark):
    a, b = " ".join(f"a{i}" for i in range(300)), " ".join(f"a{i}" for i in range(200))
    d = spark.createDataFrame([(a, b)], "a string, b string").withColumn("x", fingerprint.sketch(F.col("a"))).withColumn("y", fingerprint.sketch(F.col("b")))
    r = d.select(fingerprint.containment(F.col("y"), F.col("x")).alias("c"), fingerprint.resemblance(F.col("x"), F.col("y")).alias("j"),
                 (fingerprint.decode(fingerprint.encode(F.col("x"))) == F.col("x")).alias("same"),
                 (fingerprint.merge(F.col("x"), F.col("y")) == F.col("x")).alias("merged")).first()
    assert r["c"] == pytest.approx(1.0, abs=0.2) and r["j"] == pytest.approx(2 / 3, abs=0.15) and r["same"] and r["merged"]
    parts = spark.createDataFrame([(1, a), (1, b), (2, "x")], "k long, t string").withColumn("s", fingerprint.sketch(F.col("t")))
    merged = {r["k"]: r["s"] for r in fingerprint.merge_parts(parts, "k", "s").collect()}
    assert merged[1] == d.first()["x"] and len(merged[2]) == 1


def test_fingerprint_empty_and_single(spark):
    assert fingerprint.fingerprints(table(spark, [])).collect() == []
    r = fingerprint.fingerprints(table(spark, [(1, "one two three four")])).first()
    assert r["near_next"] == 1.0 and re.fullmatch("([0-9a-f]{12})+", r["fingerprint"])
