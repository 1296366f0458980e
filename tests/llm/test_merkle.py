"""Merkle manifest against a plain tree walk, and its edge cases."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from profilebook.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """The top of a tree and, for every node, its (left, right) siblings level by level."""
    trails = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 16] for i in range(0, len(nodes), 16)]
        for k, p in enumerate(at):
            run, slot = runs[p // 16], p % 16
            trails[k].append(("".join(run[:slot]), "".join(run[slot + 1:])))
        nodes, at = [h(*r) for r in runs], [p // 16 for p in at]
    return nodes[0], trails


def plain(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    tops, own = {}, {}
    for s in names:
        ordered = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        tops[s], trails = climb([leaf(*r) for r in ordered])
        own[s] = list(zip(ordered, trails))
    root, trails = climb([tops[s] for s in names])
    out = []
    for s, above in zip(names, trails):
        for r, trail in own[s]:
            trail = trail + above
            low = r[1] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
            folded = leaf(r[0], low, *r[2:]) if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 0 else leaf(*r)
            for a, b in trail:
                folded = h(a, folded, b)
            out.append((r[0], leaf(*r), tops[s], root, h(*(a + b for a, b in trail)), folded, folded == root, len(own[s])))
    return out


def same(df, rows):
    return sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, plain(rows)))


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("n", [1, 16, 17, 300])
def test_manifest_of_one_source(spark, n):
    rows = [(i, f"Text {i}", "en", "one", i) for i in range(n)]
    assert same(merkle.manifest(table(spark, rows)), rows)


def test_manifest_of_many_sources_nulls_ties_and_long_texts(spark):
    rows = [(i, f"Ünder {i % 7}", None if i % 5 else "de", f"s{i % 23}" if i % 4 else None, None if i % 6 else i) for i in range(400)]
    rows += [(None, None, None, None, None), (None, "", "en", "", 0), (7, "same", "en", "s1", 4), (7, "same", "en", "s1", 4), (7, "other", "en", "s1", 5)]
    rows += [(9999, "Long " * 200_000, "en", "é", 1_000_000), (10000, "x", "en", "z", 1), (-3, "x", "en", "hot", 1)]
    assert same(merkle.manifest(table(spark, rows)), rows)


def test_manifest_of_an_empty_table_and_clashing_columns(spark):
    assert merkle.manifest(table(spark, [])).collect() == []
    rows = [(i, "T", "en", "a", 1) for i in range(20)]
    wide = table(spark, rows).selectExpr("*", "1 AS pos", "2 AS n", "3 AS g", "4 AS leaf", "5 AS digest", "6 AS up", "7 AS path", "8 AS place", "9 AS `left`")
    assert same(merkle.manifest(wide), rows)


def test_a_changed_text_does_not_verify(spark):
    rows = [(i, "ABC" if i % 2 else "abc", "en", "a", 3) for i in range(60)]
    for r in merkle.manifest(table(spark, rows)).collect():
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0 or r["doc_id"] % 2 == 0)
