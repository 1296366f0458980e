"""Bounded-load ring against a plain walk, one key after the other, and its edge cases."""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections import Counter

import pytest

from profilebook.llm import sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)


def plain(rows, shards, vnodes, slack):
    """Every key walks the ring from its place until a shard has room."""
    places, owners = sharding.ring(shards, vnodes)
    room = sharding.capacities(len(rows), shards, slack)
    taken, out = [0] * shards, []

    def arrival(row):
        doc_id, text = row
        digest = hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()
        raw = (text or "").encode()
        return int(digest[15], 16), int(digest[:15], 16), doc_id is not None, doc_id or 0, zlib.crc32(raw), len(raw) + 16

    for row in sorted(rows, key=arrival):
        k = bisect.bisect_left(places, arrival(row)[1])
        while taken[s := owners[k % len(owners)]] >= room[s]:
            k += 1
        out.append((row[0], arrival(row)[5], arrival(row)[4], s, taken[s]))
        taken[s] += 1
    return sorted(out, key=repr)


ROWS = [(i, f"text {i % 9}") for i in range(300)] + [(None, None)] * 30 + [(None, "a"), (7, ""), (7, "é" * 300_000), (7, "text 7")] + [(8, "hot")] * 120


@pytest.mark.parametrize("shards, vnodes, slack", [(40, 64, 0.0), (7, 5, 0.0), (7, 5, 0.1), (1, 3, 0.0)])
def test_shards_match_the_plain_walk(spark, shards, vnodes, slack):
    got = sorted(map(tuple, sharding.shards_of(table(spark, ROWS), shards, vnodes, slack).collect()), key=repr)
    assert got == plain(ROWS, shards, vnodes, slack)
    counts = Counter(r[3] for r in got)
    if slack == 0:
        assert max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r[4] for r in got if r[3] == shard) == list(range(counts[shard]))


def test_one_shard_more_moves_few_rows(spark):
    docs = table(spark, [(i, "t") for i in range(4_000)])
    for slack, most in ((0.0, 0.25), (0.25, 0.08)):
        old = {r["doc_id"]: r["shard"] for r in sharding.shards_of(docs, 20, 64, slack).collect()}
        new = {r["doc_id"]: r["shard"] for r in sharding.shards_of(docs, 21, 64, slack).collect()}
        assert sum(old[i] != new[i] for i in old) <= most * len(old)


def test_fewer_rows_than_shards_empty_table_and_clashing_columns(spark):
    assert sharding.shards_of(table(spark, [])).collect() == []
    rows = [(i, "x") for i in range(5)]
    wide = table(spark, rows).selectExpr("*", "1 AS at", "2 AS round", "3 AS cell", "4 AS place", "5 AS shard", "6 AS slot", "7 AS size", "8 AS `end`")
    assert sorted(map(tuple, sharding.shards_of(wide).collect()), key=repr) == plain(rows, 40, 64, 0.0)
