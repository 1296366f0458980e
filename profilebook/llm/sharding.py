"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``vnodes`` places on a ring of 60-bit hashes; a key belongs to the shard of the next place clockwise.  A
shard takes at most its capacity of rows; a key that meets a full shard goes on clockwise to the next one with room.  Keys
arrive in an order that does not depend on the shards: by ``ROUNDS`` rounds drawn from the key's hash, in a round by ring
position.  All keys of one round between two neighbouring places (a cell) meet the same shards in the same order, so the
walk needs only the number of keys in each cell: the driver walks over at most rounds x (shards x vnodes + 1) counts,
whatever the number of rows, and cuts a cell where a shard becomes full.  A row finds its shard by its cell and its number
in the arrival order; that number comes from one range sort of narrow rows, which also cuts a key that holds many rows.

With ``slack`` 0 the capacities are the even shares, so shard counts differ by one at most (law ``rows``); with a slack the
capacity is (1 + slack) x the mean and fewer keys leave their first shard.  Beside a ring of one shard more most rows stay.

Defined results: a null doc_id counts as the empty text, a null text has no bytes (size 16) and crc32 0.  Rows of one doc_id
follow each other by text_crc32 and size; rows equal in all three are interchangeable.  Texts play no part in the choice.
Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilebook.llm.common import landed, placed, text_of
from profilebook.llm.merkle import CRC_TABLE, crc_sql

SHARDS = 40
VNODES = 64
ROUNDS = 16


def position(key: str) -> int:
    """Place of a key on the ring."""
    return int(hashlib.md5(key.encode()).hexdigest()[:15], 16)


def ring(shards: int, vnodes: int) -> tuple[list[int], list[int]]:
    """The places of all virtual nodes, ascending, and the shard of each."""
    nodes = sorted((position(f"shard {s} node {v}"), s) for s in range(shards) for v in range(vnodes))
    return [p for p, _ in nodes], [s for _, s in nodes]


def capacities(n: int, shards: int, slack: float) -> list[int]:
    if slack == 0:
        return [n // shards + (s < n % shards) for s in range(shards)]
    return [int(-(-n * (1 + slack) // shards))] * shards


def keyed(docs: DataFrame, shards: int, vnodes: int) -> DataFrame:
    """doc_id, size, text_crc32 and cell, in arrival order, with place (the row's number in it)."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    d = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(text_of()).alias("text_crc32"),
                    F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("at"), F.conv(F.substring(digest, 16, 1), 16, 10).cast("int").alias("round"))
    # Landed before the range sort, whose sampling would read the texts a second time.
    d = landed(d, "keys").withColumn("tie", F.monotonically_increasing_id())
    order = ["round", "at", "doc_id", "text_crc32", "size", "tie"]
    d = placed(landed(d.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie"), "arrivals"))
    places = np.array(ring(shards, vnodes)[0], dtype="int64")

    @F.pandas_udf("int")
    def arc(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(places, at).astype("int32"))

    return d.select("doc_id", "size", "text_crc32", "place", (F.col("round") * (len(places) + 1) + arc("at")).alias("cell"))


def walk(counts: dict[int, int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(cell, first place, place behind the last, shard, slot of the first) of every stretch of rows.

    ``counts`` has the rows of each cell; ``room`` the capacities, which are used up."""
    arcs = len(owners)
    taken = [0] * len(room)

    def next_open() -> list[int]:
        after, out = None, [0] * arcs
        for k in range(2 * arcs - 1, -1, -1):
            after = owners[k % arcs] if room[owners[k % arcs]] else after
            out[k % arcs] = after
        return out

    out, begin, go = [], 0, next_open()
    for cell in sorted(counts):
        left = counts[cell]
        while left:
            shard = go[cell % (arcs + 1) % arcs]
            k = min(left, room[shard])
            out.append((cell, begin, begin + k, shard, taken[shard]))
            taken[shard] += k
            room[shard] -= k
            begin, left = begin + k, left - k
            if not room[shard] and any(room):
                go = next_open()
    return out


def shards_of(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot."""
    d = keyed(docs, shards, vnodes)
    counts = {r["cell"]: r["n"] for r in d.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    _, owners = ring(shards, vnodes)
    stretches = walk(counts, owners, capacities(sum(counts.values()), shards, slack))
    plan = docs.sparkSession.createDataFrame(pd.DataFrame(stretches, columns=["s_cell", "begin", "end", "shard", "first"], dtype="int64"),
                                             "s_cell long, begin long, end long, shard long, first long")
    # At most a row per cell and one more for each shard that fills up.
    here = (F.col("cell") == F.col("s_cell")) & (F.col("place") >= F.col("begin")) & (F.col("place") < F.col("end"))
    return d.join(F.broadcast(plan), here).select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("place") - F.col("begin")).alias("slot"))


#: The plain walk, one key after the other, each along its own list of shards in clockwise order.
ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
  node AS (SELECT s AS shard, ('0x' || md5('shard ' || s || ' node ' || v)[1:15])::BIGINT AS pos FROM range({SHARDS}) AS a(s), range({VNODES}) AS b(v)),
  keyed AS (
    SELECT doc_id, coalesce(strlen(text), 0) + 16 AS size, {crc_sql("coalesce(text, '')")} AS text_crc32,
           ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT AS pos, ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[16])::INT AS round
    FROM documents, crc_table),
  arrival AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY round, pos, doc_id NULLS FIRST, text_crc32, size) AS i FROM keyed),
  spot AS (SELECT DISTINCT pos FROM keyed),
  near AS (
    SELECT spot.pos, shard, min(node.pos - spot.pos + CASE WHEN node.pos >= spot.pos THEN 0 ELSE 1152921504606846976 END) AS far
    FROM spot, node GROUP BY spot.pos, shard),
  queue AS MATERIALIZED (
    SELECT i, shards FROM arrival JOIN (SELECT pos, list(shard ORDER BY far) AS shards FROM near GROUP BY pos) USING (pos)),
  step AS (
    SELECT 0::BIGINT AS i, -1::BIGINT AS shard, -1::BIGINT AS slot,
           (SELECT list(n // {SHARDS} + CASE WHEN s < n % {SHARDS} THEN 1 ELSE 0 END ORDER BY s) FROM range({SHARDS}) AS a(s), (SELECT count(*) AS n FROM documents)) AS cap,
           [0::BIGINT FOR x IN range({SHARDS})] AS taken
    UNION ALL
    SELECT i, shard, taken[shard + 1], cap, list_transform(taken, lambda t, k: t + CASE WHEN k = shard + 1 THEN 1 ELSE 0 END)
    FROM (SELECT queue.i, cap, taken, list_filter(shards, lambda s: taken[s + 1] < cap[s + 1])[1] AS shard
          FROM step JOIN queue ON queue.i = step.i + 1))
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, slot, NULL::INT AS grown_shard FROM step JOIN arrival ON arrival.i = step.i
"""
