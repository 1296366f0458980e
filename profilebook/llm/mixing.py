"""Mixing sources to target weights by Pfair scheduling.

Every source's documents, in an order drawn by a hash, are cut into blocks of ``BLOCK`` documents.  With target weight w
the j-th block of a source is released at slot floor(j / w) and due at ceil((j + 1) / w); earliest-deadline-first over
unit slots then keeps every source within less than one block of w * t at every slot t.  Weights are whole numbers in the
targets' exact proportion; after as many slots as their sum every source has exactly its share and the schedule repeats.
So the driver runs through one such round at most (and through nothing behind the last block), and keeps the number of
blocks served by each source at the start of every piece of ``period`` slots; tasks repeat the pieces and write the slot
of every block.  When a source is used up, the weights of the others are scaled up and a next phase begins in the next
slot, so no document is left out; the deviation bound holds in each phase.

Target weights: given, or by default each source's share of documents to the power ``ALPHA`` (0.5), which lifts small
sources, in millionths of the sum, so that a round has about a million slots.  The number of sources must stay below
``MAX_SOURCES`` (the table of counts per source passes the driver); more raise an error.  Documents are numbered within
their source by one range sort of narrow rows, which cuts a hot source over many parts; texts are not shuffled for it.

Defined results: a null source is a source of its own (its target weight is looked up under None).  A source without a
given target weight has weight 0 and comes after all others.  Null texts and ids take part like others.  Rows that are
equal in id and text follow each other.  Extra columns are kept, names may clash.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import itertools
import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from profilebook.llm.common import landed, local_frame, placed

BLOCK = 64
PERIOD = 1000
ALPHA = 0.5
MAX_SOURCES = 1_000
MOST_PIECES = 100_000


def quotas(weights: dict, period: int) -> dict:
    """Whole slots per period for each source, at least 1, proportional by largest remainder; their sum is the period.

    ``mix`` does not round its weights by this."""
    total = sum(weights.values())
    period = max(period, len(weights))
    exact = {s: Fraction(w) / Fraction(total) * period for s, w in weights.items()}
    out = {s: max(1, math.floor(x)) for s, x in exact.items()}
    spare = period - sum(out.values())
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], str(s)))[:max(spare, 0)]:
        out[s] += 1
    while sum(out.values()) > period:
        out[max(out, key=lambda s: (out[s] - exact[s] if out[s] > 1 else -1, str(s)))] -= 1
    return out


def whole(weights: list) -> list[int]:
    """Whole numbers in exactly the proportion of the weights."""
    exact = [Fraction(w) for w in weights]
    unit = math.lcm(*(x.denominator for x in exact))
    return [int(x * unit) for x in exact]


def serve(weights: list[int], served: list[int], start: int, end: int):
    """The source (its number) of each slot from ``start`` to ``end``, the earliest deadline among the released blocks
    first; ``served`` holds the blocks served before and is counted on."""
    total = sum(weights)
    waiting = [(n * total // w, i) for i, (n, w) in enumerate(zip(served, weights))]
    heapq.heapify(waiting)
    ready: list = []
    for t in range(start, end):
        while waiting and waiting[0][0] <= t:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(served[i] + 1) * total // weights[i]), i))
        i = heapq.heappop(ready)[1]
        served[i] += 1
        heapq.heappush(waiting, (served[i] * total // weights[i], i))
        yield i


def schedule(quota: dict) -> dict:
    """Slots of one period for each source with whole quotas."""
    names = sorted(quota, key=str)
    slots: dict = {s: [] for s in quota}
    for t, i in enumerate(serve([quota[s] for s in names], [0] * len(names), 0, sum(quota.values()))):
        slots[names[i]].append(t)
    return slots


def pieces(blocks: dict, weights: dict, period: int = PERIOD) -> tuple[list, list]:
    """Phases (sources, whole weights, blocks done before, first slot) and their pieces (phase, start, end, blocks served
    before), slots counted within the phase.  A phase ends with the last block of a source; a source of weight 0 waits
    for a last phase."""
    done = dict.fromkeys(blocks, 0)
    phases: list = []
    out: list = []
    at = 0
    # The state of a piece holds a number per source: pieces are long enough that states stay far fewer than slots.
    least = max(period, 16 * len(blocks), sum(blocks.values()) // MOST_PIECES)
    while left := [s for s in blocks if done[s] < blocks[s]]:
        live = sorted((s for s in left if weights.get(s, 0) > 0), key=str)
        names = live or sorted(left, key=str)
        shares = whole([weights[s] if live else 1 for s in names])
        shares = [w * -(-least // sum(shares)) for w in shares]  # a round holds at least one piece
        phases.append((names, shares, [done[s] for s in names], at))
        room = [blocks[s] - done[s] for s in names]
        end, states = one_round(shares, room, least)
        cycle = sum(shares)
        for start in range(0, end, cycle):
            times = start // cycle
            for k, before in states:
                if start + k >= end:
                    break
                out.append((len(phases) - 1, start + k, min(start + min(k + least, cycle), end), [times * w + n for w, n in zip(shares, before)]))
        last = out[-1]
        served = list(last[3])
        for _ in serve(shares, served, last[1], last[2]):
            pass
        for s, n in zip(names, served):
            done[s] += n
        at += end
    return phases, out


def one_round(shares: list[int], room: list[int], least: int) -> tuple[int, list]:
    """The slot after which the first source has no block left, and (slot, blocks served before) every ``least`` slots of
    the first round.  A round has as many slots as the sum of the shares; each further one repeats it."""
    cycle, served, states = sum(shares), [0] * len(shares), []
    # In a round source i has shares[i] blocks; its last one of all is number (room - 1) % shares of a round.
    wanted = {(i, (r - 1) % w): (r - 1) // w for i, (r, w) in enumerate(zip(room, shares))}
    end = None
    for t, i in enumerate(serve(shares, served, 0, cycle)):
        if t % least == 0:
            states.append((t, [n - (k == i) for k, n in enumerate(served)]))
        if (i, served[i] - 1) in wanted:
            over = wanted[i, served[i] - 1] * cycle + t + 1
            end = over if end is None else min(end, over)
            if end <= t + 1:
                break
    return end, states


def block_slots(spark: SparkSession, blocks: dict, weights: dict, period: int = PERIOD) -> DataFrame:
    """b_source, b_block, slot for every block."""
    phases, rows = pieces(blocks, weights, period)
    shared = spark.sparkContext.broadcast(phases)

    def run(batches):
        for b in batches:
            for phase, start, end, before in zip(*(b.column(c).to_pylist() for c in ("phase", "start", "end", "before"))):
                names, shares, done, at = shared.value[phase]
                served = list(before)
                order = list(serve(shares, served, start, end))
                count, block = list(before), []
                for i in order:
                    block.append(done[i] + count[i])
                    count[i] += 1
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in order], pa.string()), pa.array(block, pa.int64()),
                                                  pa.array(range(at + start, at + end), pa.int64())], names=["b_source", "b_block", "slot"])

    plan = local_frame(spark, rows, StructType.fromDDL("phase int, start long, end long, before array<long>"))
    return plan.mapInArrow(run, "b_source string, b_block long, slot long")


def source_key(source: Column) -> Column:
    """The source as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def numbered(docs: DataFrame) -> DataFrame:
    """row_no (the row's number in ``placed(docs)``), doc_id, source, n: the documents of each source numbered 0, 1, ... in
    hash order."""
    rows = placed(docs, "__row_no").select(F.col("__row_no").alias("row_no"), "doc_id", "source", F.xxhash64("doc_id", "text").alias("h"))
    # Landed before the range sort, whose sampling would read the texts a second time.
    order = ["source", "h", "doc_id", "row_no"]
    ranked = placed(landed(landed(rows, "mix-rows").repartitionByRange(*order).sortWithinPartitions(*order), "mix-order"))
    first = ranked.groupBy(source_key(F.col("source")).alias("f_source")).agg(F.min("place").alias("first"))
    return ranked.join(F.broadcast(first), source_key(F.col("source")) == F.col("f_source")).select(  # at most MAX_SOURCES rows
        "row_no", "doc_id", "source", (F.col("place") - F.col("first")).alias("n"))


def places(docs: DataFrame, targets: dict | None = None, block: int = BLOCK, period: int = PERIOD, alpha: float = ALPHA) -> DataFrame:
    """row_no, doc_id, source, block (number within the source), slot (place of the block), place (order of the documents)."""
    counts = docs.groupBy("source").agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    size = {r["source"]: r["n"] for r in counts}
    total = sum(n ** alpha for n in size.values())
    weights = targets if targets is not None else {s: max(round(n ** alpha / total * 10 ** 6), 1) for s, n in size.items()}
    blocks = {s: -(-n // block) for s, n in size.items()}
    slots = landed(block_slots(docs.sparkSession, blocks, weights, period), "slots")
    d = numbered(docs).withColumn("block", F.floor(F.col("n") / block))
    d = d.join(slots, (source_key(F.col("source")) == source_key(F.col("b_source"))) & (F.col("block") == F.col("b_block")))
    return d.select("row_no", "doc_id", "source", "block", "slot", (F.col("slot") * block + F.col("n") % block).alias("place"))


def mix(docs: DataFrame, targets: dict | None = None, block: int = BLOCK, period: int = PERIOD, alpha: float = ALPHA) -> DataFrame:
    """doc (the row), source, block, slot, place: the whole rows join their places once."""
    p = places(docs, targets, block, period, alpha).drop("doc_id")
    rows = placed(docs, "__row_no").select(F.struct(*docs.columns).alias("doc"), "__row_no")
    return rows.join(p, F.col("__row_no") == F.col("row_no")).select("doc", "source", "block", "slot", "place")


def mixed(docs: DataFrame, targets: dict | None = None) -> DataFrame:
    """The documents in mixed order: ranges of ``place``, ascending within and across the parts written."""
    d = mix(docs, targets)
    return d.repartitionByRange("place").sortWithinPartitions("place").select("doc.*")
