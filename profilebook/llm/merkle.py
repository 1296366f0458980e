"""Merkle manifest of a table: sixteen-way hash trees by source, one tree over the sources, a proof for every row.

A row's leaf is the sha256 of its fields, each written as byte count, colon and value (``-`` for a null).  The leaves of a
source ascend by doc_id and every ``FAN`` consecutive nodes become their hash until one is left, the source's subroot;
the subroots, ordered by source, make the root in the same way.  On every level the siblings of a node come from windows:
lag and lead columns at the fixed offsets 1 to ``FAN - 1``, masked by the node's slot in its run and the run's length;
the first child of each run hashes the parent.

Only digests and ids are shuffled.  Rows are numbered by a range sort that cuts a hot source over many parts, a window
holds one run, and proofs go down from the root: a parent's siblings reach its children by a join on the run, which has
the windows' own partitioning.

Defined results: null fields are written ``-``; a null source is the first source, null ids come first in their source.
Rows of equal id ascend by leaf; rows equal in all fields are leaves of their own.  A null id counts as the empty text for
the choice of tampered rows.  A source of one row has that leaf as its subroot, a table of one source that subroot as its
root; without any sibling the proof is the hash of the empty text.  Only the five columns of ``documents`` count, others
are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilebook.llm.common import fold, landed, placed

FAN = 16
#: Largest number of sources whose first places are broadcast; more are joined by a shuffle.
MOST_SOURCES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """Byte count, colon and value; ``-`` for a null."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*(field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text))), 256))


def hashed(digests: Column) -> Column:
    """sha256 of digests (binary, one behind the other) written as lowercase hex, as a binary digest."""
    return F.unhex(F.sha2(F.lower(F.hex(digests)), 256))


def shown(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, tampered (null where not tampered with), g (one number per source, in order), pos, n (rows of the source)."""
    lowered = F.translate(F.col("text"), UPPER, LOWER)
    d = docs.select("doc_id", "source", leaf_of(F.col("text")).alias("leaf"),
                    F.when(fold(F.col("doc_id"), 5) == 0, leaf_of(lowered)).alias("tampered"))
    # Landed before the range sort, whose sampling would read and hash the texts a second time.
    d = landed(d, "leaves").withColumn("tie", F.monotonically_increasing_id())
    order = ["source", "doc_id", "leaf", "tie"]
    ranked = placed(landed(d.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie"), "ordered"))
    sources = landed(ranked.groupBy(F.col("source").alias("s")).agg(F.min("place").alias("g"), F.count("*").alias("n")), "sources")
    few = sources.count() <= MOST_SOURCES
    return ranked.join(F.broadcast(sources) if few else sources, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "leaf", "tampered", "g", (F.col("place") - F.col("g")).alias("pos"), "n")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """``nodes`` (g, pos, n, digest) with up (the run) and left, right: the digests of the run's others, in order."""
    slot = F.pmod("pos", F.lit(FAN))
    run = F.least(F.lit(FAN), F.col("n") - F.col("pos") + slot)
    w = Window.partitionBy("g", "up").orderBy("pos")
    nothing = F.lit(b"")
    left = [F.when(slot >= k, F.lag("digest", k).over(w)) for k in range(FAN - 1, 0, -1)]
    right = [F.when(slot + k < run, F.lead("digest", k).over(w)) for k in range(1, FAN)]
    return nodes.withColumn("up", F.floor(F.col("pos") / FAN)).select(
        "*", F.concat(*(F.coalesce(x, nothing) for x in left)).alias("left"), F.concat(*(F.coalesce(x, nothing) for x in right)).alias("right"))


def parents(level: DataFrame) -> DataFrame:
    """The next level: the first child of each run hashes its parent; the single node of a group passes as it is."""
    own = F.when(F.col("n") == 1, F.col("digest")).otherwise(hashed(F.concat("digest", "right")))
    return level.filter(F.pmod("pos", F.lit(FAN)) == 0).select("g", F.col("up").alias("pos"), F.ceil(F.col("n") / FAN).alias("n"), own.alias("digest"))


def upper_levels(nodes: DataFrame) -> list[DataFrame]:
    """The landed levels above ``nodes``, with siblings; the last has one node per group."""
    out = [landed(with_siblings(parents(with_siblings(nodes))), "level")]
    while not out[-1].filter("n > 1").isEmpty():
        out.append(landed(with_siblings(parents(out[-1])), "level"))
    return out


def tops(levels: list[DataFrame]) -> DataFrame:
    return levels[-1].select("g", "digest")


def down(level: DataFrame, above: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` of each node, its path (the siblings on every level up to the root) and the constants of its group."""
    a = above.select(F.col("g").alias("a_g"), F.col("pos").alias("a_pos"), F.col("path").alias("a_path"), "subroot", "root")
    step = F.array(F.struct("left", "right"))
    path = F.when(F.col("n") == 1, F.col("a_path")).otherwise(F.concat(step, F.col("a_path")))
    return level.join(a, (F.col("g") == F.col("a_g")) & (F.col("up") == F.col("a_pos"))).select(*keep, path.alias("path"), "subroot", "root")


def paths(levels: list[DataFrame], start: DataFrame) -> DataFrame:
    """g, pos, path, subroot, root of the lowest of ``levels``; ``start`` has path, subroot and root of each group's top."""
    s = start.select(F.col("g").alias("s_g"), "path", "subroot", "root")
    out = levels[-1].join(s, F.col("g") == F.col("s_g")).select("g", "pos", "path", "subroot", "root")
    for level in reversed(levels[:-1]):
        out = landed(down(level, out, ["g", "pos"]), "paths")
    return out


def source_tree(subroots: DataFrame) -> DataFrame:
    """g, path, subroot, root of each source; ``subroots`` has g and digest, ordered by g."""
    ordered = placed(landed(subroots.repartitionByRange("g").sortWithinPartitions("g"), "subroots"))
    total = ordered.agg(F.count("*")).scalar()
    nodes = ordered.select(F.lit(0).cast("long").alias("g"), F.col("place").alias("pos"), total.alias("n"), "digest", F.col("g").alias("source_g"))
    levels = upper_levels(nodes.drop("source_g"))
    top = tops(levels).select("g", F.array().cast("array<struct<left:binary,right:binary>>").alias("path"),
                              F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    own = down(with_siblings(nodes), paths(levels, top), ["source_g", "digest"])
    return landed(own.select(F.col("source_g").alias("g"), "path", F.col("digest").alias("subroot"), "root"), "source-paths")


def manifest(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, source_rows."""
    rows = landed(leaves(docs), "numbered")
    levels = upper_levels(rows.select("g", "pos", "n", F.col("leaf").alias("digest")))
    above = paths(levels, source_tree(tops(levels)))
    leaf_level = with_siblings(rows.withColumnRenamed("leaf", "digest"))
    d = down(leaf_level, above, ["doc_id", "digest", "tampered", "n"])
    siblings = F.aggregate("path", F.lit(b""), lambda acc, x: F.concat(acc, x["left"], x["right"]))
    folded = F.aggregate("path", F.coalesce("tampered", "digest"), lambda acc, x: hashed(F.concat(x["left"], acc, x["right"])))
    d = d.select("doc_id", "digest", "subroot", "root", "n", shown(hashed(siblings)).alias("proof_sha256"), folded.alias("folded"))
    return d.select("doc_id", shown(F.col("digest")).alias("leaf"), shown(F.col("subroot")).alias("subroot"), shown(F.col("root")).alias("root"),
                    "proof_sha256", shown(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
                    F.col("n").alias("source_rows"))


#: crc32 of a text's UTF-8 bytes, DuckDB has none: {bytes} is a list of byte values, ``crc_table`` the usual 256 entries.
CRC_TABLE = """crc_bits(i, v, k) AS (
    SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) AS t(i)
    UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc_bits WHERE k < 8),
  crc_table AS (SELECT list(v ORDER BY i) AS entries FROM crc_bits WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """DuckDB expression for the unsigned crc32 of ``text`` beside ``crc_table``."""
    values = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {values}), lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])))"


def leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_LOWERED = f"translate(text, '{UPPER}', '{LOWER}')"

ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
  leaf AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
    FROM (SELECT doc_id, source, {leaf_sql('text')} AS leaf,
                 CASE WHEN {crc_sql("coalesce(doc_id::VARCHAR, '')")} % 5 = 0 THEN {leaf_sql(_LOWERED)} END AS tampered
          FROM documents, crc_table)),
  node AS (
    SELECT 0 AS lvl, coalesce('=' || source, '') AS grp, pos, n, leaf AS digest FROM leaf
    UNION ALL
    SELECT lvl + 1, grp, pos // 16, (max(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY lvl, grp, pos // 16),
  top AS (SELECT grp, digest, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1),
  high AS (
    SELECT 0 AS lvl, pos, n, digest FROM top
    UNION ALL
    SELECT lvl + 1, pos // 16, (max(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lvl, pos // 16),
  every AS (SELECT lvl, grp, pos, n, digest FROM node UNION ALL SELECT lvl, 'root', pos, n, digest FROM high),
  sibling AS (
    SELECT a.lvl, a.grp, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
           coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM every a JOIN every b ON a.lvl = b.lvl AND a.grp = b.grp AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY a.lvl, a.grp, a.pos),
  walk AS (
    SELECT 0 AS step, row_number() OVER () AS id, doc_id, leaf, coalesce('=' || source, '') AS home, 0 AS lvl, coalesce('=' || source, '') AS grp, pos,
           '' AS seen, coalesce(tampered, leaf) AS folded FROM leaf
    UNION ALL
    SELECT step + 1, id, doc_id, leaf, home, CASE WHEN s.lvl IS NULL THEN 0 ELSE w.lvl + 1 END, CASE WHEN s.lvl IS NULL THEN 'root' ELSE w.grp END,
           CASE WHEN s.lvl IS NULL THEN t.pos ELSE w.pos // 16 END, seen || coalesce(s.l || s.r, ''), CASE WHEN s.lvl IS NULL THEN folded ELSE sha256(s.l || folded || s.r) END
    FROM walk w LEFT JOIN sibling s ON s.lvl = w.lvl AND s.grp = w.grp AND s.pos = w.pos JOIN top t ON t.grp = w.home
    WHERE s.lvl IS NOT NULL OR w.grp <> 'root')
SELECT doc_id, leaf, top.digest AS subroot, high.digest AS root, sha256(seen) AS proof_sha256, folded AS folded_root, folded = high.digest AS verified,
       count(*) OVER (PARTITION BY home) AS source_rows
FROM (SELECT * FROM walk QUALIFY step = max(step) OVER (PARTITION BY id)) w JOIN top ON top.grp = w.home, high WHERE high.n = 1
"""
