"""Merkle manifest of a dataset: a ternary hash tree over the rows of each source, and one over the sources.

H is the lowercase hex SHA-256 of its inputs concatenated, digests as hex text. A leaf is H of a row's
fields; nodes of a level join in runs of ``FAN`` (the last run has fewer, even one) until one is left.

The tree is built from blocks that are aligned with it: ``FAN ** HEIGHT`` consecutive nodes are one block,
whose subtree a recursive postorder traversal climbs: it returns the digest of the subtree and, while
unwinding, appends to every leaf below the siblings that its run had. The roots of all blocks are the nodes
of the next, distributed traversal, until every source has one. The sources' roots are nodes of one more
tree of the same kind. Going down again, each block is climbed with the path of its own root, which is
appended to those of its leaves. A path is text: one step a level, the siblings on the left, ``|``, those on
the right; steps are parted by ``/``.

Cases: a null field is ``-``; null source is a source of its own, before all others; null ids come first;
rows that repeat an id follow each other in the order of their leaves; a source of one row has its leaf as
root; an empty table gives no rows. A row without an id isn't tampered with. Other columns play no part.

Scale: texts are read once, in a map that leaves two digests a row. Nodes are numbered without a window over
rows: sorted by range, written, and counted by (group, file range), so a source with most of the rows is
spread over all tasks; blocks are groups of at most FAN ** HEIGHT rows of a few hundred bytes. Each further
level has FAN ** HEIGHT times fewer rows. Only digests are shuffled, twice a level; the longest list
on the driver is that of the levels.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.kernel import tidy
from corvane.runtime import Workspace, arrow_rows, ship_package, table

FAN = 3
HEIGHT = 6
BLOCK = FAN**HEIGHT
_CLIMBED = "grp string, pos long, size long, key string, digest string, changed string, path string, subroot string, root string"


def _hash(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def rounds(nodes: int) -> int:
    """Levels above that many nodes."""
    n = 0
    while nodes > 1:
        nodes, n = -(-nodes // FAN), n + 1
    return n


def climb(digests: list[str], first: int, last: int, height: int, paths: list[list[str]]) -> str:
    """Digest of the subtree of this height over digests[first:last]; the siblings of each run go to the leaves below."""
    if height == 0:
        return digests[first]
    step = FAN ** (height - 1)
    parts = [(at, min(at + step, last)) for at in range(first, last, step)]
    found = [climb(digests, at, end, height - 1, paths) for at, end in parts]
    for i, (at, end) in enumerate(parts):
        siblings = "".join(found[:i]) + "|" + "".join(found[i + 1 :])
        for leaf in range(at, end):
            paths[leaf].append(siblings)
    return _hash(*found)


def _field(column: Column) -> Column:
    """A value in a leaf: its bytes, a colon, the value; null is a dash."""
    said = column.cast("string")
    return F.when(said.isNull(), "-").otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))


def leaf_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*[_field(c) for c in columns]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """Root recomputed from a leaf and its path."""
    return F.when(path == "", leaf).otherwise(F.aggregate(F.split(path, "/"), leaf, lambda digest, step: F.sha2(F.replace(step, F.lit("|"), digest), 256)))


def proof_digest(path: Column) -> Column:
    """H of all siblings on a path."""
    return F.sha2(F.translate(path, "|/", ""), 256)


def numbered(nodes: DataFrame, order: list[str], work: Workspace, name: str) -> DataFrame:
    """nodes with pos, from 0 in the order within their grp, and the size of grp."""
    ranged = nodes.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    rows = work.write(ranged.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33)), f"{name}-sorted")
    runs = work.write(rows.groupBy("grp", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")), f"{name}-runs")
    ordered = Window.partitionBy("grp").orderBy("part")  # rows: the file ranges that a group is in
    ahead = F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    counted = runs.select("grp", "part", (ahead - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy("grp")).alias("size"))
    return rows.join(counted, ["grp", "part"]).select("*", (F.col("row") + F.col("shift")).alias("pos")).drop("row", "part", "shift")


def _climbed(rows: DataFrame, with_paths: bool) -> DataFrame:
    """Blocks of nodes climbed, one after the other, in the order of their rows.

    A row of a block with a negative pos brings the path of the block's root. with_paths: all nodes with
    their paths, else the roots of the blocks.
    """
    dealt = rows.withColumn("block", F.greatest(F.floor(F.col("pos") / BLOCK), F.col("above"))).drop("above").repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
    columns = ["grp", "block", "pos", "size", "key", "digest", "changed", "path", "subroot", "root"]

    def block_rows(block):
        over = block[0] if block[0][2] < 0 else None
        nodes = block[1:] if over else block
        if not nodes:
            return []
        size, digests = nodes[0][3], [r[5] for r in nodes]
        paths = [[] for _ in nodes]
        height = min(HEIGHT, rounds(size))
        root = climb(digests, 0, len(digests), height, paths)
        if not with_paths:
            return [(nodes[0][0], nodes[0][1], -(-size // FAN**height), None, root, None, None, None, None)]
        upper = [over[7]] if over[7] else []
        return [(r[0], r[2], r[3], r[4], r[5], r[6], "/".join([*p, *upper]), over[8], over[9]) for r, p in zip(nodes, paths)]

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:2] != row[:2]:
                    out += block_rows(held)
                    held = []
                held.append(row)
            if out:
                yield _batch(out)
        if held:
            yield _batch(block_rows(held))

    return dealt.select(*columns).mapInArrow(tidy(run), _CLIMBED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6]
    columns = zip(*rows) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["grp", "pos", "size", "key", "digest", "changed", "path", "subroot", "root"])


def _as_rows(nodes: DataFrame) -> DataFrame:
    """Nodes in the columns of _climbed; those that a table lacks are null."""
    have, kinds = set(nodes.columns), {"pos": "long", "size": "long", "above": "long"}
    names = ["grp", "pos", "above", "size", "key", "digest", "changed", "path", "subroot", "root"]
    return nodes.select(*[F.col(c).cast(kinds.get(c, "string")) if c in have else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in names])


def levels_of(nodes: DataFrame, work: Workspace, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the nodes of each round (grp, pos, size, key, digest, changed), and the roots (grp, digest)."""
    levels, roots = [work.write(nodes, f"{name}-0")], []
    while True:
        several = levels[-1].where("size > 1")
        roots.append(levels[-1].where("size = 1").select("grp", "digest"))
        if several.isEmpty():
            break
        above = work.write(_climbed(_as_rows(several), False), f"{name}-{len(levels)}")
        levels.append(above)
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return levels, found


def paths_of(levels: list[DataFrame], tops: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Nodes of the first level with their paths. tops: (grp, path, subroot, root), one row a group."""
    above = None
    for i in reversed(range(len(levels))):
        nodes = levels[i]
        # a block's root is a node of the next level; where that is the root of a group, its path is the group's
        sizes = nodes.where("pos = 0").select("grp", F.ceil(F.col("size") / BLOCK).alias("blocks"))
        heads = tops.join(sizes.where("blocks = 1"), "grp").select("grp", F.lit(0).alias("above"), "path", "subroot", "root")
        if above is not None:
            heads = heads.unionByName(above.where("size > 1").select("grp", F.col("pos").alias("above"), "path", "subroot", "root"))
        both = _as_rows(nodes).unionByName(_as_rows(heads.withColumn("pos", F.lit(-1))))
        above = work.write(_climbed(both, True), f"{name}-paths-{i}")
    return above


def manifest(rows: DataFrame, digest: Column, changed: Column, source: Column, id: Column, label: str = "merkle") -> DataFrame:
    """One row a row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, path.

    digest: the leaf of a row. changed: the leaf that is checked against the tree (equal where nothing was
    tampered with). Trees are by source, ordered by id.
    """
    spark = rows.sparkSession
    ship_package(spark)
    arrow_rows(spark, 10_000)
    work = Workspace(spark, label)
    leaves = rows.select(F.coalesce(F.concat(F.lit("="), source), F.lit("-")).alias("grp"), id.cast("long").alias("id"), digest.alias("digest"), changed.alias("changed"))
    nodes = numbered(leaves, ["id", "digest", "changed"], work, "rows").withColumn("key", F.col("id").cast("string"))
    levels, subroots = levels_of(nodes.drop("id"), work, "rows")
    # "-" sorts before "=", so the null source is first
    sources = numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), "digest"), ["key"], work, "sources")
    upper, root = levels_of(sources, work, "sources")
    top = root.select("grp", F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    tops = paths_of(upper, top, work, "sources").select(F.col("key").alias("grp"), "path", F.col("digest").alias("subroot"), "root")
    found = paths_of(levels, work.write(tops, "tops"), work, "rows")
    folded = fold(F.coalesce(F.col("changed"), F.col("digest")), F.col("path"))
    out = found.select(F.col("key").cast("long").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"), "path")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def document_manifest(docs: DataFrame) -> DataFrame:
    """Manifest of documents, where those whose id has an even crc32 are checked without their line ends."""
    ahead = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    ends = even & F.contains(F.col("text"), F.lit("\n"))
    changed = F.when(ends, leaf_digest(*ahead, F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    return manifest(docs, leaf_digest(*ahead, F.col("text")), changed, F.col("source"), F.col("doc_id"))


def op11_merkle_manifest(spark, sf_dir):
    """Contract query over all documents."""
    return document_manifest(table(spark, sf_dir, "documents")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: The manifest in SQL: crc32 by table, levels by a recursive query over whole tables, paths by joins.
OP11_SQL = """
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i)) x),
  d AS (SELECT *, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS g,
      coalesce(xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 2 = 0, false) AS even
    FROM documents, crc),
  f AS (SELECT doc_id, g, even, text, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head FROM d),
  h AS (SELECT doc_id, g, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
      sha256(head || CASE WHEN text IS NULL THEN '-' WHEN even THEN strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '') ELSE strlen(text) || ':' || text END) AS checked FROM f),
  n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, checked) - 1 AS pos FROM h),
  up(g, lvl, pos, digest) AS (SELECT g, 0, pos, leaf FROM n
    UNION ALL SELECT g, lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM up) u WHERE c > 1 GROUP BY g, lvl, pos // 3),
  sub AS (SELECT g, max_by(digest, lvl) AS subroot FROM up GROUP BY 1),
  sn AS (SELECT *, row_number() OVER (ORDER BY g) - 1 AS pos FROM sub),
  top(lvl, pos, digest) AS (SELECT 0, pos, subroot FROM sn
    UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS c FROM top) u WHERE c > 1 GROUP BY lvl, pos // 3),
  every AS (SELECT g, lvl, pos, digest FROM up UNION ALL SELECT NULL, lvl, pos, digest FROM top),
  sib AS (SELECT g, lvl, pos, coalesce(string_agg(digest, '') OVER (PARTITION BY g, lvl, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
      coalesce(string_agg(digest, '') OVER (PARTITION BY g, lvl, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r, count(*) OVER (PARTITION BY g, lvl) AS c FROM every),
  sp AS (SELECT sn.g, coalesce(list({'l': sib.l, 'r': sib.r} ORDER BY sib.lvl) FILTER (sib.lvl IS NOT NULL), []) AS path FROM sn LEFT JOIN sib ON sib.g IS NULL AND sib.c > 1 AND sib.pos = sn.pos // CAST(pow(3, sib.lvl) AS BIGINT) GROUP BY 1),
  np AS (SELECT n.g, n.pos, any_value(n.doc_id) AS doc_id, any_value(n.leaf) AS leaf, any_value(n.checked) AS checked, coalesce(list({'l': sib.l, 'r': sib.r} ORDER BY sib.lvl) FILTER (sib.lvl IS NOT NULL), []) AS own
    FROM n LEFT JOIN sib ON sib.g = n.g AND sib.c > 1 AND sib.pos = n.pos // CAST(pow(3, sib.lvl) AS BIGINT) GROUP BY 1, 2),
  p AS (SELECT np.*, list_concat(own, sp.path) AS path, sub.subroot, (SELECT max_by(digest, lvl) FROM top) AS root FROM np JOIN sp ON sp.g = np.g JOIN sub ON sub.g = np.g),
  o AS (SELECT *, list_reduce(list_prepend({'l': checked, 'r': ''}, path), lambda a, s: {'l': sha256(s.l || a.l || s.r), 'r': ''}).l AS folded_root FROM p)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.l || s.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM o
"""
