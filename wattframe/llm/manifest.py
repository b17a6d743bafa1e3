"""Merkle manifest of a dataset: 16-ary hash trees per source, stored as van Emde Boas blocks.

The nodes of a tree are cut into aligned subtrees of ``16 ** LEVELS`` leaves, one
row each. Inside a row, nodes lie in van Emde Boas order: the subtree is split
at half its height, the top half comes first, then each bottom half whole, and
both are laid out by the same rule. Address arithmetic alone finds a node and
its siblings, so any run of siblings and its parent lie together whatever the
size of a page. The roots of the blocks are the leaves of the next tier, up to
one block a source; the sources' roots are one more such forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattframe.llm.common import crc32_sql, keep, partitions, shared_dir
from wattframe.llm.lines import SMALL, UPPER

ARITY = 16
#: Levels of hashing inside one block.
LEVELS = 3
DIGEST = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree that holds the roots of all sources.
TOP = ""


def nodes_in(height: int) -> int:
    return (ARITY**height - 1) // (ARITY - 1)


def address(depth: int, index: np.ndarray, height: int) -> np.ndarray:
    """Places, in van Emde Boas order, of nodes ``index`` at ``depth`` (0: root) of a subtree of ``height`` node levels."""
    if height == 1:
        return np.zeros_like(index)
    top = height // 2
    if depth < top:
        return address(depth, index, top)
    subtree, inner = np.divmod(index, ARITY ** (depth - top))
    bottom = height - top
    return nodes_in(top) + subtree * nodes_in(bottom) + address(depth - top, inner, bottom)


@lru_cache
def places(depth: int, height: int) -> np.ndarray:
    return address(depth, np.arange(ARITY**depth), height)


def height_of(n: int, alone: bool, levels: int) -> int:
    """Node levels of a block of ``n`` leaves; a block that is alone ends where one node remains."""
    if not alone:
        return levels + 1
    height = 1
    while ARITY ** (height - 1) < n:
        height += 1
    return height


def fold_run(run: bytes) -> bytes:
    """The digest of a run of digests, each written as hexadecimal text."""
    return sha256(run.hex().encode()).digest()


def build_block(leaves: bytes, height: int) -> bytes:
    """All nodes over ``leaves`` (digests one after the other) in van Emde Boas order; missing ones are zero."""
    store = np.zeros((nodes_in(height), DIGEST), np.uint8)
    level = leaves
    for depth in range(height - 1, -1, -1):
        n = len(level) // DIGEST
        store[places(depth, height)[:n]] = np.frombuffer(level, np.uint8).reshape(n, DIGEST)
        step = ARITY * DIGEST
        level = b"".join(fold_run(level[i : i + step]) for i in range(0, len(level), step))
    return store.tobytes()


class Block:
    """Siblings of a stored block's nodes, from the leaf level up to its root."""

    def __init__(self, nodes: bytes, n: int, height: int):
        self.store = np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)
        self.n, self.height = n, height
        self.known: dict[tuple[int, int], bytes] = {}

    def run(self, depth: int, first: int) -> bytes:
        """The run of siblings that begins at node ``first`` of a level."""
        if (depth, first) not in self.known:
            n = -(-self.n // ARITY ** (self.height - 1 - depth))
            own = np.arange(first, min(first + ARITY, n))
            self.known[depth, first] = self.store[address(depth, own, self.height)].tobytes()
        return self.known[depth, first]

    def path(self, leaf: int) -> list[bytes]:
        """Left and right siblings of a leaf, then of its parent, and so on."""
        out, index = [], leaf
        for depth in range(self.height - 1, 0, -1):
            first = index - index % ARITY
            run, at = self.run(depth, first), (index - first) * DIGEST
            out += [run[:at], run[at + DIGEST :]]
            index //= ARITY
        return out


def climb(leaf: bytes, path: list[bytes]) -> bytes:
    """The root that follows from a leaf and its siblings."""
    for left, right in zip(path[::2], path[1::2], strict=True):
        leaf = fold_run(left + leaf + right)
    return leaf


# Leaves and their positions


def field(value: Column) -> Column:
    """One field of a leaf: ``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256))


def tree_of(source: Column) -> Column:
    """Name of a source's tree; in byte order null comes first, then all sources."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def positions(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``pos``, their place in their ``tree`` by ``order``, counted from 0.

    Ranges of (tree, order) are sorted by themselves, so a tree of a third of
    all rows is many ranges. Only one count per tree and range is then summed
    up. Rows that tie in ``order`` may trade places.
    """
    ranges = rows.repartitionByRange(partitions(rows.sparkSession), "tree", *order).sortWithinPartitions("tree", *order)
    placed = keep(ranges.withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("at", 33))
    starts = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shift = starts.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    found = placed.join(shift, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift"))
    return found.drop("at", "part", "shift")


# Forests of blocks


def _tier(nodes: DataFrame) -> DataFrame:
    """Blocks over the nodes (tree, pos, digest) of one tier."""
    levels, span = LEVELS, ARITY**LEVELS
    grouped = nodes.groupBy("tree", F.expr(f"pos div {span}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("leaves")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tree, block, leaves in zip(*(b.column(c) for c in ("tree", "block", "digests")), strict=True):
                own = b"".join(leaves.as_py())
                n = len(own) // DIGEST
                height = height_of(n, block.as_py() == 0 and n < span, levels)
                stored = build_block(own, height)
                yield pa.record_batch(
                    [pa.array([tree.as_py()]), pa.array([block.as_py()]), pa.array([n]), pa.array([height]), pa.array([stored[:DIGEST]]), pa.array([stored])],
                    ["tree", "block", "n", "height", "root", "nodes"],
                )

    flat = grouped.select("tree", "block", F.col("leaves.digest").alias("digests"))
    return flat.mapInArrow(run, "tree string, block long, n long, height long, root binary, nodes binary")


class Forest:
    """Tiers of blocks: ``tiers[0]`` holds the leaves, each next one the roots of the blocks below."""

    def __init__(self, tiers: list[DataFrame]):
        self.tiers = tiers

    @classmethod
    def build(cls, nodes: DataFrame, path: str) -> Forest:
        """Write all tiers over the nodes (tree, pos, digest) below ``path``; tiers are as many as the largest tree needs."""
        spark, tiers = nodes.sparkSession, []
        while True:
            at = f"{path}/tier={len(tiers)}"
            _tier(nodes).write.parquet(at)
            tiers.append(spark.read.parquet(at))
            nodes = cls._unfinished(tiers[-1]).select("tree", F.col("block").alias("pos"), F.col("root").alias("digest"))
            if nodes.isEmpty():
                return cls(tiers)

    @staticmethod
    def _longer(tier: DataFrame) -> DataFrame:
        """Trees with more than one block, one row each, named with the block they are looked up by."""
        return tier.where("block = 1").select("tree", F.lit(0).cast("long").alias("block"))

    @classmethod
    def _unfinished(cls, tier: DataFrame) -> DataFrame:
        first = tier.where("block = 0").join(cls._longer(tier), ["tree", "block"], "left_semi")
        return tier.where("block > 0").unionByName(first)

    @classmethod
    def _finished(cls, tier: DataFrame) -> DataFrame:
        return tier.where("block = 0").join(cls._longer(tier), ["tree", "block"], "left_anti")

    def roots(self) -> DataFrame:
        """``tree`` and its ``root``."""
        out = self._finished(self.tiers[0]).select("tree", "root")
        for tier in self.tiers[1:]:
            out = out.union(self._finished(tier).select("tree", "root"))
        return out

    def paths(self, above: DataFrame | None = None) -> DataFrame:
        """Per block of the lowest tier: ``path`` from its root upwards, with the columns of ``above``.

        ``above`` (tree, path, more columns) says how it goes on over a tree's
        root. Paths come down tier by tier: each block hands every child block
        the siblings inside it and its own path.
        """
        found: DataFrame | None = None
        for t in range(len(self.tiers) - 1, -1, -1):
            last = self._finished(self.tiers[t]).select("tree", "block")
            if above is None:
                last = last.withColumn("path", F.array().cast("array<binary>"))
            else:
                last = last.join(above, "tree")
            if found is not None:
                last = last.unionByName(_handed_down(self.tiers[t + 1].drop("root").join(found, ["tree", "block"])))
            found = keep(last)
        return found


def _handed_down(blocks: DataFrame) -> DataFrame:
    """For every leaf of the blocks, named as a block of the tier below, its whole path and the blocks' other columns."""
    span = ARITY**LEVELS
    others = [f for f in blocks.schema.fields if f.name not in ("tree", "block", "n", "height", "nodes", "path")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                block, n = Block(row["nodes"], row["n"], row["height"]), row["n"]
                for i in range(0, n, 256):
                    some = range(i, min(i + 256, n))
                    cols = [
                        pa.array([row["tree"]] * len(some)),
                        pa.array([row["block"] * span + k for k in some]),
                        pa.array([block.path(k) + row["path"] for k in some], pa.list_(pa.binary())),
                    ]
                    cols += [pa.array([row[f.name]] * len(some), b.schema.field(f.name).type) for f in others]
                    yield pa.record_batch(cols, ["tree", "block", "path", *[f.name for f in others]])

    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in others)
    return blocks.mapInArrow(run, f"tree string, block long, path array<binary>{more}")


class Manifest:
    """A dataset's forest of sources and the forest of the sources' roots.

    ``leaves`` has one row per document: tree, pos, doc_id, leaf and what else
    was given. Nothing but the number of tiers, which is logarithmic, is decided
    on the driver.
    """

    def __init__(self, leaves: DataFrame, sources: Forest, top: Forest, ranks: DataFrame):
        self.leaves, self.sources, self.top, self.ranks = leaves, sources, top, ranks

    @classmethod
    def build(cls, rows: DataFrame, path: str) -> Manifest:
        """Write the manifest of ``rows`` (tree, doc_id, leaf, more columns) below the new folder ``path``."""
        spark = rows.sparkSession
        positions(keep(rows), F.col("doc_id").asc_nulls_first(), F.col("leaf")).write.parquet(f"{path}/leaves")
        leaves = spark.read.parquet(f"{path}/leaves")
        sources = Forest.build(leaves.select("tree", "pos", F.col("leaf").alias("digest")), f"{path}/sources")
        named = sources.roots().select(F.lit(TOP).alias("tree"), F.col("tree").alias("source"), F.col("root").alias("digest"))
        positions(named, F.col("source")).write.parquet(f"{path}/ranks")
        ranks = spark.read.parquet(f"{path}/ranks")
        return cls(leaves, sources, Forest.build(ranks.select("tree", "pos", "digest"), f"{path}/top"), ranks)

    def _above(self) -> DataFrame:
        """How paths go on over each source's root, with that root and the root of all."""
        whole = self.top.roots().select("tree", F.array().cast("array<binary>").alias("path"), "root")
        found = _handed_down(self.top.tiers[0].drop("root").join(self.top.paths(whole), ["tree", "block"]))
        ranks = self.ranks.select("pos", "source", F.col("digest").alias("subroot"))
        return found.select(F.col("block").alias("pos"), "path", "root").join(ranks, "pos").select(
            F.col("source").alias("tree"), "path", "subroot", "root"
        )

    def verify(self, claims: DataFrame) -> DataFrame:
        """Fold each claim (tree, pos, doc_id, claimed; null: the stored leaf) with the stored siblings.

        Returned: doc_id, leaf, subroot, root, proof_sha256 (digest of all
        siblings from the leaf up), folded_root and verified. Claims are handled
        block by block, so a leaf should be claimed a bounded number of times.
        """
        span = ARITY**LEVELS
        groups = claims.groupBy("tree", F.expr(f"pos div {span}").alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("pos", "doc_id", "claimed"))).alias("claims")
        )
        blocks = self.sources.tiers[0].select("tree", "block", "n", "height", "nodes")
        rows = groups.join(blocks, ["tree", "block"]).join(self.sources.paths(self._above()), ["tree", "block"])
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    block, out = Block(row["nodes"], row["n"], row["height"]), []
                    for c in row["claims"]:
                        at = c["pos"] % span
                        first = at - at % ARITY
                        own = block.run(row["height"] - 1, first)[(at - first) * DIGEST :][:DIGEST]
                        path = block.path(at) + row["path"]
                        folded = climb(c["claimed"] or own, path)
                        proof = sha256(b"".join(path).hex().encode()).hexdigest()
                        out.append(
                            (c["doc_id"], own.hex(), row["subroot"].hex(), row["root"].hex(), proof, folded.hex(), folded == row["root"])
                        )
                    yield pa.record_batch([pa.array(x) for x in zip(*out, strict=True)], names)

        return rows.select("claims", "n", "height", "nodes", "path", "subroot", "root").mapInArrow(
            run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        )


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``tree``, ``doc_id``, ``leaf`` and ``claimed`` of each row.

    ``tampered`` tells of which rows another text is claimed: one in which A-Z
    are lower-cased. Of all others ``claimed`` is null.
    """
    text = F.col("text")
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, SMALL))
    claimed = leaf([lowered if c == "text" else F.col(c) for c in FIELDS])
    return docs.select(
        tree_of(F.col("source")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf([F.col(c) for c in FIELDS]).alias("leaf"),
        F.when(F.lit(False) if tampered is None else tampered, claimed).alias("claimed"),
    )


def audited(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the manifest of ``docs``, tamper with every fifth row (by crc32 of its id) and verify every row.

    A null in any field is written as ``-``; a null source is a tree of its own
    and comes first. A null id comes first in its source and is never tampered
    with. Rows with equal ids are ordered by their leaves, so identical rows get
    neighbouring places. An empty table gives no rows. A very long text is
    hashed in one row; only digests are shuffled. Extra columns are not read.
    """
    spark = docs.sparkSession
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    built = Manifest.build(leaves(docs, tampered), path or shared_dir(spark))
    return built.verify(built.leaves)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    """The same trees level by level: every run of 16 nodes is one row, a leaf's path the runs above it."""

    def field(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    head = " || ".join(field(c) for c in FIELDS[:-1])
    up = """SELECT tree, lvl + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 15) // 16)
  FROM {0} WHERE n > 1 GROUP BY tree, lvl, pos // 16"""
    runs = """SELECT tree, lvl, pos // 16 AS run, list(digest ORDER BY pos) AS own FROM {0} WHERE n > 1 GROUP BY tree, lvl, pos // 16"""
    path = """SELECT l.{1}, r.lvl, array_to_string(r.own[:(l.pos // CAST(power(16, r.lvl) AS BIGINT)) % 16], '') AS lft,
  array_to_string(r.own[(l.pos // CAST(power(16, r.lvl) AS BIGINT)) % 16 + 2:], '') AS rgt
  FROM {0} l JOIN {2} r ON r.tree = l.tree AND r.run = l.pos // CAST(power(16, r.lvl + 1) AS BIGINT)"""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('s' || source, 'n') AS tree, {head} AS head, text, translate(text, '{UPPER}', '{SMALL}') AS low,
  hex(encode(CAST(doc_id AS VARCHAR))) AS bytes FROM documents),
h AS (SELECT doc_id, tree, sha256(head || {field("text")}) AS leaf, sha256(head || {field("low")}) AS bad, {crc32_sql("bytes")} % 5 = 0 AS tampered FROM d),
leaves AS MATERIALIZED (SELECT *, CASE WHEN tampered THEN bad ELSE leaf END AS claimed, row_number() OVER () AS k,
  row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM h),
nodes AS (SELECT tree, 0 AS lvl, pos, leaf AS digest, n FROM leaves UNION ALL {up.format("nodes")}),
subs AS MATERIALIZED (SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS pos, digest, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT tree, 0 AS lvl, pos, digest, n FROM subs UNION ALL {up.format("tops")}),
r1 AS MATERIALIZED ({runs.format("nodes")}), r2 AS MATERIALIZED ({runs.format("tops")}),
p1 AS ({path.format("leaves", "k", "r1")}), p2 AS ({path.format("subs", "name", "r2")}),
steps AS (SELECT k, lvl, lft, rgt FROM p1 UNION ALL SELECT k, lvl + 100, lft, rgt FROM p2 JOIN leaves ON tree = name),
paths AS (SELECT k, string_agg(lft || rgt, '' ORDER BY lvl) AS siblings, list(lft || '|' || rgt ORDER BY lvl) AS path FROM steps GROUP BY k),
f AS (SELECT l.doc_id, l.leaf, s.digest AS subroot, (SELECT digest FROM tops WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
  list_reduce(list_prepend(claimed, coalesce(path, [])), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root
  FROM leaves l JOIN subs s ON s.name = l.tree LEFT JOIN paths USING (k))
SELECT *, folded_root = root AS verified FROM f"""


SQL = _sql()
