"""A Merkle manifest of a table and its versions: a persistent tree whose updates copy paths."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ranks import ranked
from ..session import materialize
from .common import small_batches


@dataclass(frozen=True)
class Shape:
    """fanout   children of a node
    height   levels of an aligned block: one task builds a subtree of fanout ** height nodes"""

    fanout: int = 8
    height: int = 4

    @property
    def block(self) -> int:
        return self.fanout**self.height

    def depth(self, nodes: int) -> int:
        """Levels until one node remains, at most those of a block."""
        levels, reach = 0, 1
        while reach < nodes and levels < self.height:
            levels, reach = levels + 1, reach * self.fanout
        return levels


def digest(text: bytes) -> bytes:
    return hashlib.sha256(text).hexdigest().encode()


Side = tuple[bytes, bytes]  # the siblings on the left and on the right, each as one text


class Tree:
    """One aligned block. Digests are hex texts.

    The tree is persistent: nothing is ever changed. A version is made of the nodes that it
    copies, the changed leaf's ancestors; all others are those of the tree it comes from.
    """

    def __init__(self, leaves: list[bytes], depth: int, fanout: int):
        self.fanout, self.levels = fanout, [leaves]
        for _ in range(depth):
            below = self.levels[-1]
            self.levels.append([digest(b"".join(below[k : k + fanout])) for k in range(0, len(below), fanout)])

    @property
    def top(self) -> bytes:
        return self.levels[-1][0]

    def sides(self, leaf: int) -> list[Side]:
        """The siblings of a leaf and of each of its ancestors below the top."""
        out = []
        for nodes in self.levels[:-1]:
            first = leaf - leaf % self.fanout
            out.append((b"".join(nodes[first:leaf]), b"".join(nodes[leaf + 1 : first + self.fanout])))
            leaf //= self.fanout
        return out


def version(leaf: bytes, sides: Sequence[Side]) -> list[bytes]:
    """The nodes that a version with this leaf copies, from the leaf up to the top."""
    path = [leaf]
    for left, right in sides:
        path.append(digest(left + path[-1] + right))
    return path


def raw(hexed: bytes) -> bytes:
    return bytes.fromhex(hexed.decode())


SIDES = "array<struct<left: binary, right: binary>>"


def climb(tops: DataFrame, shape: Shape) -> DataFrame:
    """(tree, pos, sides, top) for nodes (tree, pos, digest): what stands beside each node's way to
    its tree's top, and that top.

    Aligned blocks of nodes become one node each, in rounds until every tree is one node: a
    round divides the rows by the block. The ways of the rounds are joined from the top down.
    """
    sizes = materialize(tops.groupBy("tree").agg(F.count(F.lit(1)).alias("nodes")), "sizes")
    largest = sizes.agg(F.max("nodes")).first()[0] or 0

    def build(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        tree = Tree([x.hex().encode() for x in block["digest"].to_pylist()], shape.depth(block["nodes"][0].as_py()), shape.fanout)
        sides = [[{"left": a, "right": b} for a, b in tree.sides(k)] for k in range(len(block))]
        return pa.table({
            "tree": block["tree"], "pos": block["pos"], "nodes": block["nodes"],
            "sides": pa.array(sides, pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))),
            "digest": pa.array([raw(tree.top)] * len(block), pa.binary()),
        })

    nodes = tops.join(sizes.withColumnRenamed("tree", "_tree"), F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
    kind = tops.schema["tree"].dataType.simpleString()
    rounds: list[DataFrame] = []
    while True:
        grouped = nodes.withColumn("block", F.floor(F.col("pos") / shape.block)).groupBy("tree", "block")
        rounds.append(materialize(grouped.applyInArrow(build, f"tree {kind}, pos long, nodes long, sides {SIDES}, digest binary"), "climb"))
        if largest <= shape.block:
            break
        largest = -(-largest // shape.block)
        nodes = rounds[-1].where(F.col("pos") % shape.block == 0).select(
            "tree", F.floor(F.col("pos") / shape.block).alias("pos"), "digest", F.ceil(F.col("nodes") / shape.block).alias("nodes")
        )
    ways = rounds.pop().select("tree", "pos", "sides", F.col("digest").alias("top"))
    while rounds:
        above = ways.select(F.col("tree").alias("_tree"), F.col("pos").alias("_pos"), F.col("sides").alias("_sides"), "top")
        below = rounds.pop()
        on = below["tree"].eqNullSafe(above["_tree"]) & (F.floor(below["pos"] / shape.block) == above["_pos"])
        ways = materialize(below.join(above, on).select("tree", "pos", F.concat("sides", "_sides").alias("sides"), "top"), "ways")
    return ways


def field(c: Column | str) -> Column:
    """A value as the leaf states it: `-` if null, else its UTF-8 byte count, `:` and the value."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
OUTPUT = {
    "doc_id": "long", "leaf": "string", "changed_leaf": "string", "subroot": "string", "root": "string", "siblings": "string",
    "siblings_sha256": "string", "version_root": "string", "copied": "array<string>",
}


def _expand(columns: Sequence[str], shape: Shape) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of leaves from rows of blocks that know their way to the root."""
    schema = pa.schema([(c, pa.list_(pa.string()) if OUTPUT[c].startswith("array") else pa.int64() if OUTPUT[c] == "long" else pa.string()) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                leaves = [x.hex().encode() for x in b["leaves"]]
                tree = Tree(leaves, b["depth"], shape.fanout)
                above = [(s["left"], s["right"]) for s in b["sides"]]
                out = {c: [] for c in columns}
                made = {"subroot": b["subroot"].hex(), "root": b["root"].hex()}
                beside = b"".join(left + right for left, right in above)
                for k, (doc_id, changed) in enumerate(zip(b["ids"], b["changed"], strict=True)):
                    sides = tree.sides(k)
                    path = version(changed.hex().encode() if changed else leaves[k], [*sides, *above])
                    siblings = b"".join(left + right for left, right in sides) + beside
                    made |= {"doc_id": doc_id, "leaf": leaves[k].decode(), "changed_leaf": changed.hex() if changed else None, "version_root": path[-1].decode()}
                    if "siblings" in out:
                        made["siblings"] = siblings.decode()
                    if "siblings_sha256" in out:
                        made["siblings_sha256"] = digest(siblings).decode()
                    if "copied" in out:
                        made["copied"] = [x.decode() for x in path[1:]] if changed else []
                    for c, values in out.items():
                        values.append(made[c])
                yield pa.RecordBatch.from_arrays([pa.array(out[c], schema.field(c).type) for c in columns], schema=schema)

    return run


def manifest(
    docs: DataFrame, changed: Column | None = None, changed_text: Column | None = None, columns: Sequence[str] = tuple(OUTPUT), shape: Shape = Shape()
) -> DataFrame:
    """One row per document: its leaf, the subroot of its lang, the root, its proof and its version.

    A leaf is the digest of the five fields of a row. The leaves of a lang ascend by doc_id
    (null first, then by digest), runs of ``fanout`` become one node until one remains, the
    subroot; the subroots by lang (null first, bytewise) likewise give the root. ``siblings``
    is the proof: the nodes beside the way from leaf to root, left to right, level by level.

    Each row where ``changed`` holds starts a version in which its text is ``changed_text``:
    ``changed_leaf`` is its new leaf, ``copied`` the digests of the ancestors it copies, up to
    and with its root ``version_root``; every other node is shared. A row without a change
    gives its own leaf carried up through the same siblings, which is the root.

    Rows are placed by ranges, so a lang with most rows spans many blocks; a task holds one
    block. Repeated rows are leaves of their own, nulls are `-`, an empty text is `0:`. No
    rows give no rows. Further columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = [F.col(c) for c in FIELDS]
    hashed = lambda text: F.unhex(F.sha2(F.concat(*[field(c) for c in parts[:-1]], field(text)), 256))
    new = F.when(changed, hashed(changed_text)) if changed is not None else F.lit(None).cast("binary")
    leaves = docs.select(F.col("lang").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), hashed(F.col("text")).alias("leaf"), new.alias("changed"))
    leaves = ranked(materialize(leaves, "leaves"), [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()], ["tree"], "pos")
    leaves = materialize(leaves, "leaves")
    sizes = leaves.groupBy(F.col("tree").alias("_tree")).agg(F.count(F.lit(1)).alias("nodes"))
    sizes = materialize(sizes, "sizes")

    def build(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        depth = shape.depth(block["nodes"][0].as_py())
        tree = Tree([x.hex().encode() for x in block["leaf"].to_pylist()], depth, shape.fanout)
        return pa.table({
            "tree": block["tree"].slice(0, 1), "pos": pa.array([block["pos"][0].as_py() // shape.block], pa.int64()), "depth": pa.array([depth], pa.int32()),
            "digest": pa.array([raw(tree.top)], pa.binary()), "ids": pa.array([block["doc_id"].to_pylist()], pa.list_(pa.int64())),
            "leaves": pa.array([block["leaf"].to_pylist()], pa.list_(pa.binary())), "changed": pa.array([block["changed"].to_pylist()], pa.list_(pa.binary())),
        })

    sized = leaves.join(sizes, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree").withColumn("block", F.floor(F.col("pos") / shape.block))
    blocks = sized.groupBy("tree", "block").applyInArrow(
        build, "tree string, pos long, depth int, digest binary, ids array<long>, leaves array<binary>, changed array<binary>"
    )
    blocks = materialize(blocks, "blocks")
    ways = climb(blocks.select("tree", "pos", "digest"), shape).select(F.col("tree").alias("_tree"), F.col("pos").alias("_pos"), F.col("sides").alias("below"), F.col("top").alias("subroot"))
    ways = materialize(ways, "ways")
    subroots = ranked(ways.where("_pos = 0").select(F.col("_tree").alias("lang"), F.col("subroot").alias("digest")), [F.col("lang").asc_nulls_first()], (), "pos")
    subroots = materialize(subroots.withColumn("tree", F.lit("")), "subroots")
    roots = climb(subroots.select("tree", "pos", "digest"), shape).select(F.col("pos").alias("_at"), F.col("sides").alias("above"), F.col("top").alias("root"))
    langs = materialize(subroots.join(roots, F.col("pos") == F.col("_at")).select(F.col("lang").alias("_lang"), "above", "root"), "langs")
    known = blocks.join(ways, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("pos") == F.col("_pos")))
    known = known.join(langs, F.col("tree").eqNullSafe(F.col("_lang")))
    known = known.select("ids", "leaves", "changed", "depth", F.concat("below", "above").alias("sides"), "subroot", "root")
    return known.mapInArrow(_expand(columns, shape), ", ".join(f"{c} {OUTPUT[c]}" for c in columns))


ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tampered(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Every third document tampered with, by the checksum of its id: its capitals A-Z are lowered.

    doc_id, leaf, subroot, root, proof_sha256, folded_root (the version's root) and verified
    (whether that is the root)."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 3 == 0, F.lit(False))
    rows = manifest(docs, hit, F.translate("text", ALPHABET, ALPHABET.lower()), ("doc_id", "leaf", "subroot", "root", "siblings_sha256", "version_root"), shape)
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.col("siblings_sha256").alias("proof_sha256"), F.col("version_root").alias("folded_root"),
        (F.col("version_root") == F.col("root")).alias("verified"),
    )


# The same in SQL: lists of nodes by level, and a walk up for every document.
SQL = """
WITH RECURSIVE h AS (
  SELECT doc_id, lang, text, 'x' || CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
    || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
    || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head
  FROM documents),
c AS (  -- crc32 of the decimal doc_id, bit by bit
  SELECT DISTINCT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::BIGINT) ELSE r // 2 END)), 4294967295::BIGINT) AS crc
  FROM documents WHERE doc_id IS NOT NULL),
t AS (
  SELECT doc_id, lang, sha256(head[2:] || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    sha256(head[2:] || CASE WHEN text IS NULL THEN '-' WHEN crc % 3 = 0 THEN strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      ELSE strlen(text) || ':' || text END) AS changed
  FROM h LEFT JOIN c USING (doc_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM t),
low AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(0, len(nodes), 8), lambda i: sha256(array_to_string(nodes[i + 1 : i + 8], ''))) FROM low WHERE len(nodes) > 1),
sub AS (SELECT lang, level AS depth, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM low WHERE len(nodes) = 1),
top AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM sub
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes), 8), lambda i: sha256(array_to_string(nodes[i + 1 : i + 8], ''))) FROM top WHERE len(nodes) > 1),
every AS (  -- the levels of a lang and those above it, without the root
  SELECT low.lang, low.level, nodes, 0 AS shift FROM low JOIN sub ON low.lang IS NOT DISTINCT FROM sub.lang WHERE low.level < depth
  UNION ALL SELECT sub.lang, depth + top.level, nodes, 1 FROM sub, top WHERE len(nodes) > 1),
walk AS (
  SELECT doc_id, leaf, changed AS node, pos, p.lang, 0 AS level, '' AS beside FROM p
  UNION ALL
  SELECT doc_id, leaf, sha256(array_to_string(nodes[spot - spot % 8 + 1 : spot], '') || node || array_to_string(nodes[spot + 2 : spot - spot % 8 + 8], '')), spot // 8, lang, level + 1,
    beside || array_to_string(nodes[spot - spot % 8 + 1 : spot], '') || array_to_string(nodes[spot + 2 : spot - spot % 8 + 8], '')
  FROM (SELECT w.*, e.nodes, CASE WHEN e.shift = 1 AND w.level = s.depth THEN s.place ELSE w.pos END AS spot
    FROM walk w JOIN every e ON w.lang IS NOT DISTINCT FROM e.lang AND w.level = e.level JOIN sub s ON w.lang IS NOT DISTINCT FROM s.lang)),
ends AS (SELECT lang, max(level) + 1 AS height FROM every GROUP BY lang)
SELECT doc_id, leaf, subroot, root, sha256(beside) AS proof_sha256, node AS folded_root, node = root AS verified
FROM walk JOIN sub ON walk.lang IS NOT DISTINCT FROM sub.lang LEFT JOIN ends ON walk.lang IS NOT DISTINCT FROM ends.lang,
  (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1)
WHERE level = coalesce(height, 0)
"""
