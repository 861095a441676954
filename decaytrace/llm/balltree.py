"""Exact top-k inner products: ball trees per shard, searched by branch and bound."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize


@dataclass(frozen=True)
class TopK:
    """Settings of the search.

    scale         components become floor(scale * x)
    shard_rows    vectors in a shard, and so in one tree
    leaf_rows     vectors in a leaf
    query_rows    queries in a block
    tile_bytes    components of the shards, and of the blocks, that meet in one task, at 8 bytes each
    tiles         tasks that are made, shards permitting, before a task gets several shards
    """

    k: int = 5
    scale: int = 256
    shard_rows: int = 4_096
    leaf_rows: int = 256
    query_rows: int = 512
    tile_bytes: int = 64 << 20
    tiles: int = 64


EXACT_32 = 2.0**24  # sums of integers that stay below this are exact in 32-bit floats
CHUNK = 4_096  # queries that search a tree together
SAFE = 2.0**26  # below this, 64-bit sums of products are exact and far from overflow for any usual width


class BallTree:
    """A binary tree over the rows of a matrix; node i has the children 2i + 1 and 2i + 2.

    Every node covers a run of ``order`` and has a centre and a radius. A query's inner product
    with any row of a node is at most q.c + |q| r.
    """

    def __init__(self, points: np.ndarray, leaf_rows: int):
        n = len(points)
        self.depth = max(0, int(np.ceil(np.log2(max(1, n / leaf_rows)))))
        nodes = 2 ** (self.depth + 1) - 1
        self.order = np.arange(n)
        self.begin, self.end = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        self.centre, self.radius = np.zeros((nodes, points.shape[1])), np.zeros(nodes)
        self.end[0] = n
        for i in range(nodes):
            b, e = self.begin[i], self.end[i]
            rows = points[self.order[b:e]]
            if len(rows):
                self.centre[i] = rows.mean(axis=0)
                self.radius[i] = np.sqrt(((rows - self.centre[i]) ** 2).sum(axis=1).max())
            if 2 * i + 2 < nodes:
                half = (b + e) // 2
                if e - b > 1:
                    far = rows[((rows - self.centre[i]) ** 2).sum(axis=1).argmax()]
                    other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
                    side = np.argsort(rows @ (other - far), kind="stable")
                    self.order[b:e] = self.order[b:e][side]
                self.begin[2 * i + 1], self.end[2 * i + 1] = b, half
                self.begin[2 * i + 2], self.end[2 * i + 2] = half, e
        self.points, self.longest = points[self.order], np.sqrt((points**2).sum(axis=1).max(initial=0))

    def bounds(self, queries: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What no row of a leaf exceeds: the least bound of the leaf and the nodes above it, a column per leaf."""
        value = queries @ self.centre.T + length[:, None] * self.radius
        value += 1e-9 * (np.abs(value) + length[:, None] * (np.abs(self.centre).max(axis=1, initial=0) + self.radius) + 1)
        for i in range(1, value.shape[1]):
            np.minimum(value[:, i], value[:, (i - 1) // 2], out=value[:, i])
        return value[:, 2**self.depth - 1 :]

    def leaf(self, i: int) -> slice:
        at = 2**self.depth - 1 + i
        return slice(self.begin[at], self.end[at])


def exact_scores(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Integer inner products; products beyond 64 bits are worked out exactly and clipped."""
    most = max(np.abs(queries).max(initial=0), np.abs(points).max(initial=0))
    if most < SAFE:
        return (queries.astype(np.int64)[:, None, :] * points.astype(np.int64)[None, :, :]).sum(axis=2) if most * most * queries.shape[1] >= 2**52 else np.rint(queries @ points.T).astype(np.int64)
    big = np.array([[int(v) for v in row] for row in queries], object) @ np.array([[int(v) for v in row] for row in points], object).T
    return np.clip(big, -(2**63), 2**63 - 1).astype(np.int64)


class Best:
    """The k best (score, smaller id first) of every query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), np.iinfo(np.int64).min)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)
        self.valid = np.zeros((queries, k), bool)

    def floor(self) -> np.ndarray:
        """The kth score, minus infinity while there are fewer."""
        return np.where(self.valid[:, -1], self.score[:, -1].astype(np.float64), -np.inf)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates of queries (``rows``), any number of each."""
        touched, at = np.unique(rows, return_inverse=True)
        r = np.concatenate([np.repeat(np.arange(len(touched)), self.k), at])
        s = np.concatenate([self.score[touched].ravel(), score])
        i = np.concatenate([self.ids[touched].ravel(), ids])
        v = np.concatenate([self.valid[touched].ravel(), np.ones(len(rows), bool)])
        order = np.lexsort((i, ~s, ~v, r))  # ~s falls as s rises, also where -s would overflow
        order = order[np.searchsorted(r[order], np.arange(len(touched)))[:, None] + np.arange(self.k)]
        self.score[touched], self.ids[touched], self.valid[touched] = s[order], i[order], v[order]


def search(tree: BallTree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, best: Best) -> None:
    """Branch and bound for queries that know their best so far, which it improves.

    Each query takes its most promising leaf first, and then, leaf by leaf, those whose bound does
    not lie below its kth score, which goes on rising meanwhile.
    """
    length = np.sqrt((queries**2).sum(axis=1))
    bound, ids = tree.bounds(queries, length), ids[tree.order]
    short = tree.longest * length.max(initial=0) < EXACT_32
    asked, points = (queries.astype(np.float32), tree.points.astype(np.float32)) if short else (queries, tree.points)

    def take(who: np.ndarray, rows: slice, floor: np.ndarray) -> None:
        score = asked[who] @ points[rows].T if short else exact_scores(asked[who], points[rows])
        hit = (score.max(axis=1, initial=-(2**63)) >= floor[who]).nonzero()[0]
        if len(hit):
            who, score = who[hit], score[hit]
            ok = ids[rows][None, :] != query_ids[who][:, None]
            if score.shape[1] > best.k:
                least = -np.inf if short else np.iinfo(np.int64).min
                ok &= score >= np.partition(np.where(ok, score, least), -best.k, axis=1)[:, [-best.k]]
            ok &= score >= floor[who][:, None]
            i, c = ok.nonzero()
            best.add(who[i], score[i, c].astype(np.int64), ids[rows][c])

    home = bound.argmax(axis=1)
    for first in (True, False):
        for leaf in range(bound.shape[1]):
            floor = best.floor()
            who = (((home == leaf) == first) & (bound[:, leaf] >= floor)).nonzero()[0]
            if len(who):
                take(who, tree.leaf(leaf), floor)


def usable(vec: Column) -> Column:
    """Whether a vector takes part: it is there, not empty, and all its components are finite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & ~bad


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of a shard or block as one, components in the shortest type that holds all of them."""
    points = np.stack(pdf["x"].to_numpy()).astype(np.float64)
    most = np.abs(points).max(initial=0)
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    return pd.DataFrame({
        "width": [pdf["width"].iloc[0]], "place": [pdf["place"].iloc[0]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()],
        "kind": [kind], "points": [points.astype(kind).tobytes()],
    })


def _unpacked(row) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row.ids, np.int64), np.frombuffer(row.points, row.kind).reshape(-1, row.width).astype(np.float64)


def met(shards: pd.DataFrame, blocks: pd.DataFrame, job: TopK) -> pd.DataFrame:
    """The best of a tile: all its queries over all its shards, one tree built and searched after the other."""
    asked = [_unpacked(b) for b in blocks.itertuples(index=False)] if len(shards) else []
    if not asked:
        return pd.DataFrame({c: np.empty(0, np.int64) for c in ("query_id", "vec_id", "score")})
    query_ids, queries = (np.concatenate(x) for x in zip(*asked, strict=True))
    parts = [slice(b, b + CHUNK) for b in range(0, len(queries), CHUNK)]
    bests = [Best(len(query_ids[p]), job.k) for p in parts]
    for shard in shards.itertuples(index=False):
        ids, points = _unpacked(shard)
        tree = BallTree(points, job.leaf_rows)
        for part, best in zip(parts, bests, strict=True):
            search(tree, ids, queries[part], query_ids[part], best)
    found = [(p.start + q, best.ids[q, c], best.score[q, c]) for p, best in zip(parts, bests, strict=True) for q, c in [best.valid.nonzero()]]
    q, ids, score = (np.concatenate(x) for x in zip(*found, strict=True))
    return pd.DataFrame({"query_id": query_ids[q], "vec_id": ids, "score": score})


def tiled(sizes: DataFrame, job: TopK) -> DataFrame:
    """How many groups the shards and the blocks of a width are dealt into; a group of shards and a
    group of blocks meet in one task. A vector is sent once for every group of the other side."""
    fit = lambda rows: F.greatest(F.lit(1), F.floor(job.tile_bytes / (8 * rows * F.col("width"))))
    block_groups = F.ceil(F.col("blocks") / fit(job.query_rows))
    return sizes.withColumn("block_groups", block_groups).withColumn(
        "shard_groups", F.least("shards", F.greatest(F.ceil(F.col("shards") / fit(job.shard_rows)), F.ceil(job.tiles / F.col("block_groups"))))
    )


def top_k(vectors: DataFrame, is_query: Column, job: TopK = TopK(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products.

    Components are floor(scale * x) with x as a double. A candidate is every usable vector of
    the query's width but the rows with the query's own id; ties go to the smaller id, and a
    query with fewer candidates gets them all. Vectors that are null, empty or hold a null or
    a component that is not finite take no part, nor do null ids. Repeated rows (an id twice)
    are candidates twice and query once. Scores beyond a long are clipped to it. No vectors
    give no rows.

    Vectors go to shards of bounded size by a hash, one ball tree each, and queries to blocks.
    What meets are groups of shards and groups of blocks (``tiled``), in tasks of their own, and
    never a whole side. There queries first search one shard, and the kth scores found so far
    bound their search in the next; a tree is built once in a task.
    """
    scaled = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * job.scale).cast("double"))
    base = vectors.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), scaled.alias("x"), F.size(vec_col).alias("width"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    base = materialize(base, "vectors")
    counted = base.groupBy("width").agg(F.ceil(F.count("*") / job.shard_rows).alias("shards"), F.ceil(F.count_if("asks") / job.query_rows).alias("blocks"))
    sizes = materialize(tiled(counted.where("blocks > 0"), job), "sizes")
    few, tasks = sizes.agg(F.count("*") <= 10_000, F.least(F.lit(10_000), F.sum(F.col("shard_groups") * F.col("block_groups")))).first()
    sized = F.broadcast(sizes) if few else sizes
    dealt = base.join(sized, "width")
    shape = "width int, place long, ids binary, kind string, points binary"

    def packed(rows: DataFrame, place: Column, name: str) -> DataFrame:
        rows = rows.select("width", place.alias("place"), "id", "x")
        return materialize(rows.groupBy("width", "place").applyInPandas(_packed, shape), name).join(sized, "width")

    def sent(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Every row once for each group of the other side, at its tile."""
        groups = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_groups") - 1)).alias(other)
        at = rows.select("width", F.pmod("place", F.col(f"{own}_groups")).alias(own), groups, "ids", "kind", "points")
        return at.repartition(tasks or 1, "width", "shard", "block")

    shards = packed(dealt, F.pmod(F.xxhash64("id", "x"), "shards"), "shards")
    blocks = packed(dealt.where("asks").dropDuplicates(["id", "width"]), F.pmod(F.xxhash64("id"), "blocks"), "blocks")
    tile = ["width", "shard", "block"]
    found = sent(shards, "shard", "block").groupBy(*tile).cogroup(sent(blocks, "block", "shard").groupBy(*tile)).applyInPandas(
        lambda some, asking: met(some, asking, job), "query_id long, vec_id long, score long"
    )
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("low"), "vec_id", "score"))), 1, job.k).alias("top"))
    return best.select("query_id", F.posexplode("top").alias("pos", "t")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score")
    )
