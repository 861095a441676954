"""Near-duplicate documents by HyperMinHash signatures, confirmed on the full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .common import by_bytes, id_and_text, long_list, mixed, odd_numbers, shingle_hashes
from .graph import components

MANTISSA = 10  # bits kept after the leading one


@dataclass(frozen=True)
class NearDup:
    """Settings of the operator.

    width     words in a shingle
    percent   link when 100 * intersection >= percent * union
    rows      registers in a band
    miss      largest chance that a pair right at the threshold shares no band
    slack     standard errors below the threshold at which an estimate still goes to verification
    """

    width: int = 5
    percent: int = 80
    rows: int = 7
    miss: float = 1e-6
    slack: float = 5.0
    block_docs: int = 256
    block_shingles: int = 500_000

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log1p(-((self.percent / 100) ** self.rows)))

    @property
    def registers(self) -> int:
        return self.rows * self.bands


def registers_of(shingles: np.ndarray, count: int) -> np.ndarray:
    """One 16-bit register per bucket: the leading zeros of the bucket's smallest 32-bit hash
    and the ``MANTISSA`` bits that follow the leading one.

    Every bucket has a permutation of its own, so that short texts fill all of them too.
    """
    if not len(shingles):
        return np.zeros(count, np.uint16)
    x = (shingles >> np.uint64(32)).astype(np.uint32)  # shingle hashes are random bits already
    factor = odd_numbers(count, 101, np.uint32)
    least = np.full(count, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 32_768):
            part = x[at : at + 32_768]
            step = max(1, 32_768 // len(part))
            for k in range(0, count, step):
                h = np.multiply(factor[k : k + step, None], part)
                np.minimum(least[k : k + step], h.min(axis=1), out=least[k : k + step])
    value = least.astype(np.float64)
    top = np.where(least > 0, np.frexp(value)[1], 0)  # bits in use: 32 less the leading zeros
    rest = np.where(top > MANTISSA, least >> np.maximum(top - 1 - MANTISSA, 0).astype(np.uint32), least << np.maximum(MANTISSA + 1 - top, 0).astype(np.uint32))
    return (((32 - top).astype(np.uint32) << MANTISSA) | (rest & ((1 << MANTISSA) - 1))).astype(np.uint16)


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band and document, from a matrix of registers."""
    n, count = registers.shape
    bands = count // rows
    parts = registers.reshape(n, bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        total = (mixed(parts + np.uint64(1)) * odd_numbers(rows, 303)).sum(axis=2, dtype=np.uint64)
        return mixed(total + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def chance_collisions(sizes_a: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """For sets of these sizes with nothing in common: the chance that two registers agree."""
    zeros = np.arange(0, 33)

    def spread(sizes: np.ndarray) -> np.ndarray:
        at_least = 1 - np.power(1 - np.power(0.5, zeros), np.maximum(sizes, 1)[:, None])
        return np.maximum(at_least[:, :-1] - at_least[:, 1:], 0)

    return spread(sizes_a) @ spread(sizes_b).T / (1 << MANTISSA)


def estimated_jaccard(regs_a: np.ndarray, regs_b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """Collision-corrected estimates for every row of a against every row of b."""
    agree = np.empty((len(regs_a), len(regs_b)), np.float64)
    for i, row in enumerate(regs_a):
        agree[i] = (regs_b == row).mean(axis=1)
    by_chance = chance_collisions(sizes_a, sizes_b)
    return np.clip((agree - by_chance) / (1 - by_chance), 0, 1)


def signatures(docs: DataFrame, job: NearDup) -> DataFrame:
    """doc_id, n_shingles, digest of the whole set (null for an empty one) and registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in by_bytes(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sizes, digests, regs = [], [], []
                for t in texts:
                    s = shingle_hashes(t, job.width)
                    sizes.append(len(s))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    regs.append(registers_of(s, job.registers).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())],
                    ["doc_id", "n_shingles", "digest", "regs"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, regs binary")


def _keys(job: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            if raw:
                keys = band_keys(np.frombuffer(b"".join(raw), np.uint16).reshape(len(raw), -1), job.rows).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), long_list(list(keys), pa.int64())], ["node", "keys"])

    return run


def _sets(job: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(2).to_pylist()
            for some, texts in by_bytes(zip(batch.column(0).to_pylist(), cells, strict=True), batch.column(1).to_pylist()):
                nodes, kept, sizes, sets = [], [], [], []
                for (node, cell), t in zip(some, texts, strict=True):
                    s = shingle_hashes(t, job.width)
                    if len(s):
                        nodes.append(node)
                        kept.append(cell)
                        sizes.append(len(s))
                        sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array(kept, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())],
                    ["node", "cell", "n", "members"],
                )

    return run


class _Forest:
    """Union by smallest root, for the rows of one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def links_in(rows: list[tuple[int, np.ndarray]], others: list[tuple[int, np.ndarray]] | None, job: NearDup) -> list[tuple[int, int]]:
    """Confirmed links within ``rows``, or between ``rows`` and ``others``: a spanning forest
    of them, which has the same components.

    Pairs whose estimate lies far below the threshold are left out; the others are
    confirmed on the full sets, likeliest first, until their rows hang together.
    """
    every = rows + (others or [])
    split = len(rows)
    regs = np.stack([registers_of(s, job.registers) for _, s in every])
    sizes = np.array([len(s) for _, s in every])
    t = job.percent / 100
    floor = t - job.slack * math.sqrt(t * (1 - t) / job.registers)
    if others is None:
        guess = np.triu(estimated_jaccard(regs, regs, sizes, sizes), 1)
        a, b = np.nonzero(guess >= floor)
        score = guess[a, b]
    else:
        guess = estimated_jaccard(regs[:split], regs[split:], sizes[:split], sizes[split:])
        a, b = np.nonzero(guess >= floor)
        score = guess[a, b]
        b = b + split
    forest, found = _Forest(len(every)), []
    fits = 100 * np.minimum(sizes[a], sizes[b]) >= job.percent * np.maximum(sizes[a], sizes[b])
    for k in np.argsort(-score, kind="stable"):
        i, j = int(a[k]), int(b[k])
        if not fits[k] or forest.root(i) == forest.root(j):
            continue
        shared = np.intersect1d(every[i][1], every[j][1], assume_unique=True).size
        if 100 * shared >= job.percent * (int(sizes[i]) + int(sizes[j]) - shared):
            forest.join(i, j)
            found.append((every[i][0], every[j][0]))
    return found


def _confirm(job: NearDup):
    def block(nodes: list[int], sets: list[bytes]) -> list[tuple[int, np.ndarray]]:
        return [(n, np.frombuffer(s, np.uint64)) for n, s in zip(nodes, sets, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                found = links_in(block(r["nodes"], r["sets"]), None if r["same"] else block(r["nodes2"], r["sets2"]), job)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return run


def candidate_cells(signed: DataFrame, job: NearDup) -> DataFrame:
    """(node, cell): documents that share a band key, directly or through others.

    ``signed`` has one row per class of equal sets. The smallest row of each band key is its
    hub. A document is linked to the smallest of its hubs alone, and that one to the others:
    the same components, while very many copies that meet under the same keys share the links
    between their hubs.
    """
    keyed = signed.select("node", "regs").mapInArrow(_keys(job), "node long, keys array<long>")
    keyed = keyed.select("node", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last")
    met = keyed.join(hubs.select("key", "hub"), "key").groupBy("node").agg(F.collect_set("hub").alias("hubs"))  # one per band at most
    first = F.array_min("hubs")
    links = F.array_union(F.array(F.struct(F.col("node").alias("a"), first.alias("b"))), F.transform("hubs", lambda h: F.struct(first.alias("a"), h.alias("b"))))
    return components(met.select(F.explode(links).alias("e")).select("e.a", "e.b").where("a <> b").distinct())


def confirmed_links(docs: DataFrame, cells: DataFrame, job: NearDup) -> DataFrame:
    """Links (a, b) on full sets between the documents of a cell, as spanning forests.

    A cell is cut by set size (linked sets differ by less than the threshold, so they lie in
    the same or the next class) and then by hash into blocks of bounded rows and shingles;
    pairs of blocks meet in a task of their own, so no cell is gathered whole.
    """
    sets = materialize(
        docs.join(cells.select(F.col("node").alias("doc_id"), F.col("component").alias("cell")), "doc_id")
        .select("doc_id", "text", "cell").mapInArrow(_sets(job), "node long, cell long, n long, members binary"),
        "sets",
    )
    step = -math.log(job.percent / 100)
    sized = sets.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / step + F.lit(1e-9)).cast("long"))
    counts = materialize(
        sized.groupBy("cell", "class").agg(
            F.greatest(F.ceil(F.count("*") / job.block_docs), F.ceil(F.sum("n") / job.block_shingles)).alias("blocks")
        ),
        "counts",
    )
    named = F.concat_ws("/", "cell", "class", "part")
    blocks = materialize(
        sized.join(counts, ["cell", "class"])
        .select(F.concat_ws("/", "cell", "class", F.pmod(F.xxhash64("node", "n"), F.col("blocks"))).alias("block"), "node", "members")
        .groupBy("block").agg(F.collect_list("node").alias("nodes"), F.collect_list("members").alias("sets")),
        "blocks",
    )
    own = counts.select("cell", "class", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part"))
    within = own.select(named.alias("one"), "cell", "class", F.explode(F.sequence("part", F.col("blocks") - 1)).alias("other"))
    within = within.select("one", F.concat_ws("/", "cell", "class", "other").alias("two"))
    after = counts.select("cell", (F.col("class") - 1).alias("class"), F.col("blocks").alias("further"))
    across = own.join(after, ["cell", "class"]).select(
        named.alias("one"),
        F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("further") - 1), lambda p: F.concat_ws("/", "cell", F.col("class") + 1, p))).alias("two"),
    )
    second = blocks.select(F.col("block").alias("two"), F.col("nodes").alias("nodes2"), F.col("sets").alias("sets2"))
    pairs = within.unionByName(across)
    met = pairs.join(blocks, pairs.one == blocks.block).drop("block").join(second, "two").withColumn("same", F.col("one") == F.col("two"))
    return met.select("same", "nodes", "sets", "nodes2", "sets2").mapInArrow(_confirm(job), "a long, b long")


def near_duplicates(docs: DataFrame, job: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id), one row per row of ``docs``.

    Linked are documents whose full shingle sets have 100 * intersection >= percent * union;
    a component takes its smallest doc_id. Equal sets are one class before anything else, so
    copies cost one row each.

    A null or empty text, or one without words, has an empty set and is linked with nothing.
    Rows with the same doc_id count as one document (their links are joined). A null doc_id
    takes no part: component_id is null and it is kept. Ties cannot occur, ids decide. No
    rows give no rows; other columns are not read.
    """
    source = id_and_text(docs, id_col, text_col)
    signed = materialize(signatures(source, job), "signatures")
    classes = materialize(
        signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(
            F.min("doc_id").alias("node"), F.first("regs").alias("regs")
        ),
        "classes",
    )
    cells = candidate_cells(classes, job)
    links = confirmed_links(source, cells, job)
    own = signed.where("digest is not null and doc_id is not null").join(classes.select("digest", "node"), "digest").select(
        F.col("doc_id").alias("a"), F.col("node").alias("b")
    ).where("a <> b")
    whole = components(links.unionByName(own))
    return (
        signed.select("doc_id", "n_shingles").join(whole.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select(
            "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
            F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
    )


def drop_near_duplicates(docs: DataFrame, job: NearDup = NearDup()) -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id; columns as they are.

    Of rows that repeat the kept doc_id all stay, as they are the same document.
    """
    gone = near_duplicates(docs, job).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
