"""Packing of tokenized documents into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import base64
import random
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import id_and_text


@dataclass(frozen=True)
class Packing:
    """Settings of the operator.

    capacity, end_id    tokens in a sequence, id appended to each document
    tokenizer, ranks    a byte-level BPE file for ``tokenizers`` and the same vocabulary as ranks
    block_items         pieces that one genetic search packs
    islands, epochs     populations per block; each epoch ends with the migration of elites
    generations         crossovers per member of the population and epoch
    """

    tokenizer: str
    ranks: str
    pattern: str
    capacity: int = 2048
    end_id: int = 0
    block_items: int = 8_192
    islands: int = 2
    epochs: int = 2
    generations: int = 6
    population: int = 4
    seed: int = 17


# ---- token ids -------------------------------------------------------------------------


class TokenIds:
    """The ids of whole texts as little-endian unsigned 32-bit numbers, without the end id.

    Texts of ASCII and Latin letters are encoded by the vocabulary's rank table, which gives
    the tokenizer's ids at several times its speed; a text with other letters, on whose
    classes two libraries may differ, or with a special token goes through the tokenizer.
    """

    other = re.compile("[^\x00-\u024f]|<\\|")

    def __init__(self, job: Packing):
        import tiktoken
        from tokenizers import Tokenizer

        with open(job.ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("ranks", pat_str=job.pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(job.tokenizer)

    def __call__(self, text: str) -> bytes:
        plain = "<|" not in text if text.isascii() else not self.other.search(text)
        ids = self.plain.encode_ordinary(text) if plain else self.whole.encode(text, add_special_tokens=False).ids
        return np.frombuffer(array("I", ids), np.uintc).astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=1)
def _tokenizer(job: Packing) -> TokenIds:
    return TokenIds(job)


def pieces(docs: DataFrame, job: Packing) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32): each document's ids with the end id,
    cut into full sequences; a shorter piece comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _tokenizer(job), np.array([job.end_id], "<u4").tobytes()
        for batch in batches:
            cols: list[list[int]] = [[], [], [], [], []]
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode((raw or b"").decode("utf-8", "replace")) + end
                total = len(ids) // 4
                at, size = 0, total % job.capacity or min(total, job.capacity)
                for k in range(-(-total // job.capacity)):
                    for col, v in zip(cols, (doc_id, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])), strict=True):
                        col.append(v)
                    at, size = at + size, job.capacity
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    made = docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return made.select(F.monotonically_increasing_id().alias("row"), "*")


# ---- the genetic search over one block ---------------------------------------------------

Bins = list[list[int]]  # item numbers by bin


class Search:
    """Grouping genetic algorithm over the items of one block."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int):
        self.size = lengths.tolist()
        self.capacity = capacity
        self.least = -(-int(lengths.sum()) // capacity)
        self.random = random.Random(seed)
        self.order = np.argsort(-lengths, kind="stable").tolist()

    def fill(self, b: list[int]) -> int:
        return sum(map(self.size.__getitem__, b))

    def best_fit(self, bins: Bins, items: list[int]) -> Bins:
        """Put each item into the fullest bin that has room; ``bins`` is changed."""
        room_of = [self.capacity - self.fill(b) for b in bins]
        by_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        mask = 0  # bit r: some bin has room for exactly r
        for k, r in enumerate(room_of):
            by_room[r].append(k)
            mask |= 1 << r
        for i in items:
            s = self.size[i]
            m = mask >> s
            if m:
                r = s + (m & -m).bit_length() - 1
                k = by_room[r].pop()
                if not by_room[r]:
                    mask ^= 1 << r
                bins[k].append(i)
                r -= s
            else:
                k, r = len(bins), self.capacity - s
                bins.append([i])
            by_room[r].append(k)
            mask |= 1 << r
        return bins

    def value(self, bins: Bins) -> tuple[int, float]:
        """Fewer bins first, then the mean square of how full they are. Larger is better."""
        fills = [self.fill(b) / self.capacity for b in bins]
        return -len(bins), sum(f * f for f in fills) / max(1, len(fills))

    def member(self, first: bool) -> Bins:
        """Best fit in falling order of size; further members see the order disturbed."""
        order = self.order
        if not first:
            order = sorted(order, key=lambda i: -self.size[i] * (1 + 0.3 * self.random.random()))
        return self.best_fit([], order)

    def crossover(self, one: Bins, two: Bins) -> Bins:
        """Well-filled bins of ``two`` go whole into ``one``; its bins that held the same items
        go, and what they displaced is put back by best fit."""
        by_fill = sorted(two, key=self.fill, reverse=True)
        good = by_fill[: max(1, len(by_fill) // 2)]
        injected = self.random.sample(good, max(1, len(good) // 2))
        taken = {i for b in injected for i in b}
        kept, displaced = [], []
        for b in one:
            if taken.isdisjoint(b):
                kept.append(list(b))
            else:
                displaced += [i for i in b if i not in taken]
        return self.mutated(kept + [list(b) for b in injected], displaced)

    def mutated(self, bins: Bins, displaced: list[int]) -> Bins:
        """Also dissolve the emptiest bins before the displaced items are put back."""
        bins.sort(key=self.fill)
        for _ in range(min(len(bins), self.random.randint(1, 4))):
            displaced += bins.pop(0)
        displaced.sort(key=self.size.__getitem__, reverse=True)
        return self.best_fit(bins, displaced)

    def evolve(self, population: list[Bins], members: int, generations: int) -> list[Bins]:
        """The next population, best member first; stops at the bound that nothing can beat."""
        while len(population) < members and not (population and len(population[0]) == self.least):
            population.append(self.member(not population))
        population.sort(key=self.value, reverse=True)
        for _ in range(generations * members):
            if len(population[0]) == self.least:
                break
            one, two = self.random.sample(population, 2) if len(population) > 1 else population * 2
            population[-1:] = [population[-1], self.crossover(one, two)]
            population.sort(key=self.value, reverse=True)
            population = population[:members]
        return population


def encoded(bins: Bins, n: int) -> bytes:
    """A member as the bin number of every item."""
    of = np.empty(n, np.int32)
    for k, b in enumerate(bins):
        of[b] = k
    return of.tobytes()


def decoded(raw: bytes) -> Bins:
    of = np.frombuffer(raw, np.int32)
    order = np.argsort(of, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1)]


STATE = "block long, island int, rows binary, lengths binary, members array<binary>, bins int, least int, value double"


def _start(job: Packing):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "deal", "row"])
        rows, lengths = pdf["row"].to_numpy(np.int64).tobytes(), pdf["length"].to_numpy(np.int64)
        n = job.islands
        return pd.DataFrame({
            "block": [pdf["block"].iloc[0]] * n, "island": range(n), "rows": [rows] * n, "lengths": [lengths.tobytes()] * n,
            "members": [[]] * n, "bins": [0] * n, "least": [0] * n, "value": [0.0] * n,
        })

    return run


def _evolve(job: Packing, epoch: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                lengths = np.frombuffer(r.lengths, np.int64)
                search = Search(lengths, job.capacity, hash((job.seed, r.block, r.island, epoch)))
                population = search.evolve([decoded(m) for m in r.members], job.population, job.generations)
                bins, value = search.value(population[0])
                yield pd.DataFrame({
                    "block": [r.block], "island": [r.island], "rows": [r.rows], "lengths": [r.lengths],
                    "members": [[encoded(m, len(lengths)) for m in population]], "bins": [-bins], "least": [search.least], "value": [value],
                })

    return run


def _placed(job: Packing):
    """The rows of a block's best member: row, bin, offset there and how full the bin is."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                of, lengths = np.frombuffer(r.member, np.int32), np.frombuffer(r.lengths, np.int64)
                order = np.lexsort((np.arange(len(of)), of))
                ends = np.cumsum(lengths[order])
                fills = np.bincount(of, weights=lengths).astype(np.int64)
                before = np.concatenate([[0], np.cumsum(fills)[:-1]])
                yield pd.DataFrame({
                    "row": np.frombuffer(r.rows, np.int64)[order], "length": lengths[order], "block": np.full(len(of), r.block, np.int64),
                    "bin": of[order].astype(np.int64), "offset": ends - lengths[order] - before[of[order]], "filled": fills[of[order]],
                })

    return run


def pack_blocks(items: DataFrame, blocks: int, job: Packing) -> DataFrame:
    """Pack (row, deal, length) in ``blocks`` blocks, each on islands of its own. ``deal`` is a
    hash of what the piece is, so the blocks do not depend on how the rows are partitioned."""
    dealt = items.withColumn("block", F.pmod("deal", F.lit(blocks)))
    state = dealt.groupBy("block").applyInPandas(_start(job), STATE)
    for epoch in range(job.epochs):
        if epoch:
            elites = state.where("bins > least").select(  # at the bound there is nothing left to improve
                "block", F.pmod(F.col("island") + 1, F.lit(job.islands)).cast("int").alias("island"), F.col("members")[0].alias("elite")
            )
            state = state.join(elites, ["block", "island"], "left").select(
                "block", "island", "rows", "lengths",
                F.when(F.col("elite").isNull(), F.col("members")).otherwise(F.concat("members", F.array("elite"))).alias("members"),
                "bins", "least", "value",
            )
        state = materialize(state.repartition(min(1_000, blocks * job.islands), "block", "island").mapInPandas(_evolve(job, epoch), STATE), "islands")
    best = state.groupBy("block").agg(F.max(F.struct(-F.col("bins"), "value", F.col("members")[0].alias("member"), "rows", "lengths")).alias("b"))
    return best.select("block", "b.*").mapInPandas(_placed(job), "row long, length long, block long, bin long, offset long, filled long")


def sequence_number(block: Column, bin_: Column, level: int) -> Column:
    """An even number for each (level, block, bin): 10 bits of level above 31 of block and 20 of bin."""
    if not 0 <= level < 1 << 10:
        raise ValueError(f"level {level} has no number")
    return ((F.lit(level).cast("long") * (1 << 31) + block.cast("long")) * (1 << 20) + bin_.cast("long")) * 2


def pack(docs: DataFrame, job: Packing) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    A null or empty text is one piece of the end id alone. A document longer than a sequence
    is cut into full pieces after a shorter first one; full pieces are sequences as they are.
    All others go to blocks of bounded size by a hash, and every block is packed by a
    grouping genetic algorithm on islands that exchange their best members. Bins that a block
    could not fill are dissolved, dealt anew and packed again with those of the other blocks,
    until one block holds them or a round neither fills nor saves a bin. What counts as filled
    is a 256th short of full at first and a quarter more of that by round, so there are some 25
    rounds at most. Repeated rows and null ids are packed like any other row. No rows give no
    rows.
    """
    made = materialize(pieces(id_and_text(docs), job), "pieces")
    full = made.where(F.col("length") == job.capacity).select("row", (F.col("row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = made.where(F.col("length") < job.capacity).select("row", "doc_id", "piece", "ids_crc32", "length")
    count, level, done = rest.count(), 0, [full]
    before = None  # bins of the last round, if it left the same items
    items = rest
    while count:
        blocks = -(-count // job.block_items)
        dealt = items.withColumn("deal", F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(level)))
        placed = materialize(pack_blocks(dealt.select("row", "deal", "length"), blocks, job), "placed")
        short = min(job.capacity, int(job.capacity / 256 * 1.25**level))
        loose = F.col("filled") < job.capacity - short
        bins, left = placed.agg(F.count_if(F.col("offset") == 0), F.count_if(loose)).first() if blocks > 1 else (0, 0)
        if left == count and before is not None and bins >= before:
            left = 0
        before = bins if left == count else None
        done.append((placed.where(~loose) if left else placed).select("row", sequence_number(F.col("block"), F.col("bin"), level).alias("sequence_id"), "offset"))
        if left:
            items = materialize(rest.join(placed.where(loose).select("row"), "row", "left_semi"), "loose")
        count, level = left, level + 1
    places = done[0]
    for d in done[1:]:
        places = places.unionByName(d)
    return made.join(places, "row").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
