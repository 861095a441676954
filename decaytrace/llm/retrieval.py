"""Packing by lexical retrieval: a window is filled with the BM25 neighbours of its seed document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.ranks import ranked
from ..session import materialize
from .common import id_and_text, mixed
from .packing import Packing, _tokenizer


@dataclass(frozen=True)
class Retrieval:
    """Settings of the operator.

    ids             the tokenizer's files, as the other packing operator takes them
    capacity        tokens in a sequence, a power of two
    end_id          id appended to each document
    shard_items     documents in one inverted index
    k1, b           of BM25
    """

    ids: Packing
    capacity: int = 2048
    end_id: int = 1
    shard_items: int = 512
    k1: float = 1.2
    b: float = 0.75


MADE = "kind int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
FULL, REST, TERM = range(3)  # kinds: a whole sequence, what remains of a document, how many documents have an id


def tokenized(docs: DataFrame, job: Retrieval) -> DataFrame:
    """The ids of each whole text with the end id: full sequences by their checksum, the rest with
    its ids; and per task how many documents hold each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _tokenizer(job.ids), np.array([job.end_id], "<u4").tobytes()
        holding, last = np.zeros(0, np.int64), np.zeros(0, np.int64)
        schema = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), ("ids", pa.binary())])
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode((raw or b"").decode("utf-8", "replace")) + end
                total = len(ids) // 4
                held = np.frombuffer(ids, "<u4")
                if (most := int(held.max())) >= len(holding):
                    holding, last = (np.append(x, np.zeros(most + 1 - len(x), np.int64)) for x in (holding, last))
                last[held] = np.arange(total)  # the last place of each id stands for it
                holding[held[last[held] == np.arange(total)]] += 1
                for at in range(0, total, job.capacity):
                    piece = ids[4 * at : 4 * (at + job.capacity)]
                    full = len(piece) == 4 * job.capacity
                    rows.append((FULL if full else REST, doc_id, at, len(piece) // 4, zlib.crc32(piece), total, None if full else piece))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)
        found = np.flatnonzero(holding)
        nothing = pa.nulls(len(found), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(found), TERM, np.int32)), pa.array(found, pa.int64()), nothing, pa.array(holding[found]), nothing, nothing, pa.nulls(len(found), pa.binary())], schema=schema
        )

    return docs.mapInArrow(run, MADE)


@dataclass(frozen=True)
class Statistics:
    """What a shard must know of the whole corpus."""

    idf: np.ndarray  # by id; 0 for an id that half of all documents hold
    mean_length: float


def statistics(made: DataFrame) -> Statistics:
    """Counts over all documents. The driver holds one number per id of the vocabulary."""
    rest = made.where(F.col("kind") == REST).agg(F.avg("length").alias("mean")).first()["mean"] or 1.0
    n = made.where((F.col("kind") < TERM) & (F.col("start") == 0)).count()
    table = made.where(F.col("kind") == TERM).groupBy("doc_id").agg(F.sum("length").alias("n")).toArrow()
    terms, holding = table["doc_id"].to_numpy(), table["n"].to_numpy()
    idf = np.zeros(int(terms.max(initial=-1)) + 1)
    idf[terms] = np.maximum(0, np.log((n - holding + 0.5) / (holding + 0.5)))
    return Statistics(idf, float(rest))


def lexical_keys(rest: DataFrame, corpus: Statistics) -> DataFrame:
    """(row, k1, k2): two ids that stand for a text, each drawn from its ids in proportion to their
    weight, and the same for texts that share much of it."""
    with np.errstate(divide="ignore"):
        draws = [-np.log((mixed(np.arange(len(corpus.idf), dtype=np.uint64) + np.uint64(seed)) >> np.uint64(11)).astype(float) / 2**53 + 2.0**-54) / corpus.idf for seed in (1 << 40, 1 << 41)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[list[int]] = [[], []]
            for ids in map(lambda x: np.frombuffer(x, "<u4"), batch.column(1).to_pylist()):
                for draw, out in zip(draws, keys, strict=True):
                    drawn = draw[ids]
                    k = int(drawn.argmin())
                    out.append(int(ids[k]) if np.isfinite(drawn[k]) else -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(k, pa.int32()) for k in keys)], ["row", "k1", "k2"])

    return rest.select("row", "ids").mapInArrow(run, "row long, k1 int, k2 int")


class Index:
    """Inverted BM25 index of the items of one shard."""

    def __init__(self, items: list[np.ndarray], corpus: Statistics, job: Retrieval):
        counted = [np.unique(x, return_counts=True) for x in items]
        sizes = [len(t) for t, _ in counted]
        term, tf = (np.concatenate(x) for x in zip(*counted, strict=True))
        item = np.repeat(np.arange(len(items)), sizes)
        idf = corpus.idf[term]
        useful = idf > 0
        term, tf, item, idf = term[useful], tf[useful], item[useful], idf[useful]
        long = np.array([len(x) for x in items])[item] / corpus.mean_length
        weight = idf * tf * (job.k1 + 1) / (tf + job.k1 * (1 - job.b + job.b * long))
        local = np.unique(term, return_inverse=True)[1]
        order = np.argsort(local, kind="stable")
        self.n = len(items)
        borders = np.searchsorted(local[order], np.arange(1, local.max(initial=0) + 1))
        self.postings, self.weights = np.split(item[order], borders), np.split(weight[order], borders)
        self.terms = np.split(local, np.searchsorted(item, np.arange(1, len(items))))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every item for the distinct terms of one of them."""
        terms = self.terms[seed].tolist()
        if not terms:
            return np.zeros(self.n)
        lists = (np.concatenate(list(map(x.__getitem__, terms))) for x in (self.postings, self.weights))
        return np.bincount(*lists, self.n)

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused items that share a term with the seed, best first, ties in order of the shard."""
        scores = np.where(unused, self.scores(seed), 0)
        found = np.flatnonzero(scores > 0)
        return found[np.argsort(-scores[found], kind="stable")]


Part = tuple[int | None, int, int, int]  # doc_id, start, tokens of the document, length


def fill_windows(items: list[np.ndarray], corpus: Statistics, job: Retrieval) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, from, to); all are full but the last.

    A window's seed is what was cut off the item before, else the first unused item; its unused
    neighbours follow, best first, as they fit. When none fits the best one fills the window up
    and its rest is the next seed. A seed whose neighbours are used up hands over to the next
    unused item.
    """
    if not items:
        return []
    index, unused = Index(items, corpus, job), np.ones(len(items), bool)
    windows: list[list[tuple[int, int, int]]] = [[]]
    sizes = np.array([len(x) for x in items])
    room, first, cut = job.capacity, 0, None

    def put(item: int, at: int) -> None:
        nonlocal room, cut
        end = min(len(items[item]), at + room)
        windows[-1].append((item, at, end))
        unused[item] = False
        room -= end - at
        cut = (item, end) if end < len(items[item]) else None
        if not room:
            windows.append([])
            room = job.capacity

    while True:
        if cut is None:
            while first < len(items) and not unused[first]:
                first += 1
            if first == len(items):
                break
            seed, at = first, 0
        else:
            seed, at = cut
        window = len(windows)
        put(seed, at)
        if len(windows) > window:
            continue
        near = index.neighbours(seed, unused)
        long, at = sizes[near], 0
        while len(windows) == window and len(fits := np.flatnonzero(long[at:] <= room)):
            at += int(fits[0])
            put(int(near[at]), 0)
            at += 1
        if len(windows) == window and len(larger := near[unused[near]]):
            put(int(larger[0]), 0)
    if not windows[-1]:
        windows.pop()
    return windows


PARTS = "array<struct<doc_id: long, start: long, tokens: long, length: long>>"
PLACED = f"block long, window long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, offset long, parts {PARTS}, ids binary"


def _fill(corpus: Statistics, job: Retrieval, last: bool):
    """Full windows of one shard as rows of their pieces; what is left over as one further item,
    or, in the last shard, as sequences of powers of two."""
    kinds = pa.schema([
        *((c, pa.int64()) for c in ("block", "window", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset")),
        ("parts", pa.list_(pa.struct([(c, pa.int64()) for c in ("doc_id", "start", "tokens", "length")]))), ("ids", pa.binary()),
    ])

    def pieces(item: list[dict], at: int, end: int) -> Iterator[dict]:
        """The parts of an item between two of its ids, and where in the item they begin."""
        begin = 0
        for p in item:
            a, b = max(at, begin), min(end, begin + p["length"])
            if a < b:
                yield {"doc_id": p["doc_id"], "start": p["start"] + a - begin, "tokens": p["tokens"], "length": b - a, "at": a}
            begin += p["length"]

    def run(key: tuple[pa.Scalar, ...], shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("pos")
        parts = shard["parts"].to_pylist()
        items = [np.frombuffer(x, "<u4") for x in shard["ids"].to_pylist()]
        windows = fill_windows(items, corpus, job)
        left = windows.pop() if windows and sum(b - a for _, a, b in windows[-1]) < job.capacity else []
        if last and left:  # its length in binary: nothing is padded
            room = 0
            todo = sum(b - a for _, a, b in left)
            for item, at, end in left:
                while at < end:
                    if not room:
                        room = 1 << (todo.bit_length() - 1)
                        windows.append([])
                    n = min(room, end - at)
                    windows[-1].append((item, at, at + n))
                    at, room, todo = at + n, room - n, todo - n
            left = []
        rows: list[tuple] = []
        block = key[0].as_py()
        for k, window in enumerate(windows):
            offset = 0
            for item, at, end in window:
                for p in pieces(parts[item], at, end):
                    crc = zlib.crc32(items[item][p["at"] : p["at"] + p["length"]].tobytes())
                    rows.append((block, k, p["doc_id"], p["start"], p["length"], crc, p["tokens"], offset, None, None))
                    offset += p["length"]
        if left:
            held = [{c: p[c] for c in ("doc_id", "start", "tokens", "length")} for item, at, end in left for p in pieces(parts[item], at, end)]
            ids = b"".join(items[item][at:end].tobytes() for item, at, end in left)
            rows.append((block, None, None, None, None, None, None, None, held, ids))
        columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return run


def pack(docs: DataFrame, job: Retrieval) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    Full sequences are cut off each document; the rests go, in an order that keeps texts with
    the same heavy words together, to shards of bounded size. Each shard is indexed and its
    windows are filled with neighbours of their seeds; rests may be cut. The tokens that fill
    no window there become one item of the next round, up to one shard, whose last tokens make
    sequences of powers of two: no sequence is padded.

    A null or empty text is the end id alone. Repeated rows and null ids are packed like any
    other row. No rows give no rows. Further columns are not read.
    """
    made = tokenized(id_and_text(docs), job).select(F.monotonically_increasing_id().alias("row"), "*")
    made = materialize(made, "tokens")
    corpus = statistics(made)
    full = made.where(F.col("kind") == FULL).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = made.where(F.col("kind") == REST)
    keys = materialize(lexical_keys(rest, corpus), "keys").join(rest.select("row", "doc_id", "ids_crc32"), "row")
    order = [F.col(c).asc_nulls_first() for c in ("k1", "k2", "doc_id", "ids_crc32", "row")]
    places = materialize(ranked(keys, order, column="pos").select(F.col("row").alias("_row"), "pos"), "places")
    items = rest.join(places, F.col("row") == F.col("_row")).select(
        "pos", F.array(F.struct("doc_id", "start", F.col("doc_tokens").alias("tokens"), "length")).alias("parts"), "ids"
    )
    blocks, level, done = places.count(), 0, [full]
    while blocks:
        blocks = -(-blocks // job.shard_items)
        sharded = items.withColumn("block", F.floor(F.col("pos") / job.shard_items)).groupBy("block")
        placed = materialize(sharded.applyInArrow(_fill(corpus, job, blocks == 1), PLACED), "windows")
        number = ((F.lit(level).cast("long") * (1 << 40) + F.col("block")) * (1 << 14) + F.col("window")) * 2
        done.append(placed.where("window is not null").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", number.alias("sequence_id"), "offset"))
        if blocks == 1:
            break
        items, level = placed.where("window is null").select(F.col("block").alias("pos"), "parts", "ids"), level + 1
    return reduce(DataFrame.unionByName, done)
