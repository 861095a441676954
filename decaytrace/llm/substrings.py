"""Repeated passages: content-defined chunks from a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .common import by_bytes, fresh, id_and_text, long_list, mixed

WINDOW = 16  # bytes that the rolling hash of 16 bits remembers
STRETCH = 32  # a longer run without blanks is cut into units too


@dataclass(frozen=True)
class Chunking:
    """Settings of the operator.

    reach        a unit is a boundary when its hash is the least of so many to both sides: chunks
                 have more than ``reach`` units, 2 * reach + 1 on average
    least_words  adjoining repeated chunks are cut once they have so many words together
    max_units    longest chunk, for text whose hashes are all equal
    stretch_bits a character in a run without blanks begins a unit when so many top bits are zero
    """

    reach: int = 3
    least_words: int = 20
    max_units: int = 64
    stretch_bits: int = 3


GEAR = (mixed(np.arange(256, dtype=np.uint64) + np.uint64(7_919)) >> np.uint64(48)).astype(np.uint16)
SPACES = bytes(32 if b in b" \t\n\v\f\r" else b for b in range(256))


def gear(text: bytes) -> np.ndarray:
    """h[i] = 2 * h[i - 1] + GEAR[text[i]] modulo 65536 at every byte, by doubling the window."""
    h = GEAR[np.frombuffer(text, np.uint8)]
    width = 1
    while width < WINDOW:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint16(width)
        h, width = longer, 2 * width
    return h


def unit_starts(text: np.ndarray, h: np.ndarray, job: Chunking) -> tuple[np.ndarray, np.ndarray]:
    """Where units start, and the hash before each. A word is a unit; in a run without blanks
    further ones start at characters whose hash meets a mask, ``STRETCH`` bytes in at the
    earliest. All of that depends on a few bytes before the place alone."""
    blank = text == 32
    first = ~blank
    first[1:] &= blank[:-1]
    starts = np.flatnonzero(first)
    hashes = h[starts - 2]  # the end of the word before
    ends = np.append(starts[1:], len(text))
    long = np.flatnonzero(ends - starts > STRETCH)
    if len(long):
        more = []
        for a, b in zip((starts[long] + STRETCH).tolist(), ends[long].tolist(), strict=True):
            inside = text[a:b]
            more.append(a + np.flatnonzero(((inside & 0xC0) != 0x80) & (inside != 32) & (h[a - 1 : b - 1] >> np.uint16(16 - job.stretch_bits) == 0)))
        more = np.concatenate(more)
        starts, hashes = np.concatenate([starts, more]), np.concatenate([hashes, h[more - 1]])
        order = np.argsort(starts, kind="stable")
        starts, hashes = starts[order], hashes[order]
    return starts, hashes


def chunks_of(texts: list[bytes], job: Chunking) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined, with all blanks as spaces, and (text number, start, end) of the chunks
    of each, in order; they cover a text from its first word on.

    A boundary depends on ``reach`` units to both sides, so an insertion moves no boundary
    beyond them. The first unit and the end of a text are boundaries too.
    """
    gap = b" " * (WINDOW + 1)  # nothing of one text reaches the hash of the next
    joined = gap.join([b"", *texts, b""]).translate(SPACES)
    begins = np.cumsum([len(gap), *[len(t) + len(gap) for t in texts]])
    array = np.frombuffer(joined, np.uint8)
    starts, h = unit_starts(array, gear(joined), job)
    owner = np.searchsorted(begins, starts, "right") - 1
    edge = np.ones(len(starts), bool)
    for k in range(1, job.reach + 1):
        apart = owner[k:] != owner[:-k]
        edge[k:] &= apart | (h[k:] < h[:-k])
        edge[:-k] &= apart | (h[:-k] <= h[k:])
    edge[:1] = True
    edge[1:] |= owner[1:] != owner[:-1]
    edges = np.append(np.flatnonzero(edge), len(starts))
    lengths = np.diff(edges)
    if lengths.max(initial=0) > job.max_units:
        edges = np.append(np.concatenate([np.arange(c, c + n, job.max_units) for c, n in zip(edges.tolist(), lengths.tolist(), strict=False)]), len(starts))
    cut = edges[:-1]
    of = owner[cut]
    end = np.minimum(np.append(starts, len(joined))[edges[1:]], begins[of + 1] - len(gap)) if len(cut) else cut
    return joined, of, starts[cut], end


def digest_of(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk.translate(SPACES).rstrip(b" "))


def keys_of(texts: list[bytes], job: Chunking) -> tuple[np.ndarray, ...]:
    """(digest as n x 2 longs, text number, start byte, end byte) of the chunks of some whole texts."""
    joined, of, start, end = chunks_of(texts, job)
    begins = np.cumsum([WINDOW + 1, *[len(t) + WINDOW + 1 for t in texts]])
    digests = b"".join([xxhash.xxh3_128_digest(joined[a:b].rstrip(b" ")) for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(digests, ">i8").astype(np.int64).reshape(-1, 2), of, start - begins[of], end - begins[of]


def chunk_keys(docs: DataFrame, job: Chunking) -> DataFrame:
    """(high, low, doc_id, start, length, again) of every chunk of every whole text.

    ``again`` marks a chunk that the same text had before; the others are one per text and digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in by_bytes(batch.column(0).to_pylist(), batch.column(1).to_pylist(), 256 << 10):
                digests, owner, begin, end = keys_of(texts, job)
                order = np.lexsort((begin, digests[:, 1], digests[:, 0], owner))
                digests, owner, begin, end = digests[order], owner[order], begin[order], end[order]
                again = np.zeros(len(digests), bool)
                again[1:] = (digests[1:] == digests[:-1]).all(1) & (owner[1:] == owner[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.ascontiguousarray(digests[:, 0])), pa.array(np.ascontiguousarray(digests[:, 1])), pa.array(np.array(ids, np.int64)[owner]),
                        pa.array(begin), pa.array((end - begin).astype(np.int32)), pa.array(again),
                    ],
                    ["high", "low", "doc_id", "start", "length", "again"],
                )

    return docs.mapInArrow(run, "high long, low long, doc_id long, start long, length int, again boolean")


def repeated_chunks(docs: DataFrame, job: Chunking = Chunking()) -> DataFrame:
    """(doc_id, high, low, start, end, source_id): the chunks that stand in an earlier place too
    (smaller doc_id, else further up in the same text), by UTF-8 bytes.

    Every such chunk has an earlier copy and the earliest copy is none, so one copy of each
    stays. The smallest doc_id of a digest is a partial minimum, so a passage that very many
    documents share is one row per task. Texts are chunked once; the chunks are a written
    table. Reads ``doc_id`` (long) and ``text`` (binary).
    """
    keys = materialize(chunk_keys(docs.where("doc_id is not null and text is not null"), job), "chunks")
    shared = keys.where("not again").groupBy("high", "low").agg(F.min("doc_id").alias("source_id"), F.max("doc_id").alias("last"))
    shared = shared.where("source_id < last").select(F.col("high").alias("h"), F.col("low").alias("l"), "source_id")
    end = (F.col("start") + F.col("length")).alias("end")
    abroad = keys.where("not again").join(shared, (keys.high == shared.h) & (keys.low == shared.l)).where("doc_id > source_id")
    at_home = keys.where("again").select("doc_id", "high", "low", "start", end, F.col("doc_id").alias("source_id"))
    return abroad.select("doc_id", "high", "low", "start", end, "source_id").unionByName(at_home)


def n_words(chunk: bytes) -> int:
    """Words of a chunk; a run of more than ``STRETCH`` bytes without blanks counts one per six."""
    return sum(1 if len(w) <= STRETCH else len(w) // 6 for w in chunk.split())


def _without(text: str | None, spans: list[dict] | None, job: Chunking) -> tuple[str | None, list[int], list[int], list[int]]:
    """The text less the runs of adjoining repeated chunks that have enough words, those runs and
    where they were before. A chunk counts only where its bytes have its digest: rows may
    share a doc_id and differ in text."""
    raw = text.encode() if text is not None else b""
    runs: list[list] = []  # start, end, words, sources
    for s in sorted(spans or [], key=lambda s: s["start"]):
        chunk = raw[s["start"] : s["end"]]
        if digest_of(chunk) != (s["high"] % (1 << 64)).to_bytes(8, "big") + (s["low"] % (1 << 64)).to_bytes(8, "big"):
            continue
        if runs and s["start"] < runs[-1][1]:
            continue  # the chunks of a repeated row
        if not runs or runs[-1][1] < s["start"]:
            runs.append([s["start"], s["end"], 0, set()])
        runs[-1][1] = s["end"]
        runs[-1][2] += n_words(chunk)
        runs[-1][3].add(s["source_id"])
    runs = [r for r in runs if r[2] >= job.least_words]
    if not runs:
        return text, [], [], []
    kept, at = [], 0
    for start, end, _, _ in runs:
        kept.append(raw[at:start])
        at = end
    kept.append(raw[at:])
    return b"".join(kept).decode(), [r[0] for r in runs], [r[1] for r in runs], sorted(set().union(*(r[3] for r in runs)))


def remove_repeats(docs: DataFrame, job: Chunking = Chunking(), details: bool = False) -> DataFrame:
    """``docs`` with every repeated passage cut out of ``text``, all but its first copy.

    A passage is a run of adjoining chunks, each with an earlier copy, of at least
    ``least_words`` words; runs without blanks (Chinese, addresses, encoded data) count a word
    per six bytes. Columns and rows stay; ``n_chars``, where there is one, follows the new text.
    With ``details`` also removed_starts, removed_ends (byte offsets in the old text) and
    source_ids. A null text stays null, an empty one empty. Rows that repeat a doc_id with
    the same text count as one document and get the same result; where rows share a doc_id and
    differ in text, a chunk is cut only from the texts that have its bytes there. A null doc_id
    takes no part. A document of enough words that is a whole copy of an earlier one ends up
    empty. Clashing names of further columns do no harm. No rows give no rows.
    """
    row, held, starts, ends, sources = (fresh(docs, c) for c in ("spans_of", "spans", "removed_starts", "removed_ends", "source_ids"))
    spans = materialize(repeated_chunks(id_and_text(docs), job), "spans")
    by_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("high", "low", "start", "end", "source_id")).alias(held))
    by_doc = by_doc.withColumnRenamed("doc_id", row)
    joined = docs.join(by_doc, docs["doc_id"].cast("long") == by_doc[row], "left").drop(row)
    empty = F.array().cast("array<long>")
    joined = joined.withColumns({starts: empty, ends: empty, sources: empty})
    names = joined.columns
    t, h, b, e, o = (names.index(c) for c in ("text", held, starts, ends, sources))
    counted = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_without(*x, job) for x in zip(batch.column(t).to_pylist(), batch.column(h).to_pylist(), strict=True)]
            arrays = list(batch.columns)
            arrays[t] = pa.array([x[0] for x in made], pa.string()).cast(arrays[t].type)
            for place, k in ((b, 1), (e, 2), (o, 3)):
                arrays[place] = long_list([np.array(x[k], np.int64) for x in made], pa.int64())
            if counted is not None:
                old = arrays[counted].to_pylist()
                arrays[counted] = pa.array([len(x[0]) if x[1] else n for x, n in zip(made, old, strict=True)], arrays[counted].type)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    # only the rows that lose something go through Python
    changed = joined.where(F.col(held).isNotNull()).mapInArrow(run, joined.schema)
    out = changed.unionByName(joined.where(F.col(held).isNull())).drop(held)
    return out if details else out.drop(starts, ends, sources)
