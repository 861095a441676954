"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a one-pass Viterbi."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import id_and_text, long_list

META = "▁"  # stands for a blank inside pieces


@dataclass(frozen=True)
class PieceModel:
    """A model file and how texts are cut.

    cache_words   words whose best path is remembered in a task
    unknown       score of a character that no piece holds, for each of its bytes; below any
                  piece's, so that bytes are for characters without a piece
    """

    path: str
    cache_words: int = 400_000
    unknown: float = -1e10


class _Known(dict):
    """The ids of a blank and a word. Frequent words come early; the table stays bounded."""

    def __init__(self, viterbi: Viterbi):
        self.viterbi = viterbi

    def __missing__(self, word: str) -> bytes:
        v = self.viterbi
        if len(word) > 1 and word[-1] in v.marks and word[-2].isalpha():
            return self[word[:-1]] + v.mark_ids[word[-1]]
        got = v.best(META + word)
        if len(self) < v.model.cache_words:
            self[word] = got
        return got


class Viterbi:
    """Best segmentation of a text into pieces: the one with the largest sum of scores.

    The automaton reads the text once; at each position the output links give every piece that
    ends there, and each relaxes the best score of that position. Ties go to the longer last
    piece. Characters without a path become byte pieces.
    """

    def __init__(self, model: PieceModel):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model.path)
        self.model = model
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(len(self.pieces))]
        self.byte_ids = np.zeros(256, np.int32)
        self.automaton = ahocorasick.Automaton()
        splits = True
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
            elif not special[i] and p:
                self.automaton.add_word(p, (i, len(p), sp.get_score(i)))
                splits = splits and META not in p.lstrip(META)
        self.automaton.make_automaton()
        self.by_words = splits  # no piece goes on over a blank: words are cut apart before the search
        self.bytes_of = [b"" if special[i] else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(META, " ").encode() for i, p in enumerate(self.pieces)]
        self.scores = np.array([model.unknown if sp.is_byte(i) else sp.get_score(i) for i in range(len(self.pieces))])
        inside = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        # a mark that no piece holds after a letter always begins a new piece there
        self.marks = frozenset(c for c in ",.!?;:" if not any(x[1] == c and x[0].isalpha() for x in inside))
        self.single = frozenset(p for p in self.pieces if len(p) == 1 and p in self.automaton)
        self.mark_ids = {c: self.best(c) for c in self.marks}
        self.known = _Known(self)

    def best(self, text: str) -> bytes:
        """Ids (32 bits each) of a text in which blanks are written as META."""
        n = len(text)
        score = [0.0] + [-np.inf] * n
        last = [0] * (n + 1)  # the last piece of the best path; -1: the bytes of one character
        size = [0] * (n + 1)
        gaps = not self.single.issuperset(text)
        at = 0  # positions up to here are final
        for end, (i, length, s) in self.automaton.iter(text):
            end += 1
            if gaps:
                self._bridge(text, score, last, size, at, end - 1)
                at = end - 1
            total = score[end - length] + s
            if total > score[end] or (total == score[end] and length > size[end]):
                score[end], last[end], size[end] = total, i, length
        if gaps:
            self._bridge(text, score, last, size, at, n)
        ids: list[int] = []
        k = n
        while k:
            if last[k] >= 0:
                ids.append(last[k])
            else:
                char = " " if text[k - 1] == META else text[k - 1]
                ids += [int(self.byte_ids[b]) for b in reversed(char.encode("utf-8", "replace"))]
            k -= size[k]
        return np.array(ids[::-1], np.int32).tobytes()

    def _bridge(self, text: str, score: list[float], last: list[int], size: list[int], at: int, upto: int) -> None:
        """Settle the positions that the automaton has passed: where spelling a character in
        bytes is better than what reached it, or nothing did."""
        for k in range(at + 1, upto + 1):
            spelled = score[k - 1] + self.model.unknown * len(text[k - 1].encode("utf-8", "replace"))
            if spelled > score[k]:
                score[k], last[k], size[k] = spelled, -1, 1

    def encode(self, text: str) -> tuple[np.ndarray, float]:
        """Ids and score of a whole text: a blank is put before it and blanks become META.

        A META that the text itself holds is spelled in bytes, so that decoding gives it back.
        """
        if not text:
            return np.empty(0, np.int32), 0.0
        out: list[bytes] = []
        for k, part in enumerate((" " + text).split(META)):
            if k:
                out.append(self.byte_ids[list(META.encode())].tobytes())
            if not self.by_words:
                out.append(self.best(part.replace(" ", META)))
                continue
            first, *words = part.split(" ")
            if first:
                out.append(self.best(first))
            if "" not in words:
                out += map(self.known.__getitem__, words)
                continue
            run = 0
            for w in words:
                run += 1
                if w:
                    out.append(self.known[w] if run == 1 else self.best(META * run + w))
                    run = 0
            if run:
                out.append(self.best(META * run))
        ids = np.frombuffer(b"".join(out), np.int32)
        return ids, float(self.scores[ids].sum())

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids, without the blank that encoding put before it."""
        raw = b"".join([self.bytes_of[i] for i in ids.tolist()])
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _viterbi(model: PieceModel) -> Viterbi:
    return Viterbi(model)


def encode(docs: DataFrame, model: PieceModel) -> DataFrame:
    """doc_id, ids (array of int), score: one row per row of ``docs``, whole texts, no shuffle.

    A null or empty text has no ids and score 0. Null ids and repeated rows are encoded like
    others; other columns are not read. No rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _viterbi(model)
        for batch in batches:
            made = [v.encode((t or b"").decode("utf-8", "replace")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), long_list([i for i, _ in made], pa.int32()), pa.array([s for _, s in made], pa.float64())], ["doc_id", "ids", "score"]
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>, score double")


def decode(encoded: DataFrame, model: PieceModel) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give a null text, none an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _viterbi(model)
        for batch in batches:
            lists = batch.column(1)
            texts = [v.decode(lists[k].values.to_numpy()) if lists[k].is_valid else None for k in range(len(lists))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def encode_and_decode(docs: DataFrame, model: PieceModel) -> DataFrame:
    """doc_id, n_pieces, score, ids and whether decoding gives the text back, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _viterbi(model)
        for batch in batches:
            texts = [(t or b"").decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            made = [v.encode(t) for t in texts]
            same = [v.decode(i) == t for (i, _), t in zip(made, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(i) for i, _ in made], pa.int64()), pa.array([s for _, s in made], pa.float64()),
                 long_list([i for i, _ in made], pa.int32()), pa.array(same, pa.bool_())],
                ["doc_id", "n_pieces", "score", "ids", "round_trip"],
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_pieces long, score double, ids array<int>, round_trip boolean")
