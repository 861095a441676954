"""Quality classifier by co-training: a view of the text and a view of the page's metadata."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .common import mixed, small_batches, word_hashes

CLASSES = 13  # kinds of bytes


def _byte_classes() -> bytes:
    kinds = np.full(256, 12, np.uint8)  # other controls
    kinds[128:] = 0
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".,;:", b"!?", b"#*", b"$%&", b"|<>", b"'\"()-", b"@/\\=+_~^`[]{}")):
        kinds[list(chars)] = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)[k]
    return kinds.tobytes()


BYTE_CLASS = _byte_classes()
WORDS = 128  # buckets of hashed words
TEXT_WIDTH = CLASSES * CLASSES + WORDS + 6
META_WIDTH = 2 + 64


@dataclass(frozen=True)
class CoTraining:
    """Settings of the operator.

    labelled         most labelled documents that the models are fitted on
    lent             most documents per round and class that a view labels for the other
    rounds           exchanges
    confident        least calibrated probability of a pseudo-label
    held_out         share of the labelled sample that no fit sees; one half of it calibrates the
                     views, the other one weighs them
    threshold        a document is kept from this probability of good quality on
    """

    labelled: int = 12_000
    lent: int = 500
    rounds: int = 3
    confident: float = 0.95
    held_out: float = 0.4
    threshold: float = 0.5
    ridge: float = 1.0


def text_view(text: bytes | None) -> np.ndarray:
    """How often each kind of byte follows each other kind, roots of the shares of hashed words
    (ASCII capitals lowered), and shares of repeated lines and words; all zero for a null or
    empty text."""
    out = np.zeros(TEXT_WIDTH, np.float32)
    if not text:
        return out
    kinds = np.frombuffer(text.translate(BYTE_CLASS), np.uint8)
    out[: CLASSES * CLASSES] = np.bincount(kinds[:-1] * np.uint8(CLASSES) + kinds[1:], minlength=CLASSES * CLASSES)[: CLASSES * CLASSES] / len(kinds)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n = max(1, len(words))
    if words:
        met = np.bincount((word_hashes(text.lower().split()) & np.uint64(WORDS - 1)).astype(np.int64), minlength=WORDS)
        out[CLASSES * CLASSES : -6] = np.sqrt(met / n)
    out[-6:] = (
        1, min(math.log1p(len(words)) / 10, 2), min(len(text) / n / 20, 10), len(set(words)) / n,
        len(set(lines)) / max(1, len(lines)), min(len(lines) / n, 1),
    )
    return out


def meta_view(values: tuple, n_chars: float | None) -> np.ndarray:
    """Metadata values as hashed indicators and the logarithm of the length; nulls are a value."""
    out = np.zeros(META_WIDTH, np.float32)
    out[0] = 1
    out[1] = min(math.log1p(max(0.0, float(n_chars or 0))) / 12, 3)
    for k, v in enumerate(values):
        out[2 + xxhash.xxh3_64_intdigest(f"{k}:{v}".encode()) % 64] += 1
    return out


# ---- logistic models on small matrices -----------------------------------------------------


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; both classes weigh the same.
    Only blocks of rows are widened to doubles at a time."""
    good = weight[y > 0.5].sum()
    bad = weight.sum() - good
    w = weight * np.where(y > 0.5, 0.5 / max(good, 1e-9), 0.5 / max(bad, 1e-9)) * weight.sum()
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        bend, slope = ridge * np.eye(x.shape[1]), ridge * beta
        for at in range(0, len(x), 2048):
            rows, part = x[at : at + 2048].astype(np.float64), slice(at, at + 2048)
            p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
            bend += (rows * (w[part] * p * (1 - p))[:, None]).T @ rows
            slope = slope + rows.T @ (w[part] * (p - y[part]))
        step = np.linalg.solve(bend, slope)
        beta -= step
        if np.abs(step).max() < 1e-4:
            break
    return beta


def calibrated(score: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and offset that turn a score into log-odds (Platt scaling with smoothed targets)."""
    good, bad = (y > 0.5).sum(), (y <= 0.5).sum()
    target = np.where(y > 0.5, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.column_stack([score, np.ones_like(score)])
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * (ab - [1, 0]))
        ab -= step
        if np.abs(step).max() < 1e-6:
            break
    return ab


def _weighed(odds: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of log-odds, drawn to their plain sum; Newton steps are halved until they help."""
    prior = np.append(np.ones(odds.shape[1] - 1), 0.0)

    def loss(w: np.ndarray) -> float:
        z = odds @ w
        return float((np.logaddexp(0, z) - y * z).sum() + ((w - prior) ** 2).sum() / 2)

    w = prior
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(odds @ w, -30, 30)))
        step = np.linalg.solve((odds * (p * (1 - p))[:, None]).T @ odds + np.eye(len(w)), odds.T @ (p - y) + (w - prior))
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
    return w


@dataclass
class Model:
    """Both views' weights and calibrations, and how their log-odds are combined."""

    views: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # mean, spread, weights, calibration
    combine: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def log_odds(self, k: int, x: np.ndarray) -> np.ndarray:
        mean, spread, beta, (a, b) = self.views[k]
        return a * (((x - mean) / spread) @ beta) + b

    def probabilities(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """p_text, p_meta and the combined probability of good quality."""
        one, two = (np.clip(self.log_odds(k, x), -30, 30) for k, x in enumerate((text, meta)))
        both = self.combine[0] * one + self.combine[1] * two + self.combine[2]
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (one, two, both))


def confident(model: Model, views: list[np.ndarray], keys: np.ndarray, round_: int, job: CoTraining) -> list[tuple[int, float, np.ndarray, np.ndarray]]:
    """(view, label, order, row numbers) of the rows that each view is sure of, per label: of rows
    with one key the first, and of all keys the ``lent`` that a hash of key and round puts first.
    So copies count once, every sure row has the same chance, and what several parts of a table
    choose can be merged by order."""
    out = []
    for k, x in enumerate(views):
        p = 1 / (1 + np.exp(-np.clip(model.log_odds(k, x), -30, 30)))
        for label, sure in ((1.0, p), (0.0, 1 - p)):
            at = np.flatnonzero(sure >= job.confident)
            with np.errstate(over="ignore"):
                order, first = np.unique(mixed(keys[at] + np.uint64(round_ + 1)), return_index=True)
            out.append((k, label, order[: job.lent], at[first[: job.lent]]))
    return out


def row_keys(views: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row's features in all views."""
    rows = zip(*views, strict=True)
    return np.fromiter((xxhash.xxh3_64_intdigest(b"".join(x.tobytes() for x in r)) for r in rows), np.uint64, len(views[0]))


def _parts(known: np.ndarray, y: np.ndarray, held_out: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows to fit on, to calibrate on and to weigh the views on; each class is dealt by itself."""
    parts: list[list[np.ndarray]] = [[], [], []]
    for label in (0.0, 1.0):
        rows = np.random.default_rng(3).permutation(known[y[known] == label])
        half = -(-int(len(rows) * held_out) // 2)
        for part, of in zip(parts, (rows[2 * half :], rows[:half], rows[half : 2 * half]), strict=True):
            part.append(of)
    return tuple(np.sort(np.concatenate(p)) for p in parts)


Lent = list[tuple[int, float, np.ndarray, list[np.ndarray]]]  # view that labels, label, keys, features in both views


def co_trained(views: list[np.ndarray], y: np.ndarray, job: CoTraining, draw: Callable[[Model, int], Lent] | None = None) -> Model:
    """Fit both views; ``y`` is 0 or 1, NaN for unlabelled rows.

    In each round every view is fitted and calibrated, labels unlabelled documents that it is
    sure of, and hands them to the other view; ``draw`` finds them (by default among the NaN rows).
    No fit sees the held-out rows: one half of them calibrates the views, and on the other half
    a two-feature logistic model weighs the two log-odds. Without both classes in each of the
    three parts every probability is the labels' mean (0.5 without labels).
    """
    known = np.flatnonzero(~np.isnan(y))
    train, hold, last = _parts(known, y, job.held_out)
    model = Model()
    for x in views:
        rows = x[known] if len(known) else np.zeros((1, x.shape[1]))
        mean, spread = rows.mean(axis=0, dtype=np.float64), rows.std(axis=0, dtype=np.float64)
        mean, spread = np.where(spread < 1e-6, 0, mean), np.where(spread < 1e-6, 1, spread)
        model.views.append((mean, spread, np.zeros(x.shape[1]), np.array([1.0, 0.0])))
    if any(len(set(y[part].tolist())) < 2 for part in (train, hold, last)):
        share = np.clip(y[known].mean(), 1e-3, 1 - 1e-3) if len(known) else 0.5
        odds = math.log(share / (1 - share))
        model.views = [(m, s, b, np.array([1.0, odds])) for m, s, b, _ in model.views]
        model.combine = np.array([0.0, 0.0, odds])
        return model
    if draw is None:
        pool = [x[np.isnan(y)] for x in views]
        keys = row_keys(pool)

        def draw(model: Model, round_: int) -> Lent:
            return [(k, label, keys[at], [x[at] for x in pool]) for k, label, _, at in confident(model, pool, keys, round_, job)]

    got: list[dict[int, tuple[float, np.ndarray]]] = [{}, {}]  # what each view has been lent, by key
    for round_ in range(job.rounds + 1):
        for k, x in enumerate(views):
            mean, spread = model.views[k][:2]
            extra = [got[k][key] for key in sorted(got[k])]
            rows = ((np.concatenate([x[train], *(r[None, :] for _, r in extra)]) - mean) / spread).astype(np.float32)
            target = np.concatenate([y[train], [label for label, _ in extra]])
            weight = np.concatenate([np.ones(len(train)), np.full(len(extra), 0.5)])
            beta = fitted(rows, target, weight, job.ridge)
            model.views[k] = (mean, spread, beta, calibrated(((x[hold] - mean) / spread) @ beta, y[hold]))
        if round_ < job.rounds:
            for k, label, keys_, rows in draw(model, round_):
                for key, row in zip(keys_.tolist(), rows[1 - k], strict=True):
                    got[1 - k].setdefault(key, (label, row))
    odds = np.column_stack([*(np.clip(model.log_odds(k, x[last]), -30, 30) for k, x in enumerate(views)), np.ones(len(last))])
    combine = _weighed(odds, y[last])
    model.combine = combine
    return model


# ---- Spark ----------------------------------------------------------------------------------


def _rows(batch: pa.RecordBatch, text: int, meta: list[int], length: int | None) -> tuple[np.ndarray, np.ndarray]:
    texts = batch.column(text).cast(pa.binary()).to_pylist()
    values = [batch.column(m).to_pylist() for m in meta]
    sizes = batch.column(length).to_pylist() if length is not None else [None] * len(texts)
    one = np.stack([text_view(t) for t in texts]) if texts else np.zeros((0, TEXT_WIDTH), np.float32)
    rows = list(zip(*values, strict=True)) if meta else [()] * len(texts)
    two = np.stack([meta_view(v, n) for v, n in zip(rows, sizes, strict=True)]) if texts else np.zeros((0, META_WIDTH), np.float32)
    return one, two


def _positions(docs: DataFrame) -> tuple[int, list[int], int | None]:
    names = docs.columns
    return names.index("text"), [names.index(c) for c in ("lang", "source") if c in names], names.index("n_chars") if "n_chars" in names else None


def _matrix(column: pa.ChunkedArray, width: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width).astype(np.float32)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, key, one, two: both views of every document as half-precision numbers, and their hash."""
    wanted = [c for c in ("text", "lang", "source", "n_chars") if c in docs.columns]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *wanted)
    t, meta, length = _positions(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = [x.astype(np.float16) for x in _rows(batch, t, meta, length)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(row_keys(views).view(np.int64)), *(pa.array([x.tobytes() for x in v], pa.binary()) for v in views)],
                ["doc_id", "key", "one", "two"],
            )

    return source.mapInArrow(run, "doc_id long, key long, one binary, two binary")


def drawn(pool: DataFrame, model: Model, round_: int, job: CoTraining) -> Lent:
    """What each view labels for the other in one round, chosen among all rows of ``pool``
    (key, one, two). A task hands on the first ``lent`` keys of each view and label, and only
    as many features reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, float], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            views = [_matrix(batch.column(1 + k), width, np.float16) for k, width in enumerate((TEXT_WIDTH, META_WIDTH))]
            for k, label, order, at in confident(model, views, keys, round_, job):
                old = best.get((k, label), (order[:0], keys[:0]))
                order, first = np.unique(np.concatenate([old[0], order]), return_index=True)
                best[k, label] = order[: job.lent], np.concatenate([old[1], keys[at]])[first[: job.lent]]
        for (k, label), (order, keys) in best.items():
            # the order's upper 63 bits, so that it is not negative
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * len(keys), pa.int32()), pa.array([label] * len(keys), pa.float64()), pa.array((order >> np.uint64(1)).view(np.int64)), pa.array(keys.view(np.int64))],
                ["k", "label", "place", "key"],
            )

    told = materialize(pool.select("key", "one", "two").mapInArrow(run, "k int, label double, place long, key long"), "confident")
    firsts = [told.where((F.col("k") == k) & (F.col("label") == label)).distinct().orderBy("place", "key").limit(job.lent) for k in (0, 1) for label in (1.0, 0.0)]
    chosen = reduce(DataFrame.unionByName, firsts)
    rows = pool.join(F.broadcast(chosen), "key").dropDuplicates(["k", "label", "key"]).select("k", "label", "place", "key", "one", "two").toArrow()
    rows = rows.sort_by([("k", "ascending"), ("label", "descending"), ("place", "ascending"), ("key", "ascending")])
    k, label = rows["k"].to_numpy(), rows["label"].to_numpy()
    keys, one, two = rows["key"].to_numpy().view(np.uint64), _matrix(rows["one"], TEXT_WIDTH, np.float16), _matrix(rows["two"], META_WIDTH, np.float16)
    parts = [(v, x, (k == v) & (label == x)) for v in (0, 1) for x in (1.0, 0.0)]
    return [(v, x, keys[at], [one[at], two[at]]) for v, x, at in parts]


def train(docs: DataFrame, labels: DataFrame, job: CoTraining = CoTraining(), label: str = "quality") -> Model:
    """Fit on at most ``labelled`` labelled documents, the ones whose ids have the smallest hashes,
    and on what the views lend each other out of all unlabelled ones. Several labels of one
    document are averaged, ties go to bad; labels of no document are not used.

    The features of the unlabelled documents are written once and read in every round; only the
    bounded choice of documents reaches the driver.
    """
    small_batches(docs.sparkSession)
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    marks = marks.groupBy("doc_id").agg((F.avg("y") > 0.5).cast("double").alias("y"))
    some = marks.orderBy(F.xxhash64(F.col("doc_id"), F.lit(29)), "doc_id").limit(job.labelled)
    views = materialize(features(docs).join(marks, "doc_id", "left").withColumnRenamed("y", "label"), "features")
    known = views.where("label is not null").join(F.broadcast(some), "doc_id").select("doc_id", "key", "y", "one", "two").toArrow()
    known = known.sort_by([("doc_id", "ascending"), ("key", "ascending")])
    pool = views.where("label is null").select("key", "one", "two")
    y = known["y"].to_numpy().astype(np.float64)
    return co_trained(
        [_matrix(known["one"], TEXT_WIDTH, np.float16), _matrix(known["two"], META_WIDTH, np.float16)], y, job,
        lambda model, round_: drawn(pool, model, round_, job),
    )


def score(docs: DataFrame, model: Model, job: CoTraining = CoTraining()) -> DataFrame:
    """doc_id, p_text, p_meta, p_quality and kept for every row of ``docs``.

    A null text counts as an empty one; null metadata is a value of its own; a null doc_id is
    scored too. Repeated rows get equal scores. No rows give no rows. Absent metadata columns
    are left out of their view; other columns are not read.
    """
    small_batches(docs.sparkSession)
    wanted = [c for c in ("text", "lang", "source", "n_chars") if c in docs.columns]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *wanted)
    t, meta, length = _positions(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p_text, p_meta, p = model.probabilities(*_rows(batch, t, meta, length))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p_text), pa.array(p_meta), pa.array(p), pa.array(p >= job.threshold)],
                ["doc_id", "p_text", "p_meta", "p_quality", "kept"],
            )

    return source.mapInArrow(run, "doc_id long, p_text double, p_meta double, p_quality double, kept boolean")


def keep_good(docs: DataFrame, model: Model, job: CoTraining = CoTraining()) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; columns as they are."""
    small_batches(docs.sparkSession)
    t, meta, length = _positions(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.probabilities(*_rows(batch, t, meta, length))[2] >= job.threshold))

    return docs.mapInArrow(run, docs.schema)
