"""Helpers shared by the text operators: tables, words, hashes and free column names."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import findable as findable

MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, most: str = "8m") -> None:
    """Bound what crosses to Python at once by bytes, where the session leaves it to Spark: rows
    of blocks and very long texts are large, and a batch is counted in rows otherwise."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, most)


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only what a text operator reads, under its own names, whatever else the table holds."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, element by element."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= MIX_1
        x ^= x >> np.uint64(27)
        x *= MIX_2
        x ^= x >> np.uint64(31)
    return x


def odd_numbers(n: int, seed: int, dtype=np.uint64) -> np.ndarray:
    """``n`` fixed odd multipliers made from a counter."""
    with np.errstate(over="ignore"):
        made = mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return (made >> np.uint64(64 - 8 * np.dtype(dtype).itemsize)).astype(dtype) | dtype(1)


FACTORS = odd_numbers(16, 11)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of one whole text.

    ASCII capitals are lowered; words are split at blanks and the controls 9 to 13. A text
    with fewer words than ``width`` gives its whole word sequence as one shingle; a text
    without words, or none, gives no shingle.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    rows, used = max(1, len(h) - width + 1), min(width, len(h))
    with np.errstate(over="ignore"):
        total = np.full(rows, used, np.uint64)
        for k, factor in enumerate(FACTORS[:used] if used <= len(FACTORS) else odd_numbers(used, 11)):
            total += h[k : k + rows] * factor
        total = mixed(total)
    total.sort()
    return total[np.append(True, total[1:] != total[:-1])]


def long_list(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """Numpy arrays as one Arrow list column."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def by_bytes(ids: Iterable, texts: Iterable[bytes | None], most: int = 8 << 20) -> Iterator[tuple[list, list[bytes]]]:
    """Runs of rows with at most ``most`` bytes of text, or one longer text."""
    some_ids, some, held = [], [], 0
    for i, t in zip(ids, texts, strict=True):
        t = t or b""
        if some and held + len(t) > most:
            yield some_ids, some
            some_ids, some, held = [], [], 0
        some_ids.append(i)
        some.append(t)
        held += len(t)
    if some:
        yield some_ids, some
