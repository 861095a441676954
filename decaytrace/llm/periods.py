"""Runs: stretches of words that repeat with a period, found by common-extension queries.

The queries are answered from the sorted suffixes of a difference cover: of every ``v``
places only a few are sorted, and any two places reach sorted ones after the same few steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_bytes, fresh, id_and_text, long_list

# A perfect difference set; every residue is a difference of two of its numbers.
MODULUS = 31
COVER = (0, 1, 3, 8, 12, 18)


def _steps() -> np.ndarray:
    """steps[a, b]: how far residues a and b are from both being in the cover."""
    inside = np.isin(np.arange(MODULUS), COVER)
    both = np.empty((MODULUS, MODULUS), np.int64)
    for a in range(MODULUS):
        for b in range(MODULUS):
            both[a, b] = next(d for d in range(MODULUS) if inside[(a + d) % MODULUS] and inside[(b + d) % MODULUS])
    return both


STEPS = _steps()


class Extensions:
    """Longest common extensions to the right in ``seq``, whose last word occurs only there."""

    def __init__(self, seq: np.ndarray):
        n = len(seq)
        self.seq = np.concatenate([seq, np.full(2 * MODULUS, seq.max(initial=0) + 1, seq.dtype)])
        places = (np.arange(0, n, MODULUS)[:, None] + np.array(COVER)).ravel()
        places = places[places < n]
        rank = self._first_ranks(places)
        ranks = [rank]  # by ever longer heads of the suffixes, each twice the last
        step = len(COVER)
        while rank.max(initial=-1) + 1 < len(places):
            second = np.zeros(len(places), np.int64)
            second[:-step] = rank[step:] + 1  # a place and the one ``MODULUS`` further are ``len(COVER)`` apart here
            rank = np.unique(rank * (len(places) + 1) + second, return_inverse=True)[1].astype(np.int64)
            ranks.append(rank)
            step *= 2
        self.rank = rank
        self.minima = self._minima(self._neighbours(places, ranks))

    def _first_ranks(self, places: np.ndarray) -> np.ndarray:
        """Ranks by the first ``MODULUS`` words."""
        raw, width = self.seq.astype(">u4").tobytes(), 4 * MODULUS
        heads = [raw[p : p + width] for p in (4 * places).tolist()]
        order = sorted(range(len(heads)), key=heads.__getitem__)
        new = [a != b for a, b in zip(map(heads.__getitem__, order), map(heads.__getitem__, order[1:]), strict=False)]
        rank = np.empty(len(heads), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(new)]) if order else []
        return rank

    def _neighbours(self, places: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
        """Common lengths of suffixes that are neighbours in sorted order: by longest equal heads, then word by word."""
        order = np.argsort(ranks[-1], kind="stable")
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        for k in range(len(ranks) - 2, -1, -1):
            inside = np.flatnonzero(np.maximum(a, b) < len(places))
            equal = inside[ranks[k][a[inside]] == ranks[k][b[inside]]]
            common[equal] += MODULUS << k
            a[equal] += len(COVER) << k
            b[equal] += len(COVER) << k
        first, second = places[order[:-1]] + common, places[order[1:]] + common
        return common + self._directly(first, second, np.full(len(first), MODULUS))[0]

    def _directly(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal words from i and j on, at most ``most``, and which pairs had so many."""
        found, alive = most.copy(), np.arange(len(i))
        whole = np.ones(len(i), bool)
        for t in range(MODULUS):
            alive = alive[most[alive] > t]
            if not len(alive):
                break
            equal = self.seq[i[alive] + t] == self.seq[j[alive] + t]
            ended = alive[~equal]
            found[ended] = t
            whole[ended] = False
            alive = alive[equal]
        return found, whole

    @staticmethod
    def _minima(values: np.ndarray) -> list[np.ndarray]:
        """Sparse table: minima of all windows of 1, 2, 4, ... neighbours."""
        table = [values]
        while 2 << (len(table) - 1) <= len(values):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        return table

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from each i and its j > i on."""
        steps = STEPS[i % MODULUS, j % MODULUS]
        found, whole = self._directly(i, j, steps)
        at = np.flatnonzero(whole)
        if len(at):
            p, q = i[at] + steps[at], j[at] + steps[at]
            index = np.zeros(MODULUS, np.int64)
            index[list(COVER)] = np.arange(len(COVER))
            a, b = (self.rank[x // MODULUS * len(COVER) + index[x % MODULUS]] for x in (p, q))
            low, high = np.minimum(a, b), np.maximum(a, b)
            level = np.frexp((high - low).astype(float))[1] - 1
            common = np.empty(len(at), np.int64)
            for k in np.unique(level).tolist():
                these = level == k
                common[these] = np.minimum(self.minima[k][low[these]], self.minima[k][high[these] - (1 << k)])
            found[at] += common
        return found


def runs_of(lists: list[list[bytes]], least: int = 12, chunk: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """(list number, start, length, period) of every run of every word list, by list, start and period.

    For each period q places q apart form a grid; a run of that period is at least 2 q long, so
    it holds two neighbours of the grid, whose common extensions to both sides are the run. The
    grids of all periods have n ln n places; only those with equal words are extended.
    """
    sizes = np.array([len(x) for x in lists], np.int64)
    starts = np.cumsum(np.append(1, sizes[:-1] + 1)) if len(sizes) else sizes  # a word of its own on both sides
    numbers: dict[bytes, int] = {}
    parts = [[numbers.setdefault(w, len(numbers)) for w in words] for words in lists]
    seq = np.empty(int(sizes.sum()) + len(lists) + 1, np.int64)
    seq[0] = len(numbers)
    for k, (s, part) in enumerate(zip(starts.tolist(), parts, strict=True)):
        seq[s : s + len(part)] = part
        seq[s + len(part)] = len(numbers) + 1 + k
    long = np.flatnonzero(sizes >= least)
    halves = sizes[long] // 2
    owner = np.repeat(long, halves)
    period = np.arange(len(owner)) - np.repeat(np.cumsum(halves) - halves, halves) + 1
    many = (sizes[owner] - 1) // period  # neighbours on the grid
    before = np.concatenate([[0], np.cumsum(many)])
    found: list[np.ndarray] = []
    ahead = behind = None
    at, last = 0, len(seq)
    while at < len(owner):
        end = max(at + 1, int(np.searchsorted(before, before[at] + chunk, "right")) - 1)
        q = np.repeat(period[at:end], many[at:end])
        i = np.repeat(starts[owner[at:end]], many[at:end]) + (np.arange(len(q)) - np.repeat(before[at:end] - before[at], many[at:end])) * q
        equal = np.flatnonzero(seq[i] == seq[i + q])
        i, q, at = i[equal], q[equal], end
        if not len(i):
            continue
        if ahead is None:
            ahead, behind = Extensions(seq), Extensions(seq[::-1])
        right, left = ahead(i, i + q), behind(last - i - q, last - i)
        keep = right + left >= np.maximum(q, least - q)
        if keep.any():
            found.append(np.unique(np.stack([i - left, i + q + right, q], 1)[keep], axis=0))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none, none
    start, end, q = np.unique(np.concatenate(found), axis=0).T
    new = np.ones(len(start), bool)  # one stretch has many periods: the smallest counts
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[new], end[new], q[new]
    order = np.lexsort((q, start))
    start, end, q = start[order], end[order], q[order]
    of = np.searchsorted(starts, start, "right") - 1
    return of, start - starts[of], end - start, q


def _collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words less those that a run repeats."""
    if len(start):
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, start + period, 1)
        np.add.at(cover, start + length, -1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
    return b" ".join(words)


def find_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """doc_id, starts, lengths, periods and collapsed: the runs of each whole text and the text
    without what they repeat.

    Words are what blanks and the controls 9 to 13 part; a run is a longest stretch of at least
    ``least`` words and two periods in which words one (smallest) period apart are equal. Runs
    are in the order of start and period and may overlap. ``collapsed`` has the words that no
    run holds after its first period, joined by one space. A null or empty text has no runs and
    collapses to the empty text. Rows are independent: repeated rows and null ids are rows like
    any other, and no rows give no rows. Further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in by_bytes(batch.column(0).to_pylist(), batch.column(1).to_pylist(), 256 << 10):
                lists = [t.split() for t in texts]
                of, start, length, period = runs_of(lists, least)
                edges = np.searchsorted(of, np.arange(len(ids) + 1))
                cut = [slice(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()), *(long_list([x[c] for c in cut], pa.int64()) for x in (start, length, period)),
                        pa.array([_collapsed(w, start[c], length[c], period[c]) for w, c in zip(lists, cut, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "starts", "lengths", "periods", "collapsed"],
                )

    made = id_and_text(docs).mapInArrow(run, "doc_id long, starts array<long>, lengths array<long>, periods array<long>, collapsed binary")
    return made.withColumn("collapsed", F.col("collapsed").cast("string"))


def with_planted_period(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where each tenth document, by the checksum of its id, repeats some of its
    words to its end: from word a = g % n on, p = 1 + (n - a) div (3 + g % 8) words; g is a
    tenth of the checksum. A null id plants nothing."""
    g = fresh(docs, "g")
    d = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("long").cast("string")).alias(g))
    d = d.withColumn("words", F.when(F.col(g) % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))))
    d = d.withColumns({"n": F.size("words").cast("long"), g: F.expr(f"{g} div 10")})
    d = d.withColumn("a", F.when(F.col("n") > 0, F.col(g) % F.col("n")))
    d = d.withColumn("p", 1 + F.expr(f"(n - a) div (3 + {g} % 8)"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    planted = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", place(i).cast("int"))), " ")
    return d.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run and the digests of all runs and of the collapsed text."""
    runs = find_runs(docs).withColumn("runs", F.arrays_zip("starts", "lengths", "periods"))
    runs = runs.withColumn("top", F.array_max(F.transform("runs", lambda r: F.struct(r["lengths"].alias("length"), (-r["starts"]).alias("s"), (-r["periods"]).alias("p")))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["starts"].cast("string"), r["lengths"].cast("string"), r["periods"].cast("string")))
    return runs.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.s")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.p")).alias("period"),
        F.expr("1000L * top.length div -top.p").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# The same in SQL: all pairs of equal words, and islands of them by distance.
SQL = """
WITH c AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::BIGINT) ELSE r // 2 END)), 4294967295::BIGINT) AS h
  FROM documents),
a AS (SELECT *, len(words) AS n, h // 10 AS g, h % 10 = 0 AND len(words) > 0 AS hit FROM c),
b AS (SELECT *, CASE WHEN hit THEN g % n END AS a FROM a),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM b),
t AS (SELECT r, doc_id, n, CASE WHEN hit THEN list_transform(range(n), lambda i: words[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE words END AS words FROM p),
e AS (SELECT r, n, unnest(range(n)) AS i, unnest(words) AS w FROM t),
m AS (SELECT x.r, x.i, y.i - x.i AS q FROM e x JOIN e y ON x.r = y.r AND x.w = y.w AND x.i < y.i WHERE 2 * (y.i - x.i) <= x.n AND x.n >= 12),
k AS (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m),
f AS (SELECT r, q, min(i) AS s, count(*) AS many FROM k GROUP BY r, q, island HAVING count(*) >= greatest(q, 12 - q)),
runs AS (SELECT r, s AS start, many + q AS length, min(q) AS period FROM f GROUP BY r, s, many + q),
per AS (
  SELECT r, count(*) AS n_runs, max({'length': length, 's': -start, 'p': -period}) AS top,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS text FROM runs GROUP BY r),
dropped AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS text FROM e ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(-top.s AS BIGINT) AS start, CAST(top.length AS BIGINT) AS length, CAST(-top.p AS BIGINT) AS period,
  CAST(1000 * top.length // -top.p AS BIGINT) AS exponent_milli, sha256(coalesce(per.text, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM t LEFT JOIN per USING (r) LEFT JOIN kept USING (r)
"""
