"""Runs against the definition, and extension queries against a plain comparison."""

import hashlib
import random
import zlib

import numpy as np
from helpers import SCHEMA, documents, odd_texts

from decaytrace.llm import periods


def brute(w, least=12):
    """(start, length, period) of all runs, by comparing words one period apart."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q):
                found.setdefault((s, i + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def words(rng, n, letters):
    return [rng.choice(letters).encode() for _ in range(n)]


def samples():
    rng = random.Random(3)
    out = [[], [b"a"], [b"a"] * 12, [b"a"] * 11, [b"x"] + [b"a", b"b"] * 6, [b"a"] * 500, [b"a", b"b", b"c"] * 100 + [b"c"]]
    out += [words(rng, rng.randint(5, 200), "ab") for _ in range(40)] + [words(rng, 300, "abcdefgh") for _ in range(5)]
    for _ in range(30):
        base, p = words(rng, rng.randint(1, 60), "abcdefghijkl"), rng.randint(1, 40)
        out.append(words(rng, rng.randint(0, 30), "abcdefghijkl") + (base * 9)[: rng.randint(2 * p, 9 * len(base) + 2 * p)] + words(rng, 20, "xyz"))
    fib = [b"a"], [b"a", b"b"]
    while len(fib[1]) < 700:
        fib = fib[1], fib[1] + fib[0]
    return out + [fib[1]]


def test_runs_equal_brute_force():
    lists = samples()
    for chunk in (1 << 20, 500):
        of, start, length, period = periods.runs_of(lists, chunk=chunk)
        got = [[] for _ in lists]
        for k, *r in zip(of.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
            got[k].append(tuple(r))
        for w, rows in zip(lists, got, strict=True):
            assert rows == brute(w)


def test_extensions_equal_a_plain_comparison():
    rng = np.random.default_rng(5)
    for seq in (rng.integers(0, 2, 900), np.tile(rng.integers(0, 50, 37), 30), np.zeros(400, np.int64)):
        seq = np.append(seq, 99).astype(np.int64)
        i = rng.integers(0, len(seq) - 1, 3000)
        j = rng.integers(0, len(seq), 3000)
        i, j = np.minimum(i, j), np.maximum(i, j)
        i, j = i[i < j], j[i < j]
        got = periods.Extensions(seq)(i, j)
        for a, b, n in zip(i.tolist(), j.tolist(), got.tolist(), strict=True):
            assert (seq[a : a + n] == seq[b : b + n]).all() and seq[a + n] != seq[b + n]


def test_every_residue_is_a_difference():
    assert {(a - b) % periods.MODULUS for a in periods.COVER for b in periods.COVER} == set(range(periods.MODULUS))


def test_query_equals_brute_force(spark):
    rng = random.Random(8)
    texts = [(i, "\t".join(w.decode() for w in words(rng, rng.randint(0, 90), "abcdefgh"))) for i in range(120)]
    texts += [(500 + k, " \n".join(x.decode() for x in w)) for k, w in enumerate(samples())] + odd_texts() + [(7, "again " * 20)] * 2
    got = periods.report(periods.with_planted_period(documents(spark, texts).withColumnRenamed("lang", "Starts").repartition(5))).collect()
    want = []
    for i, text in texts:
        w = (text or "").encode().split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute(w)
        drop = {k for s, n, q in runs for k in range(s + q, s + n)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
        want.append((i, len(runs), *top, 1000 * top[1] // top[2] if runs else None, digest(lines), digest(b" ".join(x for k, x in enumerate(w) if k not in drop))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(1 for r in got if r["n_runs"]) > 30
    assert periods.report(periods.with_planted_period(spark.createDataFrame([], SCHEMA))).count() == 0
