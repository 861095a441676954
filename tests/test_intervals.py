"""Interval operators against plain Python on small series, one of them far larger than the rest."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from decaytrace.operators import intervals as iv

WIDTHS = [3.0, 50.0, 1e6]


def series(seed=1):
    """One series holds over half of the rows; others are short, one is a single row."""
    rng = random.Random(seed)
    out = []
    for key, n in [("hot", 240), ("a", 40), ("b", 30), ("one", 1), ("low", 25)]:
        t = 0.0
        for i in range(n):
            t += rng.choice([0.25, 0.5, 1.0, 7.0])
            v = -1.0 if key == "low" else float(rng.choice([-1, -1, -1, 1, 1]))
            out.append((key, i, t, v, float(rng.randint(0, 12))))
    return out


def frame(spark):
    return spark.createDataFrame(series(), "k string, i int, t double, v double, level double")


def by_key(data):
    groups = defaultdict(list)
    for r in data:
        groups[r[0]].append(r)
    return groups


def result(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def plain_runs(min_len, guard, min_cut, step):
    out = []
    for key, rs in by_key(series()).items():
        start = None
        for _, _, t, v, _ in rs:
            if v < 0 and start is None:
                start = t
            elif v >= 0 and start is not None:
                if t - start >= min_len and (min_cut is None or (t - guard) - (start + guard) > min_cut):
                    out.append((key, start + guard, t - guard, False))
                start = None
        if start is not None and rs[-1][2] + step - start >= min_len:
            out.append((key, start + guard, rs[-1][2] + step, True))
    return sorted(out)


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("options", [dict(min_len=0.0, guard=0.0, min_cut=None, step=0.0), dict(min_len=1.0, guard=0.125, min_cut=0.5, step=0.25)])
def test_below_runs(spark, width, options):
    out = iv.below_runs(frame(spark), "k", "t", F.col("v") < 0, width, tie="i", **options)
    assert result(out, "k", "start", "end", "open_end") == plain_runs(**options)


def intervals(seed=3):
    rng = random.Random(seed)
    out = []
    for key, n in [("hot", 200), ("a", 30), ("b", 1)]:
        for _ in range(n):
            s = float(rng.randint(0, 400))
            out.append((key, s, s + rng.choice([0.0, 1.0, 2.0, 2.0, 30.0])))
    return out


def plain_merge(data):
    out = {}
    for key, rs in by_key(data).items():
        merged = []
        for _, s, e in sorted(rs):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out[key] = merged
    return out


@pytest.mark.parametrize("width", WIDTHS)
def test_merge_and_keep(spark, width):
    df = spark.createDataFrame(intervals(), "k string, start double, end double")
    merged = iv.merge_intervals(df, "k", width)
    expected = plain_merge(intervals())
    assert result(merged, "k", "start", "end") == sorted((k, s, e) for k, m in expected.items() for s, e in m)
    spans = spark.createDataFrame([("hot", 0.0, 500.0), ("a", 10.0, 500.0), ("b", 0.0, 500.0), ("none", 5.0, 6.0)], "k string, origin double, total double")
    kept = []
    for k, origin, total in [r for r in map(tuple, spans.collect())]:
        cursor = origin
        for a, b in expected.get(k, []):
            if a > cursor:
                kept.append((k, cursor, a))
            cursor = max(cursor, b)
        kept.append((k, cursor, total))
    assert result(iv.keep_ranges(merged, spans, "k", width), "k", "start", "end") == sorted(kept)


@pytest.mark.parametrize("width", [3.0, 50.0])
def test_nearest_snap(spark, width):
    rng = random.Random(5)
    gaps = [(k, s, s + 0.5) for k in ("hot", "a") for s in sorted(rng.uniform(0, 120) for _ in range(60))] + [("a", 10.0, 10.0), ("a", 11.0, 11.0)]
    points = [(k, i, rng.uniform(-2, 122)) for k in ("hot", "a", "none") for i in range(80)] + [("a", 999, 10.5)]
    out = iv.nearest_snap(
        spark.createDataFrame(points, "k string, i int, t double"), spark.createDataFrame(gaps, "k string, start double, end double"), "k", "t", width)
    expected = []
    for k, i, t in points:
        best, d = t, iv.SNAP_LIMIT
        for m in sorted((s + e) / 2.0 for g, s, e in gaps if g == k):
            if abs(m - t) < d:
                best, d = m, abs(m - t)
        expected.append((k, i, best))
    assert result(out, "k", "i", "snapped") == sorted(expected)


@pytest.mark.parametrize("width", [3.0, 1e6])
def test_overlap_fraction(spark, width):
    drops = [(k, s, e) for k, m in plain_merge(intervals()).items() for s, e in m]
    rng = random.Random(9)
    cuts = [(k, i, s, s + rng.choice([1.0, 4.0, 40.0])) for k in ("hot", "a", "none") for i, s in enumerate(rng.uniform(-5, 420) for _ in range(60))]
    out = iv.overlap_fraction(
        spark.createDataFrame(cuts, "k string, i int, start double, end double"), spark.createDataFrame(drops, "k string, start double, end double"), "k", width)
    expected = [
        (k, i, any(min(b, e) - max(a, s) > 0.5 * (b - a) for g, s, e in drops if g == k)) for k, i, a, b in cuts]
    assert result(out, "k", "i", "in_drop") == sorted(expected)


def test_threshold_is_the_exact_nearest_rank(spark):
    expected = []
    for key, rs in by_key(series()).items():
        s = sorted(r[4] for r in rs)
        expected.append((key, len(s), s[len(s) // 20], s[int(len(s) * 0.9)]))
    out = iv.adaptive_threshold(frame(spark), "k", "level")
    assert result(out, "k", "rows", "floor_level", "peak_level") == sorted(expected)


def test_threshold_on_a_large_skewed_series(spark):
    df = spark.range(60000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 50)) k", "pow(hash(id) % 1000003, 3) level")
    out = {r["k"]: (r["rows"], r["floor_level"], r["peak_level"]) for r in iv.adaptive_threshold(df, "k", "level").collect()}
    values = sorted(r["level"] for r in df.filter("k = 'hot'").collect())
    n = len(values)
    assert out["hot"] == (n, values[n // 20], values[int(n * 0.9)])


def test_anchors(spark):
    segs = spark.createDataFrame(
        [("c", 0, "In December it began"), ("c", 3, "the Vendor column"), ("c", 5, "in december again"), ("d", 0, "vendor"), ("d", 2, "December")],
        "conv string, turn bigint, text string")
    out = iv.anchor_ranges(segs, "conv", "turn", [("x", "in december"), ("y", "vendor")])
    assert result(out, "conv", "anchor", "start", "end", "in_order", "complete") == [
        ("c", "x", 0, 3, True, True), ("c", "y", 3, 6, True, True), ("d", "y", 0, 3, True, False)]
    out = iv.anchor_ranges(segs, "conv", "turn", [("x", "december"), ("y", "vendor")])
    assert [r for r in result(out, "conv", "anchor", "in_order") if r[0] == "d"] == [("d", "x", False), ("d", "y", False)]


def test_chunk_width_follows_the_busiest_series(spark):
    df = spark.range(1000).selectExpr("if(id < 900, 'hot', 'cold') k", "cast(id as double) t")
    assert iv.chunk_width(df, "k", "t", 1e9, rows=100) == 899.0 / 9
    assert iv.chunk_width(df, "k", "t", 1e9, rows=5000) == 1e9


def burst(seed=5):
    """Nearly all rows of one series fall on one instant."""
    rng = random.Random(seed)
    out = [("hot", i, 50.0, float(rng.choice([-1, -1, -1, 1]))) for i in range(600)]
    out += [("hot", 1000 + i, float(rng.randint(0, 100)), float(rng.choice([-1, 1]))) for i in range(30)]
    return out + [(k, i, float(rng.randint(0, 40)), float(rng.choice([-1, 1]))) for k in ("a", "b") for i in range(25)]


def test_a_burst_at_one_instant_spans_chunks(spark, monkeypatch):
    monkeypatch.setattr(iv, "ROWS_PER_CHUNK", 16)
    data = burst()
    df = spark.createDataFrame(data, "k string, i int, t double, v double").repartition(5)
    want = []
    for key, rs in by_key(data).items():
        start, rs = None, sorted(rs, key=lambda r: (r[2], r[1]))
        for r in rs:
            if r[3] < 0 and start is None:
                start = r[2]
            elif r[3] >= 0 and start is not None:
                want.append((key, start, r[2], False))
                start = None
        if start is not None:
            want.append((key, start, rs[-1][2], True))
    got = iv.below_runs(df, "k", "t", F.col("v") < 0, tie="i")
    assert result(got, "k", "start", "end", "open_end") == sorted(want)
    chunks = iv.chunked(df.select("k", "t", "i"), "k", ["t", "i"], None).groupBy("k", "chunk").count().collect()
    assert max(r["count"] for r in chunks) == 16 and len(chunks) > 40

    cuts = df.select("k", F.col("t").alias("start"), (F.col("t") + F.col("i") % 3).alias("end"))
    merged = defaultdict(list)
    for k, s, e in sorted(tuple(r) for r in cuts.collect()):
        if merged[k] and s <= merged[k][-1][1]:
            merged[k][-1][1] = max(merged[k][-1][1], e)
        else:
            merged[k].append([s, e])
    out = iv.merge_intervals(cuts, "k")
    assert result(out, "k", "start", "end") == sorted((k, *x) for k, xs in merged.items() for x in xs)
    spans = spark.createDataFrame([(k, 0.0, 200.0) for k in merged], "k string, origin double, total double")
    gaps = []
    for k, xs in merged.items():
        edges = [0.0, *[e for _, e in xs]]
        gaps += [(k, a, s) for a, (s, _) in zip(edges, xs, strict=False) if s > a] + [(k, edges[-1], 200.0)]
    assert result(iv.keep_ranges(out, spans, "k"), "k", "start", "end") == sorted(gaps)


def test_thresholds_do_not_depend_on_the_sketch(spark, monkeypatch):
    monkeypatch.setattr(iv, "ACCURACY", 1)  # a sketch this coarse misses most ranks
    monkeypatch.setattr(iv, "BRACKET", 0.0)
    rng = random.Random(3)
    values = {"exp": [2.0 ** rng.randint(-900, 900) for _ in range(400)], "same": [4.0] * 50, "two": [1.0] * 30 + [9.0] * 3, "one": [5.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double").repartition(4)
    got = {r["k"]: (r["floor_level"], r["peak_level"]) for r in iv.adaptive_threshold(df, "k", "v").collect()}
    assert got == {k: (sorted(vs)[len(vs) // 20], sorted(vs)[int(len(vs) * 0.9)]) for k, vs in values.items()}
