import os
import random

from conftest import rows
from pyspark.sql import functions as F

from decaytrace.operators import lineage


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def starts(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "dataset string")


def walk(df):
    return sorted((r["hop"], r["dataset"], r["upstream"] or "") for r in df.collect())


def test_each_dataset_once_at_its_shallowest_hop(spark):
    e = edges(spark, ("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"))
    assert walk(lineage.lineage_upstream(e, starts(spark, "a"))) == [(0, "a", "b"), (0, "a", "c"), (1, "b", "c"), (1, "c", "d"), (2, "d", "")]


def test_last_level_lists_parents_without_visiting(spark):
    e = edges(spark, ("b", "a"), ("c", "b"), ("d", "c"))
    assert walk(lineage.lineage_upstream(e, starts(spark, "a"), depth=2)) == [(0, "a", "b"), (1, "b", "c")]


def test_cycles_end(spark):
    e = edges(spark, ("b", "a"), ("a", "b"), ("b", "b"))
    assert walk(lineage.lineage_upstream(e, starts(spark, "a"), depth=6)) == [(0, "a", "b"), (1, "b", "a"), (1, "b", "b")]
    paths = lineage.lineage_paths_between(e, starts(spark, "a"), starts(spark, "b"), 5)
    assert [r["path"] for r in paths.collect()] == [["a", "b"]]


def test_a_hub_is_listed_whole(spark):
    e = spark.range(500).select(F.concat(F.lit("p"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("src"), F.lit("hub").alias("dst"))
    out = lineage.lineage_hops(lineage.lineage_upstream(e, starts(spark, "hub"), depth=1)).collect()
    assert {r["upstream_count"] for r in out} == {500} and sorted(r["upstream"] for r in out) == [f"p{i:04d}" for i in range(500)]


def test_a_long_chain_is_walked_to_its_end(spark):
    e = edges(spark, *[(f"n{k + 1}", f"n{k}") for k in range(6)])
    out = walk(lineage.lineage_upstream(e, starts(spark, "n0")))
    assert out == [(k, f"n{k}", f"n{k + 1}" if k < 6 else "") for k in range(7)]
    cut = lineage.lineage_upstream(e, starts(spark, "n0"), depth=2).collect()
    assert sorted((r["hop"], r["has_more"]) for r in cut) == [(0, False), (1, True)]
    paths = lineage.lineage_paths_between(e, starts(spark, "n0"), starts(spark, "n6", "n2")).collect()
    assert sorted(r["path"] for r in paths) == [["n0", "n1", "n2"], [f"n{k}" for k in range(7)]]


def test_siblings_collapse(spark):
    dbt = "urn:li:dataset:(urn:li:dataPlatform:dbt,x.wh.raw.t,PROD)"
    twin = "urn:li:dataset:(urn:li:dataPlatform:duckdb,wh.raw.t,PROD)"
    e = edges(spark, (twin, dbt), (dbt, "urn:li:dataset:(urn:li:dataPlatform:dbt,x.wh.mart.m,PROD)"))
    assert rows(lineage.collapse_siblings(e)) == [("raw.t", "mart.m")]
    hops = spark.createDataFrame([("m", 1, dbt), ("m", 2, twin)], "start string, hop int, dataset string")
    assert rows(lineage.hop_dedupe(hops)) == [("m", "raw.t", dbt, 2, 2)]


def test_source_column_is_the_default_root(spark):
    f = spark.createDataFrame([("speed", "speed"), ("flag", "flag")], "feature string, source_column string")
    r = spark.createDataFrame([("flag", "vendor_id")], "feature string, root_column string")
    roots = lineage.feature_root_map(f, r)
    assert sorted(rows(roots)) == [("flag", "flag", "vendor_id"), ("speed", "speed", "speed")]
    m = spark.createDataFrame([("flag", "fares")], "feature string, model string")
    assert rows(lineage.column_impact(roots, m)) == [("vendor_id", "flag", "fares", "vendor_id -> flag -> fares")]


def test_path_without_hops_invents_none(spark):
    p = spark.createDataFrame([(["raw.t"],), (["m", "s", "raw.t"],)], "path array<string>")
    out = lineage.lineage_path(p, F.lit("c"), F.lit("f"), F.lit("model"))
    assert sorted(r["path_text"] for r in out.collect()) == ["raw.t.c -> f -> model", "raw.t.c -> s -> m -> f -> model"]


def brute_walk(pairs, start, depth=None):
    seen, level, out, hop = {start}, [start], [], 0
    while level and (depth is None or hop < depth):
        ups = {d: sorted({u for u, x in pairs if x == d}) for d in level}
        out += [(start, hop, d, u) for d in level for u in ups[d] or [None]]
        level = sorted({u for d in level for u in ups[d]} - seen)
        seen |= set(level)
        hop += 1
    return out


def brute_paths(pairs, start, target):
    out, todo = [], [[start]]
    while todo:
        path = todo.pop()
        if path[-1] == target:
            out.append(path)
            continue
        todo += [path + [u] for u in sorted({u for u, d in pairs if d == path[-1]}) if u not in path]
    return [p for p in out if len(p) > 1]


def random_graph(seed, n, links, cyclic):
    rng = random.Random(seed)
    pairs = [tuple(sorted(rng.sample(range(n), 2))) for _ in range(links)]
    if cyclic:
        pairs = [p if rng.random() < 0.8 else p[::-1] for p in pairs] + [(3, 3)]
    return [(f"n{a}", f"n{b}") for a, b in pairs]


def test_walks_of_many_starts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lineage, "SHARED_FROM", 2)
    for seed, cyclic in ((1, False), (2, True)):
        layered = [(f"top{k % 3}", f"mid{k % 7}") for k in range(21)] + [(f"mid{k * 5 % 7}", f"low{k // 2}") for k in range(80)]
        pairs = random_graph(seed, 14, 40, cyclic) + layered + [("n1", "low0"), ("low0", "low1")] + ([("low3", "top1")] if cyclic else [])
        names = [f"low{k}" for k in range(40)] + ["n13", "n3", "alone"]
        for depth in (None, 2):
            got = lineage.lineage_upstream(edges(spark, *pairs, *pairs[:9], (None, "n1")), starts(spark, *names, names[0], None), depth).collect()
            want = [r for n in names for r in brute_walk(pairs, n, depth)]
            assert sorted(map(str, want)) == sorted(str(tuple(r)[:4]) for r in got)


def test_paths_and_their_counts_equal_brute_force(spark):
    for seed, cyclic in ((4, False), (5, True)):
        pairs = random_graph(seed, 10, 22, cyclic)
        names = [f"n{k}" for k in range(10)]
        some = spark.createDataFrame([(a, b) for a in names[4:] for b in names[:7] if a != b and (a > "n5" or b < "n3")], "start string, target string")
        e, s, t = edges(spark, *pairs), starts(spark, *names[4:]), starts(spark, *names[:7])
        for asked in (some,) if cyclic else (None,):
            wanted = {(a, b) for a in names[4:] for b in names[:7]} if asked is None else {tuple(r) for r in some.collect()}
            paths = {p: brute_paths(pairs, *p) for p in wanted if p[0] != p[1]}
            got = lineage.lineage_paths_between(e, s, t, pairs=asked).collect()
            assert sorted(r["path"] for r in got) == sorted(x for p in paths.values() for x in p)
            counts = {(r["start"], r["target"]): r for r in lineage.lineage_path_counts(e, s, t, asked).collect() if r["start"] != r["target"]}
            assert set(counts) == {p for p, x in paths.items() if x}
            for p, r in counts.items():
                least = min(map(len, paths[p]))
                assert r["hops"] == least - 1 and r["shortest_paths"] == sum(len(x) == least for x in paths[p])
                assert r["paths"] == len(paths[p]) or (cyclic and r["paths"] is None)
        if not cyclic:
            continue
        short = lineage.lineage_paths_between(e, s, t, 2).collect()
        every = [x for a in names[4:] for b in names[:7] if a != b for x in brute_paths(pairs, a, b)]
        assert sorted(r["path"] for r in short) == sorted(x for x in every if len(x) <= 3)


def test_a_ladder_of_diamonds_is_counted_without_its_paths(spark):
    deep = 20 if os.environ.get("ALL_QUERIES") else 6  # each level is some small jobs
    pairs = [p for k in range(deep) for p in ((f"t{k}", f"a{k}"), (f"t{k}", f"b{k}"), (f"a{k}", f"t{k + 1}"), (f"b{k}", f"t{k + 1}"))]
    out = lineage.lineage_path_counts(edges(spark, *pairs), starts(spark, f"t{deep}", "t1"), starts(spark, "t0")).collect()
    assert sorted((r["start"], r["hops"], int(r["shortest_paths"]), int(r["paths"])) for r in out) == [("t1", 2, 2, 2), (f"t{deep}", 2 * deep, 2**deep, 2**deep)]


def test_names_that_share_a_hash_are_numbered_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(lineage.F, "xxhash64", lambda c: F.length(F.col(c)).cast("long"))
    e = edges(spark, ("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"))
    assert walk(lineage.lineage_upstream(e, starts(spark, "a"))) == [(0, "a", "b"), (0, "a", "c"), (1, "b", "c"), (1, "c", "d"), (2, "d", "")]


def layered(cyclic):
    pairs = [(f"top{k % 3}", f"mid{k % 7}") for k in range(21)] + [(f"mid{k * 5 % 7}", f"low{k // 2}") for k in range(80)]
    pairs += [("top0", "roof"), ("low0", "low1"), ("top2", "low2"), ("low4", "low4")]
    return pairs + ([("low3", "top1"), ("roof", "top0")] if cyclic else []), [f"low{k}" for k in range(40)] + ["alone", "top0"]


def test_paths_of_many_starts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lineage, "SHARED_FROM", 2)
    monkeypatch.setattr(lineage, "LIST", 2)
    called = []
    real = lineage.handed_down
    monkeypatch.setattr(lineage, "handed_down", lambda *a: called.append(1) or real(*a))
    for cyclic in (False, True):
        pairs, names = layered(cyclic)
        e, s, ends = edges(spark, *pairs, *pairs[:5]), starts(spark, *names, names[0], None), ["top1", "mid3", "top0", "low1"]
        paths = {(a, b): brute_paths(pairs, a, b) for a in names for b in ends if a != b}
        some = [(a, b) for a, b in paths if (len(a) + len(b)) % 2]
        asked = spark.createDataFrame(some, "start string, target string") if cyclic else None
        wanted = paths if asked is None else {p: paths[p] for p in some}
        got = lineage.lineage_paths_between(e, s, starts(spark, *ends), pairs=asked).collect()
        assert sorted(r["path"] for r in got) == sorted(x for p in wanted.values() for x in p)
        assert all((r["start"], r["target"], r["nodes"]) == (r["path"][0], r["path"][-1], len(r["path"])) for r in got)
        short = lineage.lineage_paths_between(e, s, starts(spark, *ends), 2).collect() if cyclic else []
        assert not cyclic or sorted(r["path"] for r in short) == sorted(x for p in paths.values() for x in p if len(x) <= 3)
        counts = {(r["start"], r["target"]): r for r in lineage.lineage_path_counts(e, s, starts(spark, *ends)).collect()}
        assert {p for p in counts if p[0] != p[1]} == {p for p, x in paths.items() if x}
        assert {p: tuple(r)[2:] for p, r in counts.items() if p[0] == p[1]} == {(n, n): (0, 1, 1) for n in ("low1", "top0")}
        for p, x in paths.items():
            if x:
                least = min(map(len, x))
                assert counts[p]["hops"] == least - 1 and counts[p]["shortest_paths"] == sum(len(y) == least for y in x)
                assert counts[p]["paths"] == len(x) or counts[p]["paths"] is None
                assert cyclic or p[0] == "low4" or counts[p]["paths"] is not None
    assert called


def test_tables_and_counts_of_many_starts_equal_the_walk(spark, monkeypatch):
    pairs, names = layered(True)
    urn = lambda n: f"urn:li:dataset:(urn:li:dataPlatform:{'dbt' if n[-1] in '02468' else 'duckdb'},a.b.{n.rstrip('0123456789')}.x,PROD)-{n}"
    e, s = edges(spark, *[(urn(a), urn(b)) for a, b in pairs]), starts(spark, *map(urn, names))
    walk_ = lineage.lineage_upstream(e, s)
    want = [sorted(map(str, rows(df))) for df in (lineage.hop_dedupe(walk_.select("start", "hop", "dataset").distinct()), lineage.lineage_hops(walk_))]
    for shared in (2, 10**9):
        monkeypatch.setattr(lineage, "SHARED_FROM", shared)
        got = lineage.lineage_tables(e, s), lineage.lineage_hops(lineage.lineage_upstream(e, s, counted=True))
        assert [sorted(map(str, rows(df))) for df in got] == want


def test_names_that_no_walk_meets_are_not_kept(spark):
    graph = lineage.numbered(edges(spark, ("b", "a"), ("c", "b"), ("c", "x")), starts(spark, "a", "alone"))
    assert sorted(r["name"] for r in graph.nodes.collect()) == ["b", "c"] and sorted(r["name"] for r in graph.first.collect()) == ["a", "alone"]
    assert graph.own.count() == 1 and graph.inner.count() == 1 and graph.lonely.count() == 1
