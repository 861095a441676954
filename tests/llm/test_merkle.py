"""The manifest against a plain recursive tree, over blocks and rounds of several sizes."""

import hashlib
import zlib

import pytest
from helpers import SCHEMA, documents, odd_texts
from pyspark.sql import functions as F

from decaytrace.llm import merkle


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def state(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute(rows, fanout):
    """{(doc_id, leaf): (subroot, root, proof, folded roots)} by the definition."""

    def grow(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][k : k + fanout])) for k in range(0, len(levels[-1]), fanout)])
        return levels

    def way(levels, k):
        out = []
        for nodes in levels[:-1]:
            first = k - k % fanout
            out.append(("".join(nodes[first:k]), "".join(nodes[k + 1 : first + fanout])))
            k //= fanout
        return out

    langs = {}
    for i, text, lang, source, n in rows:
        leaf = lambda t: h(state(i) + state(source) + state(lang) + state(n) + state(t))  # noqa: B023, E731
        hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        lowered = text.translate({c: c + 32 for c in range(65, 91)}) if text is not None and hit else text
        langs.setdefault(lang, []).append(((i is not None, i or 0, leaf(text)), leaf(text), leaf(lowered), i))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: grow([leaf for _, leaf, _, _ in sorted(langs[x])]) for x in langs}
    top = grow([trees[x][-1][0] for x in order])
    out = []
    for place, lang in enumerate(order):
        for k, (_, leaf, new, i) in enumerate(sorted(langs[lang])):
            sides, node = way(trees[lang], k) + way(top, place), new
            for left, right in sides:
                node = h(left + node + right)
            out.append((i, leaf, trees[lang][-1][0], top[-1][0], h("".join(a + b for a, b in sides)), node, node == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("fanout", "height", "n"), [(8, 1, 130), (2, 2, 70)])
def test_manifest_equals_brute_force(spark, fanout, height, n):
    rows = [(k * 7 % n, f"Some Text {k}\nÄ {k}" if k % 5 else "no capitals", ["en", "de", None, "en", "é", "zz"][k % 6] if k % 2 else "en", None if k % 9 == 0 else "S", k) for k in range(n)]
    rows += [(i, t, "en", "s", None) for i, t in odd_texts()] + [(3, "Some Text", "en", "a", 1)] * 2 + [(3, "Some Other", "en", "a", 1), (None, "A", "one of its kind", None, None)]
    df = spark.createDataFrame([(i, t, x, s, c, "A") for i, t, x, s, c in rows], SCHEMA + ", Leaf string").repartition(5)
    got = merkle.tampered(df, merkle.Shape(fanout, height)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, fanout)
    assert {r["verified"] for r in got} == {True, False}


def test_a_lone_leaf_is_root_and_no_rows_give_none(spark):
    (only,) = merkle.tampered(documents(spark, [(1, "Text")])).collect()
    assert only["leaf"] == only["subroot"] == only["root"] and only["proof_sha256"] == h("") and only["verified"]
    assert merkle.tampered(documents(spark, [])).count() == 0


def test_a_version_copies_its_ancestors_only(spark):
    docs = documents(spark, [(k, f"text {k}") for k in range(100)])
    shape = merkle.Shape(4, 2)
    base = {r["doc_id"]: r for r in merkle.manifest(docs, F.lit(False), F.lit(None), shape=shape).collect()}
    new = merkle.manifest(docs, F.col("doc_id") == 5, F.lit("other"), shape=shape).where("doc_id = 5").first()
    whole = {r["doc_id"]: r for r in merkle.manifest(docs.withColumn("text", F.when(F.col("doc_id") == 5, "other").otherwise(F.col("text"))), shape=shape).collect()}
    assert new["root"] == base[5]["root"] and new["version_root"] == whole[5]["root"] != new["root"]
    assert new["copied"][-1] == new["version_root"] and new["changed_leaf"] == whole[5]["leaf"]
    assert set(new["copied"]).isdisjoint({base[5]["root"], base[5]["subroot"]})
    assert new["siblings"] == whole[5]["siblings"] and not base[5]["copied"]
    assert hashlib.sha256(new["siblings"].encode()).hexdigest() == new["siblings_sha256"]
