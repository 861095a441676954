"""Near-duplicates and repeated passages against brute force."""

import itertools
import random

import numpy as np
from helpers import SCHEMA, corpus, documents, odd_texts, sentence
from pyspark.sql import functions as F

from decaytrace.llm import graph, minhash, substrings


def brute_components(texts, width, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
        sets.setdefault(i, []).append(s)
    up = {i: i for i in sets if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(up), 2):
        for x, y in itertools.product(sets[a], sets[b]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {i: root(i) for i in up}, {i: sorted(map(len, s)) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark):
    texts = corpus()[0] + odd_texts() + [(904, "one"), (700, "Two Words"), (701, "two words"), (702, "two")]
    df = documents(spark, texts).withColumnRenamed("n_chars", "Component_ID").repartition(5)
    for job in (minhash.NearDup(3, 85), minhash.NearDup()):
        want, sizes = brute_components(texts, job.width, job.percent)
        got = minhash.near_duplicates(df, job).collect()
        assert len(got) == len(texts)
        for r in got:
            assert r["component_id"] == want.get(r["doc_id"]) and r["n_shingles"] in sizes[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] is None or r["component_id"] == r["doc_id"])
        assert want[700] == want[701] == 700 and want[702] == 702 and want[902] == 902


def test_a_chain_of_near_copies_is_one_component(spark):
    rng = random.Random(4)
    words = sentence(rng, 120).split()
    texts = []
    for k in range(30):  # each differs from the last in one word: the ends have little in common
        words[4 * k] = f"new{k}"
        texts.append((k, " ".join(words)))
    want, _ = brute_components(texts, 3, 85)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(documents(spark, texts), minhash.NearDup(3, 85)).collect()}
    assert got == want and set(got.values()) == {0}


def test_blocks_split_a_group_without_losing_links(spark):
    rng = random.Random(6)
    base = sentence(rng, 150).split()
    texts = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10_000)}"
        texts.append((k, " ".join(w)))
    want, _ = brute_components(texts, 3, 85)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(documents(spark, texts), minhash.NearDup(3, 85, block_docs=7)).collect()}
    assert got == want


def test_no_rows_give_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.drop_near_duplicates(empty).columns == empty.columns
    assert substrings.remove_repeats(empty).count() == 0


def test_registers_and_estimates():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 4_000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:3_000], rng.integers(0, 2**63, 1_000).astype(np.uint64)]))
    k = 2_000
    ra, rb = minhash.registers_of(a, k), minhash.registers_of(b, k)
    guess = minhash.estimated_jaccard(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0, 0]
    assert abs(guess - 0.6) < 0.05
    # registers are the leading zeros and the bits after the leading one of the smallest hash
    assert (ra >> minhash.MANTISSA).min() >= 5 and (ra >> minhash.MANTISSA).max() < 32
    far = minhash.registers_of(np.unique(rng.integers(0, 2**63, 4_000).astype(np.uint64)), k)
    assert minhash.estimated_jaccard(ra[None], far[None], np.array([len(a)]), np.array([4_000]))[0, 0] < 0.01


def test_components_of_paths_loops_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 202), (202, 200), (None, 5)] + [(300, 301 + i) for i in range(50)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[100] == 100 and {got[i] for i in (200, 201, 202)} == {200}
    assert {got[301 + i] for i in range(50)} == {300}


def test_repeated_passages_are_cut_once_everywhere_but_first(spark):
    texts, passage = corpus(seed=9)
    texts += odd_texts() + [(205, "same id, other text " * 3)]
    df = documents(spark, texts).withColumn("Removed_Starts", F.lit(1)).repartition(4)
    out = substrings.remove_repeats(df)
    assert out.columns == df.columns
    got = out.collect()
    assert len(got) == len(texts)
    middle = " ".join(passage.split()[10:-10])
    holders = sorted(r["doc_id"] for r in got if r["text"] and middle in " ".join(r["text"].split()))
    assert holders == [300]
    old = {i: t for i, t in texts if i is not None}
    for r in got:
        if r["doc_id"] is None or r["doc_id"] < 100 or r["doc_id"] in (901, 902, 903, 904):
            assert r["doc_id"] is None or r["text"] == old[r["doc_id"]], r["doc_id"]
        if r["doc_id"] == 906:  # it repeats itself
            assert 0 < len(r["text"]) < len(old[906]) and old[906].startswith(r["text"])
        if r["doc_id"] is not None and 100 <= r["doc_id"] < 200:
            assert r["text"] == ""  # an exact copy of an earlier document
        if r["text"] is not None and r["doc_id"] is not None and r["text"] != old.get(r["doc_id"]):
            assert r["n_chars"] in (len(r["text"]), len(old[r["doc_id"]]), 60)


def digests(text, job=substrings.Chunking()):
    return set(map(tuple, substrings.keys_of([text], job)[0].tolist()))


def test_chunks_resist_insertions():
    rng = random.Random(2)
    text = sentence(rng, 600).encode()
    job = substrings.Chunking()
    before, after = digests(text), digests(text[:1500] + b" inserted words " + text[1500:])
    assert len(before - after) <= 4 < len(before) / 4
    assert set(map(tuple, substrings.keys_of([b"other", b"", text], job)[0].tolist())) - digests(b"other") == before
    assert digests(text.replace(b" ", b"\n")) == before  # whatever blanks part the words
    joined, of, start, end = substrings.chunks_of([b" a b", b"", text], job)
    assert (start[1:] >= end[:-1]).all() and sorted(set(of.tolist())) == [0, 2]
    assert all(joined[x:y].strip() for x, y in zip(start, end, strict=True))


def blank_free(rng, n):
    return "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(n))


def test_text_without_blanks_has_chunks_of_its_own(spark):
    rng = random.Random(12)
    shared = {"han": blank_free(rng, 1500), "code": "".join(rng.choice("abcdefgh(){};=+.01") for _ in range(3000))}
    for passage in shared.values():
        one, two = digests(("x" + passage).encode()), digests(("entirely other words before " + passage + "tail").encode())
        assert len(one & two) > 0.8 * len(one)
    texts, k = [], 0
    for passage in shared.values():
        for _ in range(3):
            texts.append((k, blank_free(rng, 300) + passage + blank_free(rng, 300)))
            k += 1
    texts.append((90, blank_free(rng, 2000)))
    got = {r["doc_id"]: r for r in substrings.remove_repeats(documents(spark, texts), details=True).collect()}
    old = dict(texts)
    for i in range(6):
        if i % 3:
            assert len(old[i]) - len(got[i]["text"]) > 0.9 * len(shared["han" if i < 3 else "code"]) and got[i]["source_ids"] == [i - i % 3]
            assert got[i]["text"][:250] == old[i][:250] and got[i]["text"][-250:] == old[i][-250:]
        else:
            assert got[i]["text"] == old[i]
    assert got[90]["text"] == old[90]


def test_spans_equal_a_brute_force_over_chunks(spark):
    texts, _ = corpus(seed=3, n=25)
    rng = random.Random(5)
    texts += [(400 + k, sentence(rng, 60) + " " + texts[k][1] + " " + sentence(rng, 10) + " " + texts[k][1]) for k in range(5)]
    job = substrings.Chunking()
    first, chunks = {}, {}
    for i, t in sorted(texts):
        digest, _, start, end = substrings.keys_of([t.encode()], job)
        chunks[i] = list(zip(map(tuple, digest.tolist()), start.tolist(), end.tolist(), strict=True))
        for d, s, _ in chunks[i]:
            first.setdefault(d, (i, s))
    want = {}
    for i, t in texts:
        runs = []
        for d, s, e in chunks[i]:
            if first[d] != (i, s):
                if runs and runs[-1][1] == s:
                    runs[-1][1] = e
                else:
                    runs.append([s, e])
        want[i] = [r for r in runs if len(t.encode()[r[0] : r[1]].split()) >= job.least_words]
    got = substrings.remove_repeats(documents(spark, texts).repartition(4), details=True).collect()
    assert sum(map(len, want.values())) > 20
    for r in got:
        assert [list(x) for x in zip(r["removed_starts"], r["removed_ends"], strict=True)] == want[r["doc_id"]]


def test_nearly_all_of_a_passage_of_51_words_is_found():
    rng = random.Random(31)
    job, caught = substrings.Chunking(), []
    for _ in range(300):
        passage = sentence(rng, 51)
        one, two = (sentence(rng, rng.randint(20, 90)) + " " + passage + " " + sentence(rng, 60) for _ in range(2))
        keys = set(map(tuple, substrings.keys_of([one.encode()], job)[0].tolist()))
        d, _, s, e = substrings.keys_of([two.encode()], job)
        caught.append(sum(substrings.n_words(two.encode()[a:b]) for x, a, b in zip(map(tuple, d.tolist()), s.tolist(), e.tolist(), strict=True) if x in keys))
    assert min(caught) >= job.least_words and np.mean(caught) > 35


def test_boundaries_come_from_a_plain_rolling_hash():
    rng = random.Random(8)
    text = (sentence(rng, 80) + "  \n " + sentence(rng, 40)).encode()
    h, plain = 0, []
    for byte in text:
        h = (2 * h + int(substrings.GEAR[byte])) % 65536
        plain.append(h)
    assert substrings.gear(text)[15:].tolist() == plain[15:]
