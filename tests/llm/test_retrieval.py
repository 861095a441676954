"""Retrieval packing: exact ids, no padding, BM25 by its formula, and windows of related texts."""

import math
import random
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import public_tokenizers
from helpers import SCHEMA, corpus, documents, odd_texts, sentence
from tokenizers import Tokenizer

from decaytrace.llm import retrieval
from decaytrace.llm.queries import tokenizer_settings

JOB = retrieval.Retrieval(tokenizer_settings())


def check(texts, got, capacity=2048):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    by_tokens = defaultdict(list)
    for i, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want[i, len(ids)] += 1
        by_tokens[i, len(ids)].append(np.array(ids, "<u4"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(want)
    for key, rows in pieces.items():
        assert sum(r["length"] for r in rows) == key[1] * want[key]
        if want[key] == 1:
            at = 0
            for r in sorted(rows, key=lambda r: r["start"]):
                assert r["start"] == at and r["ids_crc32"] == zlib.crc32(by_tokens[key][0][at : at + r["length"]].tobytes())
                at += r["length"]
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at == capacity or (at < capacity and at & (at - 1) == 0)
    return sequences


def test_pieces_and_windows(spark):
    texts = corpus(n=40)[0] + odd_texts() + [(1, "again"), (1, "again"), (950, "long text, really. " * 4_000)]
    df = documents(spark, texts).withColumnRenamed("lang", "Offset")
    results = []
    for shard, parts in ((1_024, 3), (8, 5), (8, 1), (2, 2)):
        got = retrieval.pack(df.repartition(parts), replace(JOB, shard_items=shard)).collect()
        sequences = check(texts, got)
        assert sum(sum(n for _, n in s) < 2048 for s in sequences.values()) <= 11
        results.append(sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"], r["offset"]) for r in got))
    assert results[1] == results[2]  # however the input is partitioned
    assert retrieval.pack(spark.createDataFrame([], SCHEMA), JOB).count() == 0
    check([(1, None), (2, "")], retrieval.pack(documents(spark, [(1, None), (2, "")]), JOB).collect())


def test_scores_are_bm25():
    rng = np.random.default_rng(2)
    items = [rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint32) for _ in range(80)]
    holding = np.array([sum(t in x for x in items) for t in range(60)])
    stats = retrieval.Statistics(np.maximum(0, np.log((80 - holding + 0.5) / (holding + 0.5))), float(np.mean([len(x) for x in items])))
    index = retrieval.Index(items, stats, JOB)
    for seed in range(0, 80, 7):
        got = index.scores(seed)
        for k, x in enumerate(items):
            tf = Counter(x.tolist())
            want = sum(
                max(0, math.log((80 - holding[t] + 0.5) / (holding[t] + 0.5))) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(x) / stats.mean_length))
                for t in set(items[seed].tolist()) if tf[t]
            )
            assert math.isclose(got[k], want, abs_tol=1e-9)
        unused = rng.random(80) < 0.5
        near = index.neighbours(seed, unused).tolist()
        assert near == sorted((k for k in range(80) if unused[k] and got[k] > 0), key=lambda k: (-got[k], k))


def test_windows_hold_related_texts(spark):
    rng = random.Random(1)
    topics = [[sentence(rng, 1) for _ in range(60)] for _ in range(12)]
    texts = [(k, " ".join(rng.choice(topics[k % 12]) for _ in range(120))) for k in range(360)]
    rng.shuffle(texts)
    got = retrieval.pack(documents(spark, texts), replace(JOB, shard_items=64)).collect()
    check(texts, got)
    windows = defaultdict(set)
    for r in got:
        windows[r["sequence_id"]].add(r["doc_id"])
    same = total = 0
    for ids in windows.values():
        kinds = Counter(i % 12 for i in ids)
        same, total = same + max(kinds.values()), total + len(ids)
    assert same / total > 0.6
