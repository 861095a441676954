"""Packing: exact ids, gapless sequences, and bin counts near the bound."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from helpers import SCHEMA, corpus, documents, odd_texts
from tokenizers import Tokenizer

from decaytrace.llm import packing
from decaytrace.llm.queries import tokenizer_settings


def test_pieces_and_places(spark):
    texts = corpus(n=25)[0] + odd_texts() + [(1, "again"), (1, "again"), (950, "long text, really. " * 4_000)]
    job = tokenizer_settings()
    got = packing.pack(documents(spark, texts).withColumnRenamed("lang", "Offset").repartition(3), job).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for i, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want[i].append(ids)
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(want)
    for i, rows in pieces.items():
        assert sum(r["length"] for r in rows) == sum(map(len, want[i]))
        if len(want[i]) == 1:
            ids = want[i][0]
            for k, r in enumerate(sorted(rows, key=lambda r: r["piece"])):
                assert r["piece"] == k and r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
                assert r["length"] == 2048 or k == 0
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert packing.pack(spark.createDataFrame([], SCHEMA), job).count() == 0


def test_ids_equal_the_tokenizer():
    encode = packing.TokenIds(tokenizer_settings())
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["", " ", "a  b", "a\n b", "<|endoftext|> x", "x<|endoftext|>", "日本 語", "don't I'll 12 3a", " lead ", "a\tb", "né — x", "\n\n", "a \r\n", "ÄÖ ß"]
    for text in odd + [x for _, x in corpus(n=8)[0]]:
        assert encode(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_equal_the_tokenizer_on_many_short_texts():
    import itertools
    import random

    encode = packing.TokenIds(tokenizer_settings())
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    marks = ["a", "Z", "é", "ß", "1", "'", "'s", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\xad", "-", "<", "|", "²", "º", "ǅ", "Ȁ"]
    rng = random.Random(5)
    texts = ["".join(x) for x in itertools.product(marks, repeat=3)]
    texts += ["".join(chr(rng.randrange(0x250)) for _ in range(rng.randint(1, 30))) for _ in range(2_000)]
    for text in texts:
        assert encode(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_the_search_beats_or_equals_best_fit():
    lengths = np.random.default_rng(0).integers(600, 1400, 1500)
    search = packing.Search(lengths, 2048, 3)
    plain = len(search.member(True))
    best = search.evolve([], 4, 10)[0]
    assert search.least <= len(best) <= plain
    assert sorted(i for b in best for i in b) == list(range(1500)) and max(map(search.fill, best)) <= 2048
    assert packing.decoded(packing.encoded(best, 1500)) == [sorted(b) for b in best]
    one, two = search.member(False), search.member(False)
    child = search.crossover(one, two)
    assert sorted(i for b in child for i in b) == list(range(1500)) and max(map(search.fill, child)) <= 2048


def test_blocks_are_packed_together_in_the_end(spark):
    from dataclasses import replace

    texts = [(i, "word " * (1 + 37 * i % 1500)) for i in range(150)]
    got = packing.pack(documents(spark, texts), replace(tokenizer_settings(), block_items=20))
    assert got.select("sequence_id").distinct().count() <= -(-got.agg({"length": "sum"}).first()[0] // 2048) + 3
    assert got.count() == 150


def test_the_packing_does_not_depend_on_partitions(spark):
    from dataclasses import replace

    df = documents(spark, [(i, f"word {i} " * (1 + 37 * i % 300)) for i in range(60)])
    job, results = replace(tokenizer_settings(), block_items=20), []
    for parts in (1, 5):
        held = defaultdict(list)
        for r in packing.pack(df.repartition(parts), job).collect():
            held[r["sequence_id"]].append((r["doc_id"], r["piece"], r["offset"]))
        results.append(sorted(map(sorted, held.values())))
    assert results[0] == results[1]


def test_items_that_leave_gaps_anyway_are_not_packed_for_ever(spark):
    from dataclasses import replace

    texts = [(i, "word " * (1300 + i % 7)) for i in range(60)]
    got = packing.pack(documents(spark, texts), replace(tokenizer_settings(), block_items=10)).collect()
    assert len({r["sequence_id"] for r in got}) == len(got) == 60


def test_sequences_of_many_levels_have_numbers_of_their_own(spark, monkeypatch):
    from dataclasses import replace

    from pyspark.sql import functions as F

    job, levels = replace(tokenizer_settings(), block_items=1), []

    def one_in_seven_settles(items, blocks, job):
        rows = sorted(r["row"] for r in items.collect())
        levels.append(rows)
        many = -(-len(rows) // 7)
        placed = [(r, 1, 0, k, job.capacity if k < many or len(rows) == 1 else 1, 0) for k, r in enumerate(rows)]
        return spark.createDataFrame(placed, "row long, length int, block long, bin long, filled long, offset long")

    made = spark.range(120).select(
        F.col("id").alias("row"), F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).alias("start"), F.lit(1).alias("length"), F.lit(0).alias("ids_crc32")
    )
    monkeypatch.setattr(packing, "pieces", lambda docs, job: made)
    monkeypatch.setattr(packing, "pack_blocks", one_in_seven_settles)
    got = packing.pack(documents(spark, [(1, "a")]), job).collect()
    assert len(levels) >= 20 and len(got) == 120
    assert len({r["sequence_id"] for r in got}) == 120
