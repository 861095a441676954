"""WARC salvage, exact top-k and SentencePiece, against round trips and brute force."""

import base64
import hashlib
import io
import random
import tempfile

import numpy as np
import public_tokenizers
import pytest
from helpers import SCHEMA, corpus, documents, odd_texts
from pyspark.sql import functions as F

from decaytrace.llm import balltree, sentencepieces, warc

PAGES = "page_id long, url string, html string"


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def pages():
    rng = random.Random(1)
    rows = [(i, f"http://h{i % 3}/p {i}", "<p>" + "x" * rng.randint(0, 300) + f"{i % 17}") for i in range(60)]
    rows += [(100, "u", None), (101, None, ""), (102, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"), (103, "u", "é\r\n\r\n" * 50), (104, "u", "\x1f")]
    return rows + [(None, "u", "null id"), (5, "u", rows[5][2])]


@pytest.mark.parametrize("compress", [True, False])
def test_pages_come_back(spark, compress):
    rows = pages()
    df = spark.createDataFrame([(*r, 1) for r in rows], PAGES + ", Payload int").repartition(3)
    folder = tempfile.mkdtemp(prefix="warc-")
    got = warc.round_trip(spark, df, folder, warc.Archive(compress=compress, file_bytes=4_000)).collect()
    assert len(got) == len(rows) and not [r for r in got if r["gap_reason"]]
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = i is not None and i < last[h or ""]
        want.append((i, len(raw), digest(raw), "revisit" if revisit else "response", last[h or ""] if revisit else None))
    assert sorted(map(str, want)) == sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)
    assert warc.round_trip(spark, df.limit(0), tempfile.mkdtemp(prefix="warc-")).count() == 0


def archive(job, n=30):
    rng = random.Random(7)
    parts = [warc.page_record(i, "u", bytes(rng.randrange(256) for _ in range(rng.randint(0, 200))), "", None, job) for i in range(n)]
    fixed = []
    for i in range(n):
        payload = bytes(rng.randrange(256) for _ in range(rng.randint(0, 200)))
        fixed.append(warc.page_record(i, "u", payload, warc.digest_of(payload), None, job))
    del parts
    return fixed


def ids(found):
    return [int(r["fields"]["warc-record-id"][10:-1]) for r in found if "gap" not in r]


@pytest.mark.parametrize("compress", [True, False])
def test_damage_costs_only_the_records_it_touches(compress):
    job = warc.Archive(compress=compress, read_bytes=64)
    parts = archive(job)
    starts = np.cumsum([0] + [len(p) for p in parts])
    whole = b"".join(parts)
    assert ids(warc.salvage(io.BytesIO(whole), job)) == list(range(30))
    rng = random.Random(3)
    for _ in range(40):
        k = rng.randrange(30)
        at = int(starts[k]) + rng.randrange(len(parts[k]))
        kind = rng.choice(["flip", "cut", "insert", "end"])
        if kind == "flip":
            bad = whole[:at] + bytes([whole[at] ^ 0xFF]) + whole[at + 1 :]
        elif kind == "cut":
            bad = whole[:at] + whole[int(starts[k + 1]) :]
        elif kind == "insert":
            bad = whole[: int(starts[k])] + rng.randbytes(500) + whole[int(starts[k]) :]
        else:
            bad = whole[:at]
        found = list(warc.salvage(io.BytesIO(bad), job))
        lost = set(range(30)) - set(ids(found))
        allowed = {"flip": {k}, "cut": {k}, "insert": set(), "end": set(range(k, 30))}[kind]
        # in a plain archive a damaged header name can leave the record readable
        assert lost <= allowed, (kind, k, lost)
        covered = sum(r["gap"][1] - r["gap"][0] if "gap" in r else r["size"] for r in found)
        assert covered == len(bad)
        if compress and kind == "insert":
            assert len([r for r in found if "gap" in r]) == 1


def brute(vectors, asks, k=5, scale=256):
    ok = [(i, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, x in {(i, tuple(v)) for i, v in ok if asks(i)}:
        scores = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for i, v in ok if i != q and len(v) == len(x))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [4_096, 64])
def test_top_k_equals_brute_force(spark, shard_rows):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (4, 12))
    vectors = [(i, [float(x) for x in np.float32(centres[i % 4] + rng.normal(0, 0.3, 12))]) for i in range(400)]
    vectors += [(1000 + i, vectors[10][1]) for i in range(120)] + [(50, None), (100, []), (150, [None] * 12), (200, [float("nan")] * 12), (250, [float("inf")] * 12)]
    vectors += [(None, vectors[0][1]), (7, vectors[8][1]), (2000, [1.0, 2.0, 3.0]), (2001, [3.0, 2.0, 1.0])]
    vectors = [(i, v) for i, v in vectors if not (i in (50, 100, 150, 200, 250) and v and v[0] == v[0] and v[0] not in (None, float("inf")))]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, score int").repartition(5)
    job = balltree.TopK(shard_rows=shard_rows, leaf_rows=8, query_rows=4)
    got = sorted(tuple(r) for r in balltree.top_k(df, F.col("vec_id") % 50 == 0, job).collect())
    assert got == brute(vectors, lambda i: i % 50 == 0)
    assert balltree.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_vectors_are_sent_to_groups_and_not_to_every_pair(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.integers(-40, 40, (4_000, 2))
    df = spark.createDataFrame([(i, [float(v) / 256 for v in r]) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    sent, deal = [], type(df).repartition

    def counted(self, *how):
        sent.append(self.count())
        return deal(self, *how)

    monkeypatch.setattr(type(df), "repartition", counted)
    got = balltree.top_k(df, F.col("vec_id") % 4 == 0, balltree.TopK(shard_rows=20, leaf_rows=8, query_rows=10)).collect()
    assert sum(sent) < 7_000  # 200 shards and 100 blocks are 20,000 pairs
    score = x[::4] @ x.T
    score[np.arange(1_000), np.arange(0, 4_000, 4)] = -(10**6)
    order = np.argsort(-score, axis=1, kind="stable")[:, :5]
    want = [(4 * q, r + 1, int(v), int(score[q, v])) for q in range(1_000) for r, v in enumerate(order[q])]
    assert sorted(map(tuple, got)) == want


def test_scores_that_are_clipped_have_ranks(spark):
    df = spark.createDataFrame([(0, [2.0**36, 1.0]), (1, [-(2.0**36), 0.0]), (2, [2.0**36, 0.0])], "vec_id long, embedding array<double>")
    got = balltree.top_k(df, F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in sorted(got)] == [(0, 1, 2, 2**63 - 1), (0, 2, 1, -(2**63))]


def test_huge_components_are_exact():
    q, p = np.array([[2.0**40, -1.0]]), np.array([[2.0**20, 3.0], [2.0**30, 0.0]])
    assert balltree.exact_scores(q, p).tolist() == [[2**60 - 3, 2**63 - 1]]


@pytest.fixture(scope="module")
def pieces():
    return sentencepieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))


def test_viterbi_equals_the_plain_table(pieces):
    v = sentencepieces.Viterbi(pieces)
    known = {p: v.automaton.get(p) for p in v.automaton.keys()}
    longest = max(map(len, known))
    for text in [x[:300] for _, x in corpus(n=8)[0]] + ["héllo wörld  twice", "あ x\U0001F600y", "   ", "a\n\tb"]:
        s = "▁" + text.replace(" ", "▁")
        best = [0.0]
        for e in range(1, len(s) + 1):
            options = [best[b] + known[s[b:e]][2] for b in range(max(0, e - longest), e) if s[b:e] in known]
            best.append(max(options, default=-np.inf))
            best[e] = max(best[e], best[e - 1] + pieces.unknown * len(s[e - 1].encode()))
        ids_, score = v.encode(text)
        assert score == pytest.approx(best[-1]) and v.decode(ids_) == text


def test_every_text_comes_back(spark, pieces):
    texts = corpus(n=8)[0] + odd_texts() + [(1, "▁meta ▁▁ signs"), (2, "  lead and trail  "), (3, "\x00\x07 controls"), (3, "again")]
    df = documents(spark, texts).withColumnRenamed("lang", "IDS").repartition(3)
    got = sentencepieces.encode_and_decode(df, pieces).collect()
    assert len(got) == len(texts) and all(r["round_trip"] for r in got)
    assert all(len(r["ids"]) == r["n_pieces"] for r in got)
    coded = sentencepieces.encode(df, pieces)
    back = sorted((str(r["doc_id"]), r["text"]) for r in sentencepieces.decode(coded, pieces).collect())
    assert back == sorted((str(i), t or "") for i, t in texts)
    assert sentencepieces.encode(spark.createDataFrame([], SCHEMA), pieces).count() == 0
