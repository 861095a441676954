"""The registered queries over the test tables, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from . import balltree, classifier, licenses, merkle, minhash, packing, periods, retrieval, rules, secrets, sentencepieces, substrings, warc
from .common import findable, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(run):
        def started(spark: SparkSession, sf_dir: str) -> DataFrame:
            findable(spark)
            return run(spark, sf_dir)

        QUERIES[name] = started
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def tokenizer_settings() -> packing.Packing:
    """Where the public byte-level BPE files are."""
    import public_tokenizers

    return packing.Packing(
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


@query("op1_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice in every document, with its coverage and place."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op2_warc_salvage")
def warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to WARC archives and read them back with the salvage reader."""
    rows = warc.round_trip(spark, table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return rows.where("gap_reason is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_substring_dedup")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its repeated passages cut out, the cut spans and where they were first."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), details=True)


@query("op4_exact_top_k")
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest integer inner products of every fiftieth vector with all the others."""
    return balltree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op5_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_settings())


@query("op6_quality_rules", rules.SQL)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op7_sentencepiece")
def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether decoding them gives the text back."""
    import public_tokenizers

    return sentencepieces.encode_and_decode(table(spark, sf_dir, "documents"), sentencepieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model")))


@query("op8_minhash_near_dedup")
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.NearDup(width=3, percent=85))


@query("op9_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-trained on a bounded sample of the labels, then every document is scored."""
    docs = table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


@query("op10_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate in every document with the forest's verdict."""
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.train(secrets.labelled_findings(spark)))


@query("op11_merkle_manifest", merkle.SQL)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of every document, and whether its version, tampered with or not, still has the root."""
    return merkle.tampered(table(spark, sf_dir, "documents"))


@query("op12_periodic_runs", periods.SQL)
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, some of which have a period planted, and the text without them."""
    return periods.report(periods.with_planted_period(table(spark, sf_dir, "documents")))


@query("op13_lexical_packing")
def lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.pack(table(spark, sf_dir, "documents"), retrieval.Retrieval(tokenizer_settings()))
