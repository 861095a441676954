"""Check what documents state against what was measured."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import round_n
from ..functions.text import word_match


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def claims_cited(documents: DataFrame, spellings: Mapping[str, Sequence[str]], key: str = "doc_id") -> DataFrame:
    """(label, document) for every document that holds any spelling of a claim.

    The claims are a short list, so each document is tested in one projection and
    nothing is joined. One row per hit: no list per claim is gathered.
    """
    hits = F.array(
        *[
            F.when(any_of([F.col("text").contains(s) for s in forms]), F.lit(label))
            for label, forms in spellings.items()
        ]
    )
    return documents.select(F.explode(F.array_compact(hits)).alias("label"), key)


def claims_summary(documents: DataFrame, spellings: Mapping[str, Sequence[str]]) -> DataFrame:
    """Documents that cite each claim; zero where none does."""
    counted = documents.agg(
        *[
            F.count_if(any_of([F.col("text").contains(s) for s in forms])).alias(label)
            for label, forms in spellings.items()
        ]
    )
    return counted.unpivot([], list(spellings), "label", "documents")


def claims_banned(
    documents: DataFrame, banned: Mapping[str, str], starts: Sequence[str], parts: Sequence[str], key: str = "doc_id",
) -> DataFrame:
    """(label, document, line number) of every retired claim in a line that does not disown it.

    A line disowns what it says if, in lower case and without blanks around it, it starts
    with one of ``starts`` or holds one of ``parts``; which wordings do so is the caller's
    to say. Both lists become one pattern, so a line is read once for all of them.
    """
    quoted = [f"^\\Q{x.lower()}\\E" for x in starts] + [f"\\Q{x.lower()}\\E" for x in parts]
    disowned = F.lower(F.trim("line")).rlike("|".join(quoted)) if quoted else F.lit(False)
    lines = documents.select(key, F.posexplode(F.split("text", "\r\n|\r|\n")).alias("pos", "line")).filter(
        # one pass over each line settles the common case; the rest is done for hits only
        F.col("line").rlike("|".join(f"(?:{p})" for p in banned.values()))
    )
    found = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.lit(label)) for label, p in banned.items()]))
    return lines.filter(~disowned).select(F.explode(found).alias("label"), key, (F.col("pos") + 1).cast("bigint").alias("line_no"))


def claims_arith(df: DataFrame, per_row: str, rows: str, total: str, tolerance: float = 1.0) -> DataFrame:
    """Does the per-row figure times the rows give the stated total?"""
    computed = round_n(F.col(per_row) * F.col(rows), 2)
    return df.withColumn("computed", computed).withColumn("reconciles", F.abs(F.col("computed") - F.col(total)) < tolerance)


def locate_transformation(texts: DataFrame, features: Sequence[str], root_column: str, key: str = "path") -> DataFrame:
    """Score each text: one point per affected feature named, one for the root column."""
    points = [word_match("text", f).cast("int") for f in (*features, root_column)]
    return texts.select(key, reduce(lambda a, b: a + b, points).alias("score")).filter(F.col("score") > 0)


def best_transformation(scores: DataFrame, key: str = "path") -> DataFrame:
    """Highest score, the first name on ties; no row if nothing scored."""
    best = scores.agg(F.min_by(F.struct(key, "score"), F.struct(-F.col("score"), F.col(key))).alias("b"))
    return best.filter(F.col("b").isNotNull()).select("b.*")
