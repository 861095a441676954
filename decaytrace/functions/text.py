"""Text, entity-name and property helpers, all as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from .numbers import col

# Entity-name prefixes and the label each one is shown with.
FEATURE_PREFIX = "urn:li:mlFeature:"
FEATURE_TABLE_PREFIX = "urn:li:mlFeatureTable:"
MODEL_PREFIX = "urn:li:mlModel:"
DATASET_PREFIX = "urn:li:dataset:"
RUN_PREFIX = "urn:li:dataProcessInstance:"


def java_quote(text: str) -> str:
    """Escape every regex metacharacter in a literal."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def word_match(text: Column | str, word: str) -> Column:
    """True where ``word`` stands alone in the text, with letters of any script as word parts."""
    return col(text).rlike(r"(?U)\b" + java_quote(word) + r"\b")


def preview_text(c: Column | str, limit: int = 400) -> Column:
    flat = F.regexp_replace(col(c), "\n", " ")
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit(" ..."))).otherwise(flat)


def csv_to_array(c: Column | str) -> Column:
    return F.filter(F.split(col(c), ","), lambda x: x != "")


def props_to_map(c: Column | str) -> Column:
    """``[{key, value}]`` to a map; NULL gives an empty map and the last duplicate wins."""
    pairs = F.coalesce(col(c), F.array().cast("array<struct<key:string,value:string>>"))
    last = F.filter(
        F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), p["value"].alias("value"), i.alias("i"))),
        lambda p: ~F.exists(F.slice(pairs, p["i"] + 2, F.size(pairs)), lambda q: q["key"] == p["key"]),
    )
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"])))


def urn_short(c: Column | str) -> Column:
    """Readable label of an entity name; an unknown shape is returned unchanged."""
    urn = col(c)
    body = F.regexp_replace(urn, r"\)+$", "")
    last = F.element_at(F.split(body, ","), -1)
    second = F.get(F.split(body, ","), F.lit(1))
    return (
        F.when(urn.startswith(DATASET_PREFIX), F.coalesce(F.get(F.split(urn, ","), F.lit(1)), urn))
        .when(urn.startswith(FEATURE_PREFIX), F.concat(F.lit("mlFeature: "), last))
        .when(urn.startswith(FEATURE_TABLE_PREFIX), F.concat(F.lit("mlFeatureTable: "), last))
        .when(urn.startswith(MODEL_PREFIX), F.concat(F.lit("mlModel: "), F.coalesce(second, urn)))
        .when(urn.startswith(RUN_PREFIX), F.concat(F.lit("trainingRun: "), F.element_at(F.split(urn, ":"), -1)))
        .otherwise(urn)
    )


def urn_table_key(c: Column | str) -> Column:
    """Platform-free identity: the last two dotted parts of the second comma field."""
    urn = col(c)
    parts = F.split(F.get(F.split(urn, ","), F.lit(1)), r"\.")
    tail = F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2)
    return F.coalesce(F.array_join(tail, "."), urn)


def token_merge(c: Column | str, merges: Sequence[tuple[Sequence[str], str]], fixes: Mapping[str, str]) -> Column:
    """Rejoin split token runs, then replace single tokens.

    Works on the whole text with its tokens two blanks apart, so that each token
    owns the blank on either side and neighbours never compete for one. A single
    alternation, longest run first, marks the runs from left to right; marked
    runs are rewritten and are out of reach of the single-token fixes.
    """
    opened, closed, gap = "\u0002", "\u0003", "\u0001"
    text = F.concat(F.lit(" "), F.regexp_replace(F.trim(col(c)), r"\s+", "  "), F.lit(" "))
    runs = [("  ".join(java_quote(t) for t in run), joined) for run, joined in sorted(merges, key=lambda m: -len(m[0]))]
    if runs:
        text = F.regexp_replace(text, "(?i) (" + "|".join(r for r, _ in runs) + ") ", f" {opened}$1{closed} ")
    for run, joined in runs:
        target = joined.replace("$", r"\$").replace(" ", gap)
        text = F.regexp_replace(text, f"(?i){opened}{run}{closed}", f"{opened}{target}{closed}")
    for wrong, right in fixes.items():
        text = F.regexp_replace(text, f"(?i) [.,!?]*{java_quote(wrong)}[.,!?]* ", f" {right} ")
    return F.trim(F.regexp_replace(F.translate(text, gap + opened + closed, " "), "  +", " "))
